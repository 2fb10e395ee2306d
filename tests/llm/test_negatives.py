import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.llm import negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int, norm string, q int"


def plain(rows, positives=5, most=3):
    """Every pair, in whole numbers."""
    part = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)]
    found = []
    for a, v, la in part:
        if a % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, lb == la) for i, w, lb in part if i != a]
        for p, i, _ in sorted(s for s in scored if s[2])[:positives]:
            fits = sorted(s for s in scored if not s[2] and 50 * -p <= 100 * -s[0] <= 95 * -p)[:most]
            found += [(a, i, rank, j, -p, -s) for rank, (s, j, _) in enumerate(fits, 1)]
    return sorted(found)


def mined(spark, rows, parts=3, **options):
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 50 == 0, **options).collect()))


def invented(n, seed, kind):
    dice = np.random.default_rng(seed)
    middle = dice.normal(size=(4, 8))
    rows = []
    for i in range(n):
        v = middle[i % 4] + dice.normal(size=8) * 0.3 if kind == "clusters" else dice.normal(size=8)
        if kind == "ties":
            v = np.round(v)
        rows.append((i, (v * (10.0 ** dice.uniform(-1, 1)) if kind == "norms" else v).tolist(), int(dice.integers(3)) if kind != "one label" else 1))
    return rows


@pytest.mark.parametrize("kind", ["clusters", "norms", "ties", "random", "one label"])
def test_against_every_pair(spark, monkeypatch, kind):
    monkeypatch.setattr(negatives, "FEWEST", 64)  # several groups of rows
    monkeypatch.setattr(negatives, "ANCHORS", 3)  # and of anchors
    rows = invented(420, 3, kind)
    want = plain(rows)
    assert mined(spark, rows) == want
    assert (len(want) > 20) == (kind != "one label")


def test_odd_rows(spark):
    dice = random.Random(4)
    rows = [(i, [dice.uniform(-1, 1) for _ in range(4)], dice.randint(0, 1)) for i in range(60)]
    rows += [(None, [1.0] * 4, 0), (100, None, 0), (150, [1.0, None, 0.0, 0.0], 1), (200, [float("nan")] * 4, 1), (250, [float("inf")] * 4, 0), (300, [1.0] * 4, None)]
    rows += [(350, [], 1), (351, [0.5], 1), (352, [0.5, 0.5, 0.5, 0.5, 9.0, 9.0], 0), (353, [1e300] * 4, 0), (-50, [0.3, 0.3, 0.1, 0.0], 1)]
    assert mined(spark, rows) == plain([r for r in rows if r[0] != 353])
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(50, [1.0], 1)]) == []


def test_repeated_rows(spark):
    rows = [(50, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (1, [1.0, 0.1], 1), (2, [0.8, 0.0], 2), (2, [0.8, 0.0], 2)]
    # each copy counts once, an anchor's own none, and the anchor itself once
    assert mined(spark, rows) == sorted([(50, 1, rank, 2, 256 * 256, 204 * 256) for rank in (1, 2)] * 2)


@pytest.mark.parametrize("scale", [2.0**18, 2.0**21])
def test_scores_beyond_doubles(spark, scale):
    dice = random.Random(9)
    rows = [(i, [scale * dice.uniform(0.5, 1) for _ in range(4)], i % 2) for i in range(120)]
    assert mined(spark, rows) == plain(rows) != []


def test_walks_end_early_where_a_bound_allows(spark):
    dice = np.random.default_rng(1)
    near, far = dice.normal([9, 0, 0, 0], 0.1, (3000, 4)), dice.normal([-9, 0, 0, 0], 0.1, (9000, 4))
    rows = np.floor(np.concatenate([near, far]) * 256)
    packed = [r.astype("<i8").tobytes() + b"\x08" for r in rows]
    norms = np.sqrt((rows**2).sum(1))
    lists = negatives.Lists(np.arange(len(rows)), np.ones(len(rows), int), norms, packed, np.array([[1.0, 0, 0, 0]]), False)
    positions, bounds = lists.sorted(0, 0.1, np.arange(len(rows)))
    low, high = np.full((2, 1), -(1 << 62)), np.full((2, 1), 1 << 62)
    member, _, keys, scored = negatives.walk(lists, positions, bounds, rows[:2], norms[:2], np.arange(2), np.array([1, 1]), low, high, 5, True)
    assert scored <= 2 * 4 * negatives.STEP  # 9,000 rows of the other direction are never scored
    for m in (0, 1):
        scores = rows @ rows[m]
        want = sorted((-s, i) for i, s in enumerate(scores) if i != m)[:5]
        bits = len(rows).bit_length()
        assert [(-int(k >> bits), (1 << bits) - 1 - int(k & ((1 << bits) - 1))) for k in keys[member == m]] == want
