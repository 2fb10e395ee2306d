import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from assaykit.llm import mixing
from assaykit.llm.queries import op11_mixing

SCHEMA = "doc_id bigint, text string, source string, size string, row int, taken int"


def level(sizes, budget=None, weights=(5, 2, 1), most=3):
    """Targets by sharing again what is above, round after round, in fractions."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = min(Fraction(sum(sizes.values()) if budget is None else budget), most * sum(sizes.values()))
    capped, open_ = {}, set(order)
    while open_:
        left = total - sum(capped.values())
        share = {s: left * w[s] / sum(w[t] for t in open_) for s in open_}
        above = {s for s in open_ if share[s] > most * sizes[s]}
        if not above:
            return capped | share
        capped |= {s: Fraction(most * sizes[s]) for s in above}
        open_ -= above
    return capped


def served(rows, targets, total, most=3):
    """The mix from its rows (row, source, rank, place, size): every copy in one sorted list, taken one by one."""
    sizes = Counter()
    for _, source, _, _, size in rows:
        sizes[source] += size
    ends, copies = Counter(), []
    for row, source, rank, _, size in sorted(rows, key=lambda r: (r[2], r[3])):
        ends[source] += size
        copies += [((i * sizes[source] + ends[source]) / float(targets[source]), rank, row, size) for i in range(most) if size]
    taken, left = Counter(), total
    for _, _, row, size in sorted(copies):
        taken[row] += min(size, left)
        left -= min(size, left)
    return taken


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA)


def invented(n, seed):
    dice = random.Random(seed)
    names = ["b", "a", "\U0001f600", "￿", "", None]  # by code point the smile comes after U+FFFF
    return [(dice.choice([i, i, 7, None]), dice.choice([None, "", " \n ", "w " * dice.randint(1, 30), "x\x85y z"]), names[int(dice.random() ** 3 * 6)]) for i in range(n)]


@pytest.mark.parametrize("budget", [None, 50, 100_000])
def test_mix_against_one_sorted_list(spark, budget):
    rows = invented(400, 5)
    each, mixed = mixing.mix(table(spark, rows), budget=budget)
    got = each.collect()
    key = lambda r: (str(r[0]), len([w for w in (r[1] or "").replace("\n", " ").split(" ") if w]), str(r[2]))
    assert Counter((str(r.doc_id), r.size, str(r.source)) for r in got) == Counter(map(key, rows))
    sizes = defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
    want = level(sizes, budget)
    assert all(r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source])) for r in got)
    rank = {s: i for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    total = min(budget or sum(sizes.values()), 3 * sum(sizes.values()))
    taken = served([(r.row, r.source, rank[r.source], r.row, r.size) for r in got], {r.source: r.target for r in got}, total)
    assert {r.row: r.taken for r in got} == {r.row: taken[r.row] for r in got}
    assert sum(r.taken for r in got) == total and all(r.taken <= 3 * r.size for r in got)
    mix = mixed.collect()
    assert sum(r.words for r in mix) == total
    assert [r.finish for r in mix] == sorted(r.finish for r in mix)
    assert len({(r.row, r.repeat) for r in mix}) == len(mix)


def test_a_source_of_one_word_and_a_hot_one(spark):
    rows = [(i, "w", "b") for i in range(300)] + [(1000, "w", "a"), (1001, None, "c")]
    got = mixing.mix(table(spark, rows))[0].collect()
    by = {r.source: (r.source_size, r.target) for r in got}
    assert by == {"a": (1, 3.0), "b": (300, 298.0), "c": (0, 0.0)}
    assert sum(r.taken for r in got if r.source == "a") == 3 and sum(r.taken for r in got) == 301


def test_no_rows_and_no_words(spark):
    assert mixing.mix(table(spark, []))[0].collect() == []
    got = mixing.mix(table(spark, [(1, None, "a"), (1, "", None)]))[0].collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in got] == [(0, 0, 0.0, 0)] * 2


def test_running_totals_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), F.lit(2).cast("long").alias("v"))
    got = mixing.running_totals(df, [F.col("k")], v=F.col("v")).collect()
    assert {r.k: r.v for r in got} == {k: 2 * k for k in range(1000)}


def test_long_texts_and_reruns(spark, sf_dir):
    long = [(1, "w " * 300_000, "a"), (2, "w " * 1000, "b")]
    got = {r.doc_id: (r.size, r.taken) for r in mixing.mix(table(spark, long))[0].collect()}
    assert got[1][0] == 300_000 and sum(t for _, t in got.values()) == 301_000
    once, again = (sorted(op11_mixing(spark, sf_dir).collect()) for _ in range(2))
    assert once == again
    sizes = {r.doc_id: r.size for r in once}
    for target in {r.target for r in once}:
        rows = [r for r in once if r.target == target]
        longest = max(sizes[r.doc_id] for r in rows)
        assert abs(sum(r.taken for r in rows) - target * len({r.source_size for r in rows})) <= 2 * longest * len({r.source_size for r in rows})
