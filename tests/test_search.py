import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.functions import search
from assaykit.functions.text import substring_distance

TEXTS = "doc_id bigint, text string, item_id string"
WANTED = "item_id bigint, required string, text string, distance int"


def every_pair(texts, wanted, rate):
    tidy = lambda t: " ".join(t.lower().split())
    out = []
    for d, t in texts:
        for i, w in wanted:
            if not t or not w or not t.strip() or not w.strip():
                continue
            distance, end = substring_distance(tidy(t), tidy(w))
            if distance <= int(rate * len(tidy(w)) + 1e-9):
                out.append((i, d, distance, end, round(distance / len(tidy(w)), 6)))
    return sorted(out, key=str)


def found(spark, texts, wanted, rate, **options):
    a = spark.createDataFrame([(*t, "clash") for t in texts], TEXTS)
    b = spark.createDataFrame([(*w, "clash", 1) for w in wanted], WANTED)
    return sorted(map(tuple, search.approx_find(a, b, rate, **options).collect()), key=str)


def spoilt(text, n, dice, letters):
    for _ in range(n):
        at, kind = dice.randrange(len(text) + 1), dice.randrange(3)
        text = text[:at] + (dice.choice(letters) if kind else "") + text[at + (kind < 2) :]
    return text


@pytest.mark.parametrize(("letters", "rate"), [("abcdefgh ", 0.1), ("ab ", 0.1), ("abcd\U0001f600é", 0.25), ("abcdefghijklm ", 0.34), ("abc ", 0.0)])
def test_against_every_pair(spark, letters, rate):
    dice = random.Random(letters)
    word = lambda n: "".join(dice.choice(letters) for _ in range(n))
    wanted = [(i, word(dice.choice((1, 2, 3, 5, 9, 10, 17, 40, 90)))) for i in range(30)] + [(50, None), (51, " "), (None, "ab"), (3, "ab")]
    texts = []
    for i in range(60):
        w = dice.choice(wanted)[1] or "x"
        texts.append((i, word(dice.randrange(40)) + spoilt(w, dice.randrange(int(rate * len(w)) + 3), dice, letters) + word(dice.randrange(40))))
    texts += [(None, texts[0][1]), (7, texts[0][1].upper()), (90, None), (91, "  "), (92, "a")]
    want = every_pair(texts, wanted, rate)
    assert found(spark, texts, wanted, rate) == want
    assert len(want) > 30


def test_one_edit_in_every_fifth_word(spark):
    wanted = [(1, "summer sale 30% off today only yes")]
    assert found(spark, [(1, "xx summer sale 30% of today only yes")], wanted, 0.1) == [(1, 1, 1, 36, round(1 / 34, 6))]
    assert found(spark, [], wanted, 0.1) == [] and found(spark, [(1, "summer")], [], 0.1) == []


def test_blocks_stock_phrases_and_long_texts(spark):
    dice = random.Random(6)
    word = lambda n: "".join(dice.choice("abcdefghijklmnop ") for _ in range(n))
    stock = "which of the following is right about "
    wanted = [(i, stock + word(60)) for i in range(40)] + [(77, "na" * 30), (78, word(3000))]
    texts = [(i, word(30) + stock + (spoilt(wanted[i][1][len(stock) :], 8, dice, "abc") if i < 20 else word(60))) for i in range(40)]
    texts += [(60, "na" * 5000 + "x" + "na" * 20), (61, "n" * 20_000), (62, word(2000) + spoilt(wanted[-1][1], 200, dice, "xyz") + word(100))]
    want = every_pair(texts, wanted, 0.1)
    assert found(spark, texts, wanted, 0.1) == want == found(spark, texts, wanted, 0.1, block=500)
    assert {w[1] for w in want} >= {60, 62} and len(want) >= 20


def test_a_common_phrase_costs_no_climb_past_it():
    """A thousand wanted texts and a text that share a phrase: the comparisons stay short."""
    dice = random.Random(8)
    word = lambda n: "".join(dice.choice("abcdefghijklmnop ") for _ in range(n))
    stock = "which of the following is right about "
    index = search.Index([stock + word(160) for _ in range(1000)], 0.1)
    spent = []
    plain = search.substring_distance
    search.substring_distance = lambda a, b: spent.append(len(a)) or plain(a, b)
    try:
        assert index.find(word(500) + stock + word(500)) == {}
    finally:
        search.substring_distance = plain
    assert max(spent) < 120 and sum(spent) < 1000 * 150


def test_ways_and_hashes():
    for size, leaves in ((1, 1), (30, 4), (226, 23), (10, 3)):
        ways = search._way(size, leaves)
        assert len(ways) == leaves and [a for a, _, _ in ways] == [0] + [b for _, b, _ in ways[:-1]] and ways[-1][1] == size
        for a, b, above in ways:
            spans = [(a, b), *((x, y) for x, y, _ in above)]
            assert all(x2 <= x1 and y1 <= y2 for (x1, y1), (x2, y2) in zip(spans, spans[1:]))
            assert not above or above[-1] == (0, size, leaves - 1)
    chars = np.array([5, 6, 7, 5, 6, 7, 8], np.uint32)
    for n, h in search._hashes(chars, [1, 2, 3, 7, 9]).items():
        assert len(h) == len(chars) - n + 1
        same = {(i, j) for i in range(len(h)) for j in range(len(h)) if chars[i : i + n].tolist() == chars[j : j + n].tolist()}
        assert same == {(i, j) for i in range(len(h)) for j in range(len(h)) if h[i] == h[j]}


def test_a_rate_of_one_is_refused(spark):
    with pytest.raises(ValueError, match="everything"):
        search.Index(["abc"], 1.0)


def test_texts_are_scanned_once_for_all_wanted(spark):
    texts, wanted = spark.range(5).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text")), spark.createDataFrame([(1, "abc")], "item_id bigint, required string")
    plan = search.approx_find(texts, wanted)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Cartesian" not in plan and "NestedLoop" not in plan
