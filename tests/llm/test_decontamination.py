import random
import time

import numpy as np

from assaykit.llm import decontamination as D
from assaykit.llm.queries import op2_decontamination

ITEM = "Alpha beta gamma delta epsilon zeta. Eta theta iota kappa lambda mu nu? Xi omicron pi rho sigma tau upsilon."


def plain_tiles(p, t, least):
    """The textbook form: the longest match of free tokens, leftmost first, again and again."""
    p_free, t_free, out = [True] * len(p), [x > 0 for x in t], []
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p_free[i + k] and t_free[j + k] and p[i + k] == t[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return out
        p_free[i : i + k] = t_free[j : j + k] = [False] * k
        out.append((i, j, k))


def test_tiles_as_the_textbook():
    rng = random.Random(3)
    for _ in range(400):
        p = [rng.randint(1, rng.choice([2, 6])) for _ in range(rng.randint(3, 25))]
        t = [rng.choice([0, *range(1, 7)]) for _ in range(rng.randint(0, 40))]
        for _ in range(2):
            a = rng.randint(0, len(p) - 1)
            t[rng.randint(0, len(t)) : 0] = p[a : a + rng.randint(3, 10)]
        assert D.tile(np.array(p, np.uint64), np.array(t, np.uint64), 3) == plain_tiles(p, t, 3)


def test_periodic_items_and_texts():
    for unit, n, m in (("a", 200, 2_000), ("a b", 300, 100_000), ("a b c d e f g", 90, 20_000), ("a a b", 200, 60_000)):
        item, text = D.Words().ids(f"{unit} " * n), D.Words().ids(f"{unit} " * m)
        began = time.process_time()
        assert D.tile(item, text) == [(0, 0, len(item))]
        assert D.tile(item, np.concatenate([text[: len(item) // 2], [np.uint64(0)], text[:7]]))
        assert time.process_time() - began < 1


def test_rolling_hash_tells_windows_apart():
    ids = np.array([1, 2, 3, 1, 2, 3, 4], np.int64)
    for n in range(1, 8):
        h = D.rolling(ids, n).tolist()
        assert len(h) == 8 - n
        assert all((h[a] == h[b]) == (ids[a : a + n].tolist() == ids[b : b + n].tolist()) for a in range(len(h)) for b in range(len(h)))


def held(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = D.contaminated(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    return [sorted(r.item_id for r in rows if r.doc_id == k) for k in range(len(texts))]


def test_copies_reordered_and_partial_passages(spark):
    around = "some words before the passage and "
    one, two, three = (s.strip() for s in ITEM.replace("?", ".").split(".")[:3])
    yes = [around + ITEM + " and after", around + ITEM.upper().replace(".", "!!"), f"{three}, filler here {one}; {two}", (one + " x ") * 500 + ITEM]
    no = [one + " only this part of it", "alpha gamma beta delta zeta epsilon and so on", None, "", "?!", around * 50]
    assert held(spark, [*yes, *no], [(7, ITEM), (8, None), (9, "two words"), (10, "")]) == [[7]] * len(yes) + [[]] * len(no)


def test_short_items_and_scripts_without_spaces(spark):
    items = [(1, "few enough words"), (2, "Quatre mots en tout"), (3, "今日は良い天気です"), (4, "か な")]
    texts = ["with few, enough WORDS in it", "few words enough", "x quatre mots en tout y", "quatre mots tout en", "彼は「今日は良い天気です」と言った", "今日は悪い", "かな"]
    assert held(spark, texts, items) == [[1], [], [2], [], [3], [], []]


def test_long_and_periodic_texts(spark):
    texts = ["filler words " * 300_000 + ITEM, "a b " * 50_000, ITEM + " z" * 400_000]
    assert held(spark, texts, [(7, ITEM), (8, "a b " * 300)]) == [[7], [8], [7]]


def test_frames(spark):
    bench = spark.createDataFrame([(7, ITEM, 1), (8, None, 1), (7, ITEM, 2)], "item_id bigint, text string, doc_id int")
    docs = spark.createDataFrame([(1, ITEM, 0), (1, ITEM, 0), (2, None, 0), (None, ITEM, 0), (3, "clean words", 0)], "doc_id bigint, text string, coverage int")
    got = D.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id, r.coverage) for r in got} == {(1, 7, 1.0), (None, 7, 1.0)}
    assert sorted(r.doc_id for r in D.clean(docs, bench).collect()) == [2, 3]
    assert D.clean(docs, bench).columns == docs.columns
    assert D.contaminated(docs, bench.limit(0)).count() == 0 and D.clean(docs, bench.limit(0)).count() == 5
    assert D.contaminated(docs.limit(0), bench).count() == 0


def test_query_against_every_pair(spark, sf_dir):
    items = {r.item_id: D.tokens(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        words = D.tokens(r.text)
        runs = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        for item, p in items.items():
            if any(tuple(p[i : i + 5]) in runs for i in range(len(p) - 4)):
                covered = sum(n for _, _, n in plain_tiles(*numbered(p, words), 3))
                if covered >= 0.8 * len(p):
                    want.add((r.doc_id, item))
    got = {(r.doc_id, r.item_id) for r in op2_decontamination(spark, sf_dir).collect()}
    assert got == want and got


def numbered(p, words):
    ids = {w: i + 1 for i, w in enumerate(dict.fromkeys(p))}
    return [ids[w] for w in p], [ids.get(w, 0) for w in words]
