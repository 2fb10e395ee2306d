import hashlib
import random

import numpy as np
import pytest

from assaykit.llm import repeats
from assaykit.llm.queries import op8_repeats


def plain(rows):
    """rows: (id, bytes). What is left of each, and its removed runs."""
    first = {}
    for i, t in sorted(rows):
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    out = []
    for i, t in rows:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = True
        edges = np.diff(np.append(False, gone).astype(int))
        out.append((i, len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])).hexdigest()))
    return sorted(out)


def digest(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in df.collect())


def test_suffix_order():
    rng = random.Random(1)
    for _ in range(20):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randint(60, 900)))
        text += text[5:70]
        data = np.frombuffer(text + bytes(80), np.uint8).astype(np.uint64)
        letters = sum(data[k : k + len(text) + 50] << np.uint64(8 * (5 - k)) for k in range(6))
        starts = np.arange(len(text) - 49)
        order = repeats.suffix_order(letters, starts)
        assert sorted(order.tolist()) == starts.tolist()
        keys = [text[s : s + 50] for s in order]
        assert keys == sorted(keys)


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh é\n"])
def test_random_texts(spark, alphabet):
    rng = random.Random(7)
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randint(30, 160))) for _ in range(25)]
    rows = []
    for i in range(120):
        parts = [rng.choice(pool) if rng.random() < 0.5 else "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90))) for _ in range(rng.randint(0, 5))]
        rows.append((i * 3, "".join(parts)))
    rows += [(1000, rows[5][1]), (1, "x" * 500), (2, "x" * 60), (4, "x" * 49), (5, "x" * 49), (7, "ab" * 400), (8, "ba" * 100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert digest(repeats.remove(df)) == plain([(i, t.encode()) for i, t in rows])


def test_large_anchors_by_halves(spark, monkeypatch):
    # in one process: the same runs whether the contexts of an anchor are sorted together, in halves or in small chunks
    rng = random.Random(12)
    gram = b"SIXTEEN-BYTES-..", "abcdef"
    contexts, offsets = [], []
    for _ in range(300):
        left, right = ("".join(rng.choice("ab") for _ in range(n)).encode() for n in (34, 34))
        if rng.random() < 0.7 and contexts:
            old, a = rng.choice(list(zip(contexts, offsets)))
            cut_at = rng.randint(0, a)
            left, right = left[: 34 - cut_at] + old[a - cut_at : a], old[a + 16 :] + right[len(old) - a - 16 :]
        x, y = rng.randint(0, 34), rng.randint(0, 34)
        if x + y >= 34:
            contexts.append(left[34 - x :] + gram[0] + right[:y])
            offsets.append(x)
    n = len(contexts)
    copies, ids, ats = np.zeros(n, np.int64), np.array(rng.sample(range(1000), n)), np.arange(n) * 1000

    def gone(tables):
        return sorted({(i, p) for t in tables for i, a, b in zip(t["id"].to_pylist(), t["start"].to_pylist(), t["stop"].to_pylist()) for p in range(a, b)})

    whole = gone([repeats._solved(copies, ids, ats, contexts)])
    assert whole and gone(repeats._large(copies, ids, ats, contexts, offsets)) == whole
    monkeypatch.setattr(repeats, "CHUNK", 500)
    parts = list(repeats._large(copies, ids, ats, contexts, offsets))
    assert len(parts) > 10 and gone(parts) == whole


def test_a_phrase_and_a_line_in_every_document(spark):
    rng = random.Random(13)
    line = "This line stands in each of these documents, and is longer than fifty bytes. "
    made = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = [(i, made(60) + "a common phrase here" + made(60) + (line if i % 3 else "") + made(rng.randint(0, 40))) for i in range(500)]
    rows += [(1000 + i, rows[i][1][: rng.randint(70, 200)]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert digest(repeats.remove(df)) == plain([(i, t.encode()) for i, t in rows])


def test_texts_of_one_class(spark, monkeypatch):
    from pyspark.sql import functions as F

    texts = repeats._texts
    monkeypatch.setattr(repeats, "_texts", lambda docs, text: texts(docs, text).withColumn("class", F.col("class") % 2))
    passage = "A passage of more than fifty bytes that stands in two of the documents here. "
    rows = [(i, f"{i} head " + (passage if i in (3, 8) else "x") + f" tail {i}") for i in range(12)] + [(20, "9 head x tail 9"), (None, passage)]
    want = plain([(99 if i is None else i, t.encode()) for i, t in rows])
    got = digest(repeats.remove(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert sorted(g[1:] for g in got) == sorted(w[1:] for w in want)


def test_a_very_long_text(spark):
    rng = random.Random(14)
    long = "".join(rng.choice("abcdefghij") for _ in range(3_000_000))
    rows = [(2, long + long[:1000]), (1, long[5_000:5_200]), (3, long[1_000_000:2_000_000])]
    got = digest(repeats.remove(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert [g[:4] for g in got] == [(1, 200, 0, 0), (2, 3_001_000, 200, 1), (3, 1_000_000, 1_000_000, 1)]


def test_texts_are_shuffled_once(spark, sf_dir):
    plan = repeats.remove(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    plan.collect()
    final = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    exchanges = [line for line in final.splitlines() if "Exchange" in line and "REPARTITION_BY_NUM" in line and "none#" in line]
    assert len(exchanges) == 2 and sum("ReusedExchange" in line for line in exchanges) == 1


def test_odd_rows(spark):
    a = "A passage of more than fifty bytes that stands in several of the documents here. "
    rows = [(5, a + "tail five", 0), (3, "head three " + a, 0), (3, "head three " + a, 0), (None, a, 0), (9, None, 0), (8, "", 0), (3, "other text under the same id " + a, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans int")
    got = digest(repeats.remove(df))
    assert len(got) == len(rows)
    by = {}
    for g in got:
        by.setdefault(g[0], []).append(g[2])
    assert by[3] == [0, 0, 0] and by[9] == by[8] == [0]
    assert by[5] == [len(a)] and by[-1] == [len(a)]
    assert repeats.remove(df.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op8_repeats(spark, sf_dir).collect())
    assert got == plain(rows)
