import math
from collections import Counter

from assaykit.llm import quality
from assaykit.llm.queries import op7_quality


def plain(text):
    text = text or ""
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + d for i, w in enumerate(windows) if n[w] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def figures(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words


ODD = [None, "", " \n\t", "a", "a b c a b c a b c", "x y z\nx y z\n\n \n", "é #1\x0bñ *$ |<>&%", "a a a a a", "w\x1cx y\x85z", "p q r s p q t p q r s"]


def test_base_figures(spark):
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(ODD)], "doc_id bigint, text string, n_words string")
    got = {r.doc_id: figures(r) for r in quality.base_figures(df).collect()}
    assert got == {i: plain(t) for i, t in enumerate(ODD)}


def test_long_and_repeated_texts(spark):
    text = " ".join(f"w{i % 3000}" for i in range(60_000))
    df = spark.createDataFrame([(1, text), (1, text)], "doc_id bigint, text string")
    assert [figures(r) for r in quality.base_figures(df).collect()] == [plain(text)] * 2


def test_query_figures_ratios_and_verdicts(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = op7_quality(spark, sf).collect()
    assert {r.doc_id: figures(r) for r in got} == {i: plain(t) for i, t in docs.items()}
    assert len(got) == len(docs)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    fine = [r for r in got if not r.base_failed and r.doc_id in labels]
    assert all(r.kept for r in fine if labels[r.doc_id].quality == 1)
    bad = [r for r in fine if labels[r.doc_id].quality == 0]
    assert sum(not r.kept for r in bad) >= 0.7 * len(bad)
    # the scores against counts made by hand, by the words themselves in place of their hashes (few share a bucket)
    grams = {i: _grams(t) for i, t in docs.items()}
    trusted = {i for i, r in labels.items() if r.quality == 1 and r.toxic != 1}
    raw, good = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        if i in trusted:
            good.update(g)
    f = good.total() / raw.total()
    score = lambda g: sum(math.log((good[x] + 64 * f) / (raw[x] + 64) / f) for x in g) / len(g)
    assert all(abs(score(grams[r.doc_id]) - r.score) < 0.06 for r in got if r.n_words > 50)


def _grams(text):
    w = text.split()
    return [*w, *zip(w, w[1:])]


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "good words " * 40, "a"), (2, None, "a"), (None, "other", None), (1, "good words " * 40, "b")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 0), (2, None, None)], "doc_id bigint, quality int, toxic int")
    assert quality.judge(docs, labels).count() == 4
    assert quality.judge(docs, labels.limit(0)).where("score <> 0").count() == 0
    assert quality.judge(docs.limit(0), labels).count() == 0
