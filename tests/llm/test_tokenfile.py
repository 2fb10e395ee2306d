from zlib import crc32

import numpy as np

from assaykit.llm import tokenfile
from assaykit.llm.queries import op5_tokens, tokenizer_file
from assaykit.session import shared_path

WORD = tokenizer_file("word_bpe_49k.json")


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    return [e.ids + [1] for e in t.encode_batch(texts, add_special_tokens=False)]


def test_round_trip_against_the_library(spark, sf_dir):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = {r.doc_id: r for r in op5_tokens(spark, sf_dir).collect()}
    start = 0
    for (doc, _), ids in zip(docs, library([t for _, t in docs])):
        r = got[doc]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(docs)


def test_odd_rows_and_random_access(spark):
    rows = [(5, "Hello it's me", 0), (2, None, 0), (None, "null id", 0), (9, "", 0), (5, "Hello it's me", 0), (3, "été, ÉTÉ ßtraße", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start int")
    folder = shared_path(spark, "t")
    counts = tokenfile.write(df, folder, WORD, 1, shards=3)
    got = tokenfile.read(spark, folder, counts).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 2, 3, 5, 5, 9]
    assert [r.n_tokens for r in got] == [len(x) for x in library(["null id", "", "été, ÉTÉ ßtraße", "Hello it's me", "Hello it's me", ""])]
    assert tokenfile.document(folder, counts[0][3], 0).tolist() == library(["null id"])[0]
    empty = shared_path(spark, "t")
    assert tokenfile.read(spark, empty, tokenfile.write(df.limit(0), empty, WORD, 1)).count() == 0
    wide = shared_path(spark, "t")
    again = tokenfile.read(spark, wide, tokenfile.write(df, wide, WORD, 1, width=4, shards=2), width=4)
    assert sorted(r.ids_crc32 for r in again.collect()) == sorted(r.ids_crc32 for r in got)


def test_rows_of_one_id_are_split_and_stale_files_are_not_read(spark):
    df = spark.range(400).selectExpr("CAST(IF(id % 4 = 0, NULL, 7) AS bigint) AS doc_id", "concat('word ', id % 90) AS text")
    folder = shared_path(spark, "t")
    stale = tokenfile.write(df.limit(50), folder, WORD, 1, shards=2)
    counts = tokenfile.write(df, folder, WORD, 1, shards=8)
    assert max(c[1] for c in counts) < 200 and {c[3] for c in counts}.isdisjoint(c[3] for c in stale)
    got = tokenfile.read(spark, folder, counts).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 100 + [7] * 300
    assert sum(r.n_tokens for r in got) == sum(map(len, library([r.text for r in df.collect()])))


def test_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "some words and more " * 20_000)], "doc_id bigint, text string")
    folder = shared_path(spark, "t")
    got = tokenfile.read(spark, folder, tokenfile.write(df, folder, WORD, 1)).first()
    ids = library(["some words and more " * 20_000])[0]
    assert (got.n_tokens, got.ids_crc32) == (len(ids), crc32(np.array(ids, "<u4").tobytes()))
