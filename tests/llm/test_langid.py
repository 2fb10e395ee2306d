from binascii import crc32

from assaykit.llm import langid
from assaykit.llm.queries import op3_language


def test_held_out_accuracy_and_calibration(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = op3_language(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.98 * len(held)
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held)
    assert abs(sum(r.score for r in held) / len(held) - right) < 0.05
    assert all(0 <= r.score <= 1 for r in got)


def test_weights_are_sparse_and_lang_of_held_out_rows_is_not_used(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    train = docs.where(~langid.held_out())
    model = langid.fit(train)
    again = langid.fit(train.repartition(7))
    assert (model.table == again.table).all() and model.temperature == again.temperature
    assert (model.table == 0).mean() > 0.2


def test_odd_rows(spark):
    rows = [(i, f"the cat and the dog {i} went home", "en", "x") for i in range(30)] + [(100 + i, f"le chat et le chien {i} sont la", "fr", "x") for i in range(30)]
    rows += [(200, None, "en", None), (201, "", "fr", None), (202, "123 !!", None, None), (None, "the dog", "en", None), (0, "the cat and the dog 0 went home", "en", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")
    model = langid.fit(df)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, model).collect()}
    assert got[200] == got[201] == got[202] == ("und", 0.0)
    assert got[None][0] == "en" and got[5][0] == "en" and got[105][0] == "fr"
    assert langid.predict(df, model).count() == len(rows)
    long = "le chat et le chien " * 120_000
    assert model.predict(long)[0] == "fr"
    empty = langid.fit(df.limit(0))
    assert empty.predict("the dog") == ("und", 0.0)
    kept = langid.keep(df, model)
    assert kept.columns == df.columns and not {200, 201, 202} & {r.doc_id for r in kept.collect()}
    assert langid.predict(df.limit(0), model).count() == 0
