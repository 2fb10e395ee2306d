import pytest

import corpus_pipeline as P
from assaykit.llm import decontamination, secrets
from assaykit.llm.queries import tokenizer_file


def holds_an_item(text, bench):
    """Tiles of each item, one by one, over the whole text."""
    words = decontamination.Words()
    ids = words.ids(text)
    seeds = set(decontamination.rolling(ids, 5).tolist())
    for _, item in bench:
        own = words.ids(item)
        if seeds & set(decontamination.rolling(own, 5).tolist()) and sum(n for *_, n in decontamination.tile(own, ids)) >= 0.8 * len(own):
            return True
    return False


def test_stages_one_after_another(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "bpe"]
    out = {}
    for name, stage in P.STAGES:
        out[name] = stage(spark, docs, sf_dir).cache()
        if name != "bpe":
            assert out[name].columns == docs.columns
            docs = out[name]
    all_rows = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    told = {r.doc_id for r in out["language"].collect()}
    assert told == set(all_rows)  # every text has a language here
    kept = {r.doc_id for r in out["near_duplicates"].collect()}
    texts = {}
    for i in sorted(all_rows):
        texts.setdefault(all_rows[i].text, i)
    assert kept <= set(texts.values()) and len(kept) > 0.8 * len(texts)
    assert {r.doc_id for r in out["decontamination"].collect()} == {i for i in kept if not holds_an_item(all_rows[i].text, bench)}
    clean = {r.doc_id: r.text for r in out["secrets"].collect()}
    assert len(clean) == out["decontamination"].count() and not any(secrets.base_spans(t) for t in clean.values())
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    for r in out["bpe"].collect():
        assert r.text == clean[r.doc_id] and list(r.ids) == t.encode(clean[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_run_and_empty_table(spark, sf_dir, tmp_path):
    rows = P.run(spark, sf_dir)
    assert rows.columns == ["doc_id", "n_tokens", "ids", "text"] and rows.count() > 0
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_in_each_stage(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).withColumns({"__id": F.lit(1), "node": F.lit("x"), "coverage": F.lit(0.5), "base": F.lit("b")})
    one = docs.limit(1)
    nulls = one.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema])
    empty = one.withColumns({"text": F.lit(""), "doc_id": F.lit(-5).cast("bigint")})
    long = one.withColumns({"text": F.repeat(F.lit("the words of a long text "), 100_000), "doc_id": F.lit(-6).cast("bigint")})
    odd = docs.unionByName(docs.limit(5)).unionByName(nulls).unionByName(empty).unionByName(long)
    n = odd.count()
    kept = {}
    for name, stage in P.STAGES:
        got = stage(spark, odd, sf_dir)
        kept[name] = got.count()
        assert got.columns == (odd.columns if name != "bpe" else ["doc_id", "n_tokens", "ids", "text"]), name
    assert kept["language"] == n - 2  # no letter in the null and the empty text
    assert kept["near_duplicates"] <= n - 6 and kept["decontamination"] <= n and kept["secrets"] == kept["bpe"] == n


def test_a_broken_run_goes_on(spark, sf_dir, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/run"
    small = f"{tmp_path}/sf"
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(80).write.parquet(f"{small}/{name}.parquet")

    def broken(spark, docs, sf_dir):
        raise RuntimeError("an executor too many was lost")

    stages = P.STAGES
    monkeypatch.setattr(P, "STAGES", [*stages[:1], ("near_duplicates", broken), *stages[2:]])
    with pytest.raises(RuntimeError):
        P.run(spark, small, folder)
    monkeypatch.setattr(P, "STAGES", [("language", broken), *stages[1:]])
    assert P.run(spark, small, folder).count() > 0


def test_another_input_in_the_same_folder(spark, sf_dir, tmp_path):
    folder = f"file://{tmp_path}/run"
    for name in ("documents", "benchmark"):
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        rows.limit(30).write.parquet(f"{tmp_path}/a/{name}.parquet")
        rows.limit(0).write.parquet(f"{tmp_path}/b/{name}.parquet")
    assert P.run(spark, f"{tmp_path}/a", folder).count() > 0
    assert P.run(spark, f"{tmp_path}/b", folder).count() == 0
    assert P.run(spark, f"{tmp_path}/a", folder).count() > 0
