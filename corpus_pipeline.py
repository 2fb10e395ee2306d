"""A corpus from raw documents to token ids: each stage works on all rows that the one before it kept.

Each stage takes rows with nulls in any column, empty and very long texts, repeated rows, empty tables and columns of any
other name; those columns come through untouched up to the last stage, which has columns of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm import bpe, decontamination, langid, secrets, simhash
from assaykit.llm.common import table
from assaykit.llm.queries import tokenizer_file
from assaykit.session import shared_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the model learns from the rows that have a lang. Null, empty and letterless
    texts go, as no language can be told of them; repeated rows stay or go together."""
    return langid.keep(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 or more of their runs of five words), that with the smallest doc_id.

    Null and blank texts are near copies of each other. A null id counts as the greatest; of repeated rows one stays."""
    return simhash.keep_first(docs, size=5, similarity=0.8)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts stay; repeated rows stay or go together."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark. Null and empty texts stay as they are, as do repeated rows."""
    return secrets.redact(docs, secrets.train(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, their number, and the text that they decode to. A null or empty text has no ids and the empty
    text; repeated rows stay."""
    found = bpe.encode_decode(docs, tokenizer_file("byte_bpe_50k.json"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_free),
    ("secrets", without_secrets),
    ("bpe", token_ids),
]

#: SQL has none of the models and tokenizers; the tests hold each stage against a plain version.
ORACLE_SQL = None


def _done(spark: SparkSession, path: str) -> bool:
    """Whether a stage was written to its end."""
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files)


def _of_input(spark: SparkSession, sf_dir: str) -> str:
    """A name for the files of the input: their paths, sizes and times."""
    sums = []
    for name in ("documents", "benchmark"):
        files = table(spark, sf_dir, name).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        r = files.agg(F.bit_xor(F.xxhash64(*files.columns)).alias("x"), F.count("*").alias("n")).first()
        sums.append(f"{(r['x'] or 0) & 2**64 - 1:016x}{r['n']}")
    return "-".join(sums)


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The stages one after another over documents, each written to the shared folder and read again.

    A run with a folder of its own goes on after the last stage that was written there to its end for the same input files.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{folder}/{_of_input(spark, sf_dir)}" if folder else shared_path(spark, "pipeline")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        if not _done(spark, path):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
