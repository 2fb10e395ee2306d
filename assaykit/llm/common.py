"""What the operators of this package share."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """fn on each Arrow batch; long texts come in batches of few rows (see batch_rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def words(text) -> F.Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text column; null gives an empty array."""
    plain = F.coalesce(text, F.lit(""))
    for c in BLANKS[1:]:  # translate() would look up each character
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(plain, " ", -1), "")


def quiet_tokenizers() -> None:
    """One thread for each task: Spark already runs a task on every core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


def bounded_sample(df: DataFrame, most: int, total: int, *key: str) -> DataFrame:
    """About `most` of the `total` rows of df, those with the smallest hashes of key; all of them if there are fewer."""
    if total <= most:
        return df
    return df.where(F.pmod(F.xxhash64(*key), F.lit(1 << 30)) < F.lit(int((1 << 30) * most / total)))
