"""Readers and writers of the data set's files. Every reader has a schema; nothing is inferred."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaykit import schemas

#: How verdicts are written in label files.
YES, NO = ("pass", "ok", "1", "true", "yes", "y", "p"), ("fail", "0", "false", "no", "n", "f")
LABEL_DIMENSIONS = ("technical", "text", "product", "context", "composition")


def read_manifest(spark: SparkSession, path: str, schema: str = schemas.OUTPUTS) -> DataFrame:
    """Lines of JSON, blank ones skipped; a bad line is an error; a missing file is an empty table. A missing aspect
    ratio is 1:1; codes such as NO stay text."""
    try:
        rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return rows.withColumn("aspect_ratio", F.coalesce("aspect_ratio", F.lit("1:1"))) if "aspect_ratio" in rows.columns else rows


def verdict(col: Column) -> Column:
    word = F.lower(F.trim(col))
    return F.when(word.isin(*YES), True).when(word.isin(*NO), False)


def read_labels(spark: SparkSession, path: str, schema: str = schemas.LABELS) -> DataFrame:
    """Label files with a header and perhaps a byte-order mark: verdicts in any of their spellings, rows without an
    image left out, of rows with one (image, set) the last; an empty rubric version is 1."""
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("encoding", "UTF-8").csv(path)
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = rows.withColumn("__at", place)
    names = [c for c in LABEL_DIMENSIONS if c in rows.columns]
    rows = rows.withColumns({c: verdict(F.col(c)) for c in names} | {"image_sha": F.trim(F.regexp_replace("image_sha", "^﻿", "")), "rubric_version": F.coalesce(F.nullif(F.trim("rubric_version"), F.lit("")), F.lit("1"))})
    w = Window.partitionBy("image_sha", "set").orderBy(F.desc("__at"))
    return rows.where(F.coalesce(F.col("image_sha"), F.lit("")) != "").withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__at")


def write_labels(labels: DataFrame, path: str) -> None:
    """Label files in order of (brief, set, image), with fixed columns, nulls empty."""
    columns = [c.split()[0].strip("`") for c in schemas.LABELS.replace("\n", " ").split(",")]
    rows = labels.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in labels.columns else F.lit(None).cast("string").alias(c) for c in columns])
    rows.orderBy("brief_id", "set", "image_sha").write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_manifest(rows: DataFrame, path: str, *order: str) -> None:
    rows.orderBy(*order).write.mode("overwrite").json(path)


def write_report(report: DataFrame, folder: str, name: str, reset: bool = False) -> None:
    """A report as one JSON document for each row, under its name and as the latest; as the baseline only the first
    time or on reset."""
    document = report.select(F.to_json(F.struct(*report.columns)).alias("value")).coalesce(1)
    document.write.mode("overwrite").text(f"{folder}/{name}")
    document.write.mode("overwrite").text(f"{folder}/latest")
    document.write.mode("overwrite" if reset else "ignore").text(f"{folder}/baseline")


def project_dataset(runs: DataFrame, items: DataFrame, known_runs: DataFrame, known_items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files put into tables: rows that the tables have (by id) are replaced, others added; a second time adds nothing."""
    from assaykit.operators.writes import upsert

    return upsert(known_runs, runs.dropDuplicates(["id"]), ["id"]), upsert(known_items, items.dropDuplicates(["id"]), ["id"])
