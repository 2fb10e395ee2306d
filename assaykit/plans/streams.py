"""Queries of the event log and of files, and their SQL twins. Streams run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaykit.operators import metrics as M
from assaykit.plans.evaluation import OUTCOME, items
from assaykit.plans.registry import query
from assaykit.session import shared_path
from assaykit.sources import files as S
from assaykit.sources.bridge import table, twin
from assaykit.streaming import events as R


def log(spark, sf_dir):
    return table(spark, sf_dir, "v_events").select("run_id", "seq", "type", "payload")


@query("parse_events", twin("SELECT run_id, seq, type FROM v_events WHERE run_id % 7 <> 0"))
def parse_events(spark, sf_dir):
    bad = F.when(F.col("run_id") % 7 == 0, F.lit("nonsense")).otherwise(F.col("type"))
    raw = log(spark, sf_dir).select(F.to_json(F.struct("run_id", F.col("seq").cast("string").alias("seq"), bad.alias("type"), "payload")).alias("value"))
    return R.parse_events(raw).select("run_id", "seq", "type")


@query("replay_after", twin("SELECT run_id, seq, type FROM v_events WHERE seq > 1"))
def replay_after(spark, sf_dir):
    return R.replay_after(log(spark, sf_dir), None, 1).select("run_id", "seq", "type")


@query("dedup_events", twin("SELECT run_id, seq, type FROM v_events"))
def dedup_events(spark, sf_dir):
    rows = log(spark, sf_dir).select("run_id", "seq", "type")
    return R.dedup_events(rows.unionByName(rows.where("seq % 2 = 0")))


@query(
    "dedup_events_strict",
    twin("""WITH a AS (SELECT run_id, seq, type, (seq * 7 + run_id) % 11 * 100 + seq AS arrival FROM v_events)
    SELECT run_id, seq, type FROM (SELECT *, max(seq) OVER (PARTITION BY run_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM a) x WHERE m IS NULL OR seq > m"""),
)
def dedup_events_strict(spark, sf_dir):
    rows = log(spark, sf_dir).select("run_id", "seq", "type", F.expr("(seq * 7 + run_id) % 11 * 100 + seq").alias("arrival"))
    return R.dedup_events(rows, strict=True, arrival="arrival").select("run_id", "seq", "type")


FOLD = """SELECT run_id, max(seq) AS last_seq, max_by(type, seq) AS last_type, count(*) AS events, count(*) FILTER (type = 'candidate.created') AS candidates, count(*) FILTER (type = 'candidate.evaluated') AS evaluations,
  count(*) FILTER (type = 'repair.planned') AS repairs, count(*) FILTER (type = 'repair.planned' AND seq > coalesce(last_candidate, 0)) AS open_repairs,
  CASE WHEN bool_or(type = 'run.finished') THEN 'finished' ELSE 'active' END AS status
FROM (SELECT *, max(CASE WHEN type = 'candidate.created' THEN seq END) OVER (PARTITION BY run_id) AS last_candidate FROM v_events) e GROUP BY run_id"""


@query("fold_runs", twin(FOLD))
def fold_runs(spark, sf_dir):
    rows = log(spark, sf_dir)
    return R.fold_runs(rows.unionByName(rows.where("seq % 3 = 0")))


@query("fold_stream", twin(f"SELECT run_id, last_seq, events, candidates, repairs, status FROM ({FOLD}) f"))
def fold_stream(spark, sf_dir):
    """The log as files with copies, folded by a stream with state; the last state of each run."""
    source, out, mark = (shared_path(spark, n) for n in ("log", "folded", "mark"))
    rows = log(spark, sf_dir).select("run_id", "seq", "type")
    lines = rows.unionByName(rows.where("seq % 3 = 0")).select(F.to_json(F.struct("run_id", "seq", "type")).alias("value"))
    lines.repartition(3).write.text(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = R.fold_stream(R.parse_events(R.read_log(spark, source)).select("run_id", "seq", "type"))

    def put(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}")

    stream.writeStream.outputMode("update").option("checkpointLocation", mark).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    states = spark.read.parquet(out)
    return states.groupBy("run_id").agg(*[F.max_by(c, F.struct("batch", "events")).alias(c) for c in ("last_seq", "events", "candidates", "repairs", "status")])


@query("merge_snapshot", twin("SELECT run_id, max(seq) AS last_seq, CASE WHEN bool_or(type = 'run.finished') THEN 'finished' ELSE 'active' END AS status FROM v_events GROUP BY run_id"))
def merge_snapshot(spark, sf_dir):
    rows = log(spark, sf_dir)
    early = R.fold_runs(rows.where("seq <= 4")).select("run_id", "last_seq", "status")
    return R.merge_snapshot(early, rows)


@query(
    "run_timeline",
    twin("""WITH e AS (SELECT *, CASE type WHEN 'run.created' THEN 'plan' WHEN 'candidate.created' THEN 'generate' WHEN 'candidate.evaluated' THEN 'evaluate' WHEN 'repair.planned' THEN 'repair' END AS step FROM v_events),
    r AS (SELECT run_id, max_by(step, seq) AS last_step, bool_or(type = 'run.finished') AS ended FROM e GROUP BY run_id), g AS (SELECT r.*, s.step FROM r CROSS JOIN (VALUES ('plan'), ('generate'), ('evaluate'), ('repair')) s(step)),
    n AS (SELECT run_id, step, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM e WHERE step IS NOT NULL GROUP BY run_id, step)
    SELECT g.run_id, g.step, first_seq, last_seq, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN CASE WHEN ended THEN 'skipped' ELSE 'pending' END WHEN coalesce(last_step = g.step, false) AND NOT ended THEN 'running' ELSE 'done' END AS state
    FROM g LEFT JOIN n ON g.run_id = n.run_id AND g.step = n.step"""),
)
def run_timeline(spark, sf_dir):
    return R.timeline(log(spark, sf_dir))


@query(
    "activity_sessions",
    twin("""WITH g AS (SELECT *, CAST(coalesce(epoch_us(created_at) - lag(epoch_us(created_at)) OVER (PARTITION BY run_id ORDER BY created_at) >= 21600000000, true) AS int) AS new FROM v_calls),
    s AS (SELECT *, sum(new) OVER (PARTITION BY run_id ORDER BY created_at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM g)
    SELECT run_id, count(*) AS beats, epoch_us(min(created_at)) AS start, epoch_us(max(created_at)) + 21600000000 AS stop FROM s GROUP BY run_id, island"""),
)
def activity_sessions(spark, sf_dir):
    return R.sessions(table(spark, sf_dir, "v_calls"), "6 hours")


@query(
    "mark_stale",
    twin("""SELECT r.run_id, CASE WHEN status IN ('queued', 'generating', 'evaluating') AND epoch_us(TIMESTAMP '2024-01-30 20:00:00') - epoch_us(coalesce(beat, created_at)) > 3600000000 THEN 'interrupted' ELSE status END AS status
    FROM v_runs r LEFT JOIN (SELECT run_id, max(created_at) AS beat FROM v_calls GROUP BY run_id) b ON b.run_id = r.run_id"""),
)
def mark_stale(spark, sf_dir):
    return R.mark_stale(table(spark, sf_dir, "v_runs"), table(spark, sf_dir, "v_calls"), "2024-01-30 20:00:00", 3600)


@query("spend_by_day", twin("SELECT created_day AS day, round(sum(est_cost_usd), 6) AS spend, count(*) AS calls FROM v_calls GROUP BY created_day"))
def spend_by_day(spark, sf_dir):
    return R.spend_by_day(table(spark, sf_dir, "v_calls"))


@query(
    "calls_by_hour",
    twin("""SELECT run_id, start, count(*) AS calls FROM (SELECT run_id, CAST(floor(epoch(created_at) / 1200) AS bigint) * 1200 - unnest([0, 1200, 2400]) AS start FROM v_calls) x GROUP BY run_id, start"""),
)
def calls_by_hour(spark, sf_dir):
    return R.calls_by_hour(table(spark, sf_dir, "v_calls"), "20 minutes")


@query(
    "incremental_metrics",
    twin(f"""SELECT dimension, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn, count(*) FILTER (outcome = 'tn') AS tn FROM ({OUTCOME}) o GROUP BY dimension"""),
)
def incremental_metrics(spark, sf_dir):
    """Outcomes written as files and counted by a stream, a file or two at a time."""
    source, out, mark = (shared_path(spark, n) for n in ("outcomes", "counts", "mark"))
    M.with_outcomes(items(spark, sf_dir)).select("item_id", "dimension", "outcome").repartition(4).write.parquet(source)
    stream = spark.readStream.schema("item_id bigint, dimension string, outcome string").option("maxFilesPerTrigger", 2).parquet(source)
    R.metrics_stream(stream, out, mark).awaitTermination()
    return R.read_metrics(spark, out)


@query("manifest_round_trip", "SELECT doc_id::varchar AS id, source AS product_id, '1:1' AS aspect_ratio, lang AS status FROM documents")
def manifest_round_trip(spark, sf_dir):
    path = shared_path(spark, "manifest")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("product_id"), F.struct(F.col("lang").alias("status")).alias("run"))
    S.write_manifest(rows, path, "id")
    return S.read_manifest(spark, path).select("id", "product_id", "aspect_ratio", F.col("run.status").alias("status"))


@query("label_round_trip", "SELECT doc_id::varchar AS image_sha, quality = 1 AS technical, toxic = 0 AS text, '1' AS rubric_version FROM labels")
def label_round_trip(spark, sf_dir):
    path = shared_path(spark, "labels")
    word = lambda c: F.when(F.col("doc_id") % 2 == 0, F.when(c, "Pass ").otherwise("no")).otherwise(F.when(c, "y").otherwise("0"))
    rows = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("image_sha"), F.lit("nat").alias("set"), (F.col("doc_id") % 20).cast("string").alias("brief_id"), word(F.col("quality") == 1).alias("technical"), word(F.col("toxic") == 0).alias("text")
    )
    S.write_labels(rows, path)
    return S.read_labels(spark, path).select("image_sha", "technical", "text", "rubric_version")


@query("spend_stream", twin("SELECT created_day AS day, round(sum(est_cost_usd), 6) AS spend, count(*) AS calls FROM v_calls GROUP BY created_day"))
def spend_stream(spark, sf_dir):
    """Calls as files, summed by day on a stream with a watermark."""
    source, out, mark = (shared_path(spark, n) for n in ("calls", "spend", "mark"))
    rows = table(spark, sf_dir, "v_calls").select("created_at", "est_cost_usd")
    rows.repartition(3).write.parquet(source)
    stream = R.spend_by_day(spark.readStream.schema(rows.schema).parquet(source))

    def put(batch, number):
        batch.write.mode("overwrite").parquet(out)

    stream.writeStream.outputMode("complete").option("checkpointLocation", mark).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.parquet(out)


@query("report_round_trip", twin("SELECT item_set, version, count(*) AS n FROM v_items GROUP BY item_set, version"))
def report_round_trip(spark, sf_dir):
    """A report written as JSON documents and read from its latest copy."""
    folder = shared_path(spark, "report")
    S.write_report(items(spark, sf_dir).groupBy("item_set", "version").agg(F.count("*").alias("n")), folder, "first")
    return spark.read.schema("item_set string, version string, n bigint").json(f"{folder}/latest")


@query("project_dataset", twin("SELECT run_id AS id, status FROM v_runs UNION ALL SELECT -item_id - 1, item_set FROM v_items"))
def project_dataset(spark, sf_dir):
    """Runs and items put into tables that have half of them in an older state; the second time changes nothing."""
    runs = table(spark, sf_dir, "v_runs").select(F.col("run_id").alias("id"), "status")
    rows = table(spark, sf_dir, "v_items").select((-F.col("item_id") - 1).alias("id"), F.col("item_set").alias("status"))
    old = lambda df: df.where("id % 2 = 0").withColumn("status", F.lit("old"))
    once = S.project_dataset(runs, rows, old(runs), old(rows))
    twice = S.project_dataset(runs, rows, *once)
    return twice[0].unionByName(twice[1])
