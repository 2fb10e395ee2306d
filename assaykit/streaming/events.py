"""The event log of runs: parsing, replay, folding, timelines, stale runs; as batch functions and as streams.

Order is seq within a run, not time. Duplicates are harmless: (run_id, seq) names an event.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: The types of events.
TYPES = ["run.created", "plan.done", "candidate.created", "candidate.evaluated", "repair.planned", "fallback", "run.held", "run.failed", "run.finished"]


def parse_events(raw: DataFrame, column: str = "value") -> DataFrame:
    """(run_id, seq, type, payload) of lines of JSON; those without a known type and a numeric seq are left out."""
    parsed = raw.select(F.from_json(column, "run_id bigint, seq string, type string, payload string").alias("e")).select("e.*")
    return parsed.withColumn("seq", F.expr("try_cast(seq AS bigint)")).where(F.col("type").isin(TYPES) & F.col("seq").isNotNull() & F.col("run_id").isNotNull())


def dropped_events(raw: DataFrame, column: str = "value") -> DataFrame:
    """How many lines parse_events() leaves out."""
    parsed = F.from_json(column, "run_id bigint, seq string, type string, payload string")
    rows = raw.select(parsed.alias("e")).select("e.run_id", F.expr("try_cast(e.seq AS bigint)").alias("seq"), "e.type")
    good = F.col("type").isin(TYPES) & F.col("seq").isNotNull() & F.col("run_id").isNotNull()
    return rows.agg(F.count("*").alias("lines"), F.count_if(~F.coalesce(good, F.lit(False))).alias("dropped"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Files of lines as a stream."""
    return spark.readStream.format("text").load(path)


def replay_after(events: DataFrame, run_id: int | None, last: int) -> DataFrame:
    """Events of a run (or of every run) after an offset, in order; those after its end are carried on."""
    if last < 0:
        raise ValueError(f"no such offset: {last}")
    rows = events.where(F.col("seq") > last)
    return (rows if run_id is None else rows.where(F.col("run_id") == run_id)).orderBy("run_id", "seq")


def dedup_events(events: DataFrame, strict: bool = False, arrival: str | None = None) -> DataFrame:
    """Each (run_id, seq) once. strict: an event whose seq is not above all that arrived before it in its run goes too;
    arrival is the column that tells the order."""
    if not strict:
        return events.dropDuplicates(["run_id", "seq"])
    w = Window.partitionBy("run_id").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("__m", F.max("seq").over(w)).where(F.col("__m").isNull() | (F.col("seq") > F.col("__m"))).drop("__m")


def fold_runs(events: DataFrame) -> DataFrame:
    """State of each run from its events, whatever their order and however often: last seq and type, counts of
    candidates, evaluations and repairs, open repairs (those no candidate followed), status."""
    once = dedup_events(events)
    is_type = lambda t: F.col("type") == t
    w = Window.partitionBy("run_id").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    later = F.max(F.when(is_type("candidate.created"), F.col("seq"))).over(w)
    rows = once.withColumn("followed", later.isNotNull())
    folded = rows.groupBy("run_id").agg(
        F.max("seq").alias("last_seq"),
        F.max_by("type", "seq").alias("last_type"),
        F.count("*").alias("events"),
        F.count_if(is_type("candidate.created")).alias("candidates"),
        F.count_if(is_type("candidate.evaluated")).alias("evaluations"),
        F.count_if(is_type("repair.planned")).alias("repairs"),
        F.count_if(is_type("repair.planned") & ~F.col("followed")).alias("open_repairs"),
        F.bool_or(is_type("run.finished")).alias("finished"),
        F.bool_or(is_type("run.failed")).alias("failed"),
    )
    status = F.when(F.col("finished"), "finished").when(F.col("failed"), "failed").otherwise("active")
    return folded.select("run_id", "last_seq", "last_type", "events", "candidates", "evaluations", "repairs", "open_repairs", status.alias("status"))


STATE = "run_id bigint, last_seq bigint, events bigint, candidates bigint, repairs bigint, status string"


class RunFolder(StatefulProcessor):
    """Folds one run's events as they come; an event that is already in is ignored, a late one is put in its place.

    Kept of a run are its counts, the number up to which it has every event, and those beyond that number: nothing
    more once a run is whole, so copies are known at any time without keeping what was read.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.beyond = handle.getMapState("beyond", "seq bigint", "here boolean")
        self.totals = handle.getValueState("totals", "upto bigint, last bigint, events bigint, candidates bigint, repairs bigint, finished boolean, failed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        upto, last, events, candidates, repairs, finished, failed = self.totals.get() if self.totals.exists() else (0, None, 0, 0, 0, False, False)
        for pdf in rows:
            for seq, kind in zip(map(int, pdf["seq"].tolist()), pdf["type"].tolist()):
                if 1 <= seq <= upto or self.beyond.containsKey((seq,)):
                    continue
                self.beyond.updateValue((seq,), (True,))
                while self.beyond.containsKey((upto + 1,)):
                    upto += 1
                    self.beyond.removeKey((upto,))
                last = seq if last is None else max(last, seq)
                events += 1
                candidates += kind == "candidate.created"
                repairs += kind == "repair.planned"
                finished, failed = finished or kind == "run.finished", failed or kind == "run.failed"
        self.totals.update((upto, last, events, candidates, repairs, finished, failed))
        status = "finished" if finished else "failed" if failed else "active"
        yield pd.DataFrame([(int(key[0]), last, events, candidates, repairs, status)], columns=["run_id", "last_seq", "events", "candidates", "repairs", "status"])

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame) -> DataFrame:
    """fold_runs() as a stream: the state of each run that a batch touches. Needs the RocksDB state store."""
    return events.groupBy("run_id").transformWithStateInPandas(statefulProcessor=RunFolder(), outputStructType=STATE, outputMode="Update", timeMode="None")


def merge_snapshot(snapshot: DataFrame, events: DataFrame) -> DataFrame:
    """(run_id, last_seq, status): a snapshot moved on by events after it; older events never roll it back."""
    newer = events.join(snapshot.select("run_id", F.col("last_seq").alias("at")), "run_id", "left").where(F.col("at").isNull() | (F.col("seq") > F.col("at")))
    folded = fold_runs(newer.select("run_id", "seq", "type")).select("run_id", F.col("last_seq").alias("n_seq"), F.col("status").alias("n_status"))
    rows = snapshot.select("run_id", "last_seq", "status").join(folded, "run_id", "full")
    done = F.col("status").isin("finished", "failed")
    return rows.select("run_id", F.greatest("last_seq", "n_seq").alias("last_seq"), F.when(done, F.col("status")).otherwise(F.coalesce("n_status", "status")).alias("status"))


def timeline(events: DataFrame) -> DataFrame:
    """Steps of each run (plan, generate, evaluate, repair): first and last seq, number of events, state. A step without
    events is skipped where the run has ended, else pending; one with events is done unless the run's last event is its."""
    steps = {"plan.done": "plan", "run.created": "plan", "candidate.created": "generate", "candidate.evaluated": "evaluate", "repair.planned": "repair", "fallback": "repair"}
    name = F.create_map(*[F.lit(x) for kv in steps.items() for x in kv])
    once = dedup_events(events).withColumn("step", F.try_element_at(name, F.col("type")))
    ends = once.groupBy("run_id").agg(F.max_by("step", "seq").alias("last_step"), F.bool_or(F.col("type").isin("run.finished", "run.failed", "run.held")).alias("ended"), F.bool_or(F.col("type") == "run.failed").alias("broken"))
    grid = ends.select("*", F.explode(F.array(*map(F.lit, ("plan", "generate", "evaluate", "repair")))).alias("step"))
    spans = once.where(F.col("step").isNotNull()).groupBy("run_id", "step").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n"))
    rows = grid.join(spans, ["run_id", "step"], "left")
    running = F.coalesce(F.col("last_step") == F.col("step"), F.lit(False)) & ~F.col("ended")
    state = F.when(F.col("n").isNull(), F.when(F.col("ended"), "skipped").otherwise("pending")).when(running, "running").otherwise("done")
    return rows.select("run_id", "step", "first_seq", "last_seq", F.coalesce("n", F.lit(0)).alias("n"), state.alias("state"))


def step_durations(events: DataFrame) -> DataFrame:
    """Milliseconds that each run spends until the next event, by type. events: (run_id, seq, type, at_ms)."""
    w = Window.partitionBy("run_id").orderBy("seq")
    return dedup_events(events).withColumn("ms", F.lead("at_ms").over(w) - F.col("at_ms")).groupBy("run_id", "type").agg(F.sum("ms").alias("ms"))


def sessions(beats: DataFrame, gap: str = "60 seconds") -> DataFrame:
    """Runs of activity of each run with pauses of less than the gap: (run_id, beats, start, stop). A run is stale once
    its last session is over."""
    rows = beats.groupBy("run_id", F.session_window("created_at", gap).alias("s")).agg(F.count("*").alias("beats"))
    return rows.select("run_id", "beats", F.unix_micros(F.col("s.start")).alias("start"), F.unix_micros(F.col("s.end")).alias("stop"))


def mark_stale(runs: DataFrame, beats: DataFrame, now: str, limit_s: int = 60) -> DataFrame:
    """(run_id, status): active runs whose last beat is older than the limit become interrupted; others stay."""
    last = beats.groupBy("run_id").agg(F.max("created_at").alias("beat"))
    rows = runs.join(last, "run_id", "left")
    old = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.coalesce("beat", "created_at")) > limit_s * 1_000_000
    return rows.select("run_id", F.when(F.col("status").isin("queued", "generating", "evaluating") & old, "interrupted").otherwise(F.col("status")).alias("status"))


def spend_by_day(calls: DataFrame, late: str = "1 hour") -> DataFrame:
    """Spend of each UTC day; on a stream, rows later than `late` behind the newest are let go."""
    rows = calls.withWatermark("created_at", late) if calls.isStreaming else calls
    out = rows.groupBy(F.window("created_at", "1 day").alias("w")).agg(F.sum("est_cost_usd").alias("spend"), F.count("*").alias("calls"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), F.round("spend", 6).alias("spend"), "calls")


def calls_by_hour(calls: DataFrame, step: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Calls of each run in each sliding hour."""
    rows = calls.withWatermark("created_at", late) if calls.isStreaming else calls
    out = rows.groupBy("run_id", F.window("created_at", "1 hour", step).alias("w")).agg(F.count("*").alias("calls"))
    return out.select("run_id", F.unix_seconds("w.start").alias("start"), "calls")


def metrics_stream(outcomes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Counts of outcomes by dimension, a delta for each micro-batch in a folder of its own, so that a batch that runs
    again replaces what it wrote. read_metrics() sums them."""

    def put(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("dimension").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "fn", "tn")])
        counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return outcomes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("dimension").agg(*[F.sum(o).alias(o) for o in ("tp", "fp", "fn", "tn")])
