"""Write-side operators, as DataFrames of the table after the change."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _same(a: DataFrame, b: DataFrame, keys: list[str]):
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"__{k}"]) for k in keys])


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """target with the changed rows in place of those with equal keys (nulls equal); of repeated keys the last by order."""
    if order:
        w = Window.partitionBy(*keys).orderBy(F.desc(order))
        changes = changes.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    marks = changes.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    return target.join(marks, _same(target, marks, keys), "left_anti").unionByName(changes.select(target.columns))


def replace_children(children: DataFrame, parents: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """children with all those of the changed parents replaced by new ones, as a set."""
    return children.join(parents.select(key).distinct(), key, "left_anti").unionByName(new.select(children.columns))


def cache_apply(cache: DataFrame, requests: DataFrame) -> DataFrame:
    """(key, hits, is_new) after requests (key): a key's first request creates it, the others are hits."""
    asked = requests.groupBy("key").agg(F.count("*").alias("n"))
    rows = cache.select("key", "hits").join(asked, "key", "full")
    new = F.col("hits").isNull()
    return rows.select("key", F.when(new, F.col("n") - 1).otherwise(F.col("hits") + F.coalesce("n", F.lit(0))).alias("hits"), new.alias("is_new"))


def get_or_create(target: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, id, created) of each distinct key of new: the target's row, else the first new one by order."""
    w = Window.partitionBy(*keys).orderBy(order)
    first = new.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").select(*keys, F.col("id").alias("new_id"))
    have = target.groupBy(*keys).agg(F.min("id").alias("old_id"))
    return first.join(have, keys, "left").select(*keys, F.coalesce("old_id", "new_id").alias("id"), F.col("old_id").isNull().alias("created"))


def idempotent(existing: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, result): replay for a known key with the same hash, conflict with another, else create; within the
    batch the first request of a key by id counts as known to the later ones. Both: (tenant, key, hash)."""
    w = Window.partitionBy("tenant", "key").orderBy("request_id")
    have = existing.select("tenant", "key", F.col("hash").alias("known"))
    rows = requests.withColumn("first", F.first("hash").over(w)).withColumn("n", F.row_number().over(w)).join(have, ["tenant", "key"], "left")
    against = F.coalesce("known", F.when(F.col("n") > 1, F.col("first")))
    return rows.select("request_id", F.when(against.isNull(), "create").when(against == F.col("hash"), "replay").otherwise("conflict").alias("result"))


def apply_decisions(runs: DataFrame, decisions: DataFrame) -> DataFrame:
    """(decision_id, accepted, error, new_status, is_override, labels) of decisions (decision_id, run_id, action, reason)
    on runs (run_id, status, shown_id). Only held and passed runs can be decided. An override approves a held run (with a
    reason of 3 characters and a candidate) or rejects a passed one; approving labels all dimensions, rejecting the whole.
    """
    rows = decisions.join(runs.select("run_id", "status", "shown_id"), "run_id", "left")
    held, passed = F.col("status") == "held", F.col("status") == "passed"
    approve = F.col("action") == "approve"
    error = (
        F.when(F.col("status").isNull(), "not_found")
        .when(~(held | passed), "not_decidable")
        .when(approve & held & (F.length(F.trim(F.coalesce("reason", F.lit("")))) < 3), "reason_required")
        .when(approve & held & F.col("shown_id").isNull(), "no_candidate")
    )
    override = (approve & held) | (~approve & passed)
    ok = error.isNull()
    return rows.select(
        "decision_id", ok.alias("accepted"), error.alias("error"), F.when(ok, F.when(approve, "approved").otherwise("rejected")).alias("new_status"), (ok & override).alias("is_override"),
        F.when(ok & override, F.when(approve, "all").otherwise("overall")).alias("labels"),
    )


def append_events(log: DataFrame, new: DataFrame) -> DataFrame:
    """(run_id, seq, event_id) of new events (run_id, event_id), numbered from each run's last; those the log has (by
    event_id) are left out."""
    fresh = new.join(log.select("event_id"), "event_id", "left_anti").dropDuplicates(["event_id"])
    last = log.groupBy("run_id").agg(F.max("seq").alias("last"))
    w = Window.partitionBy("run_id").orderBy("event_id")
    return fresh.withColumn("n", F.row_number().over(w)).join(last, "run_id", "left").select("run_id", (F.coalesce("last", F.lit(0)) + F.col("n")).cast("long").alias("seq"), "event_id")


def snapshot_merge(old: DataFrame, new: DataFrame, keep_existing: bool = True) -> DataFrame:
    """(key, output) of both snapshots; of a key in both the old output stays, or the new one."""
    a, b = old.select("key", F.col("output").alias("o")), new.select("key", F.col("output").alias("n"))
    return a.join(b, "key", "full").select("key", F.coalesce("o", "n").alias("output") if keep_existing else F.coalesce("n", "o").alias("output"))


def replay(keys: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(key, output) of each key; keys that the snapshot lacks are an error that names the first five."""
    missing = [r[0] for r in keys.select("key").distinct().join(snapshot, "key", "left_anti").orderBy("key").limit(5).collect()]
    if missing:
        raise KeyError(f"not in the snapshot: {', '.join(map(str, missing))}")
    return keys.join(snapshot, "key")
