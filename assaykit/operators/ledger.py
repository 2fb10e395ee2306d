"""The ledger of model calls: prices, spend, budgets, rates, and state that depends on what was let through before."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.operators.runs import _rank_of


def ops_summary(calls: DataFrame, window: int = 2000) -> DataFrame:
    """One row over the newest `window` calls. Percentiles are of ok and uncached calls, rates of all."""
    rows = calls.orderBy(F.desc("created_at"), F.desc("call_id")).limit(window)
    live = (F.col("status") == "ok") & ~F.col("cached")
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    out = rows.agg(
        F.count("*").alias("calls"),
        F.round(F.sum("est_cost_usd"), 6).alias("total_cost"),
        F.round(F.avg("est_cost_usd"), 6).alias("mean_cost"),
        share(F.col("cached")).alias("cache_rate"),
        share(F.col("fallback_used")).alias("fallback_rate"),
        share(F.col("status") != "ok").alias("error_rate"),
        F.array_sort(F.collect_list(F.when(live, F.col("latency_ms")))).alias("l"),
    )
    return out.withColumns({"p50_ms": _rank_of("l", 0.5), "p95_ms": _rank_of("l", 0.95)}).drop("l")


def ledger_breakdown(calls: DataFrame) -> DataFrame:
    """For each kind: calls, uncached calls and their linear p50 and p95, calls per run, cache rate, spend."""
    live = F.when(~F.col("cached"), F.col("latency_ms"))
    kinds = calls.groupBy("kind").agg(
        F.count("*").alias("calls"), F.count(live).alias("uncached"), F.round(F.percentile(live, 0.5), 3).alias("p50_ms"), F.round(F.percentile(live, 0.95), 3).alias("p95_ms"),
        F.round(F.avg(F.col("cached").cast("int")), 6).alias("cache_rate"), F.round(F.sum("est_cost_usd"), 6).alias("spend"),
    )
    runs = calls.groupBy("kind", "run_id").agg(F.count("*").alias("n")).groupBy("kind").agg(F.round(F.avg("n"), 6).alias("mean_per_run"), F.max("n").alias("max_per_run"))
    return kinds.join(runs, "kind")


def run_cost(calls: DataFrame, runs: DataFrame, exclude_kind: str | None = None) -> DataFrame:
    """Ledger cost of each of runs (run_id); 0 where it has no calls."""
    kept = calls if exclude_kind is None else calls.where(F.col("kind") != exclude_kind)
    spent = kept.groupBy("run_id").agg(F.sum("est_cost_usd").alias("c"))
    return runs.select("run_id").distinct().join(spent, "run_id", "left").select("run_id", F.round(F.coalesce("c", F.lit(0.0)), 6).alias("cost"))


def daily_budget(calls: DataFrame, cap: float) -> DataFrame:
    """Spend of each UTC day against the cap, and the seconds from the day's last call to its end."""
    day = F.date_trunc("day", "created_at")
    rows = calls.groupBy(day.alias("d")).agg(F.round(F.sum("est_cost_usd"), 6).alias("spend"), F.max("created_at").alias("at"))
    left = F.lit(86400) - (F.unix_seconds("at") - F.unix_seconds("d"))
    return rows.select(F.date_format("d", "yyyy-MM-dd").alias("day"), "spend", (F.col("spend") > cap).alias("over"), left.alias("resets_in_s"))


def price_calls(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of each call (call_id, model, unit_type, units) by the price whose prefix of the model is the longest of
    its unit type; 0 where none fits; prices of tokens are for a million. prices: (prefix, unit_type, price), gathered
    to one list for each unit type, from which each call takes its price in place."""
    listed = F.sort_array(F.collect_list(F.struct(F.length("prefix").alias("n"), "prefix", "price")), asc=False)
    p = prices.groupBy(F.col("unit_type").alias("p_unit")).agg(listed.alias("list"))
    fits = F.filter("list", lambda x: F.startswith(F.col("model"), x["prefix"]))
    rows = calls.join(p, F.col("unit_type") == F.col("p_unit"), "left").withColumn("price", F.get(fits, F.lit(0))["price"])
    scale = F.when(F.col("unit_type") == "tokens", 1_000_000).otherwise(1)
    return rows.select("call_id", F.round(F.coalesce(F.col("units") * F.col("price") / scale, F.lit(0.0)), 8).alias("cost"))


def demand(calls: DataFrame, key: str, window_s: int = 3600) -> DataFrame:
    """Calls of each key in the window_s seconds up to and with each call."""
    at = F.unix_micros("created_at")
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-window_s * 1_000_000 + 1, 0)
    return calls.select("call_id", key, F.count("*").over(w).alias("in_window"))


def _walk(rows: DataFrame, by: list[str], schema: str, start: Callable[[tuple], dict], step: Callable[[dict, tuple], tuple]) -> DataFrame:
    """step() over the rows of each key in order of at and call_id. Rows stream through their partition; only the state
    of the key at hand is held. rows: the columns of by, at, call_id, then what step needs; step sees those from at on."""
    width = len(by)
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in fields])

    def run(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if state is None or row[:width] != key:
                    key, state = row[:width], start(row[width:])
                out.append(step(state, row[width:]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)] if out else [pa.array([], f.type) for f in arrow], schema=arrow)

    return rows.repartition(*by).sortWithinPartitions(*by, "at", "call_id").mapInArrow(run, schema)


def rate_limit(calls: DataFrame, key: str, most: int, window_s: int = 3600) -> DataFrame:
    """(call_id, admitted, retry_after): at most `most` admitted calls of a key in any window. Only admitted calls hold
    slots, so a call depends on those before it: state of one key, its admitted times of the last window."""
    rows = calls.select(F.col(key).alias("key"), F.unix_micros("created_at").alias("at"), "call_id")
    window = window_s * 1_000_000

    def admit(state: dict, row: tuple) -> tuple:
        at, call = row
        held = state["held"] = [h for h in state["held"] if at - h < window]
        if len(held) < most:
            held.append(at)
            return call, True, None
        return call, False, -((at - held[0] - window) // 1_000_000)

    return _walk(rows, ["key"], "call_id bigint, admitted boolean, retry_after bigint", lambda row: {"held": []}, admit)


def budget_walk(calls: DataFrame, cap: float, most: int, deadline_ms: int, warn: float = 0.8) -> DataFrame:
    """(call_id, blocked_by, warned, spent): calls of a run in order; a call is blocked by deadline, calls or budget, in
    that order, and then spends nothing. warned marks the one call that first reaches the warning share of the cap, a product
    of decimals: 0.8 of 1.5 is 1.2, which the product of doubles is above."""
    limit = float(Decimal(str(warn)) * Decimal(str(cap)))
    rows = calls.select("run_id", F.unix_micros("created_at").alias("at"), "call_id", F.coalesce(F.col("est_cost_usd").cast("double"), F.lit(0.0)).alias("cost"))

    def spend(state: dict, row: tuple) -> tuple:
        at, call, cost = row
        spent = state["spent"] + cost
        reason = "deadline" if at - state["start"] > deadline_ms * 1000 else "calls" if state["n"] >= most else "budget" if spent > cap + 1e-9 else None
        now = reason is None and not state["warned"] and spent >= limit
        if reason is None:
            state |= {"spent": spent, "n": state["n"] + 1, "warned": state["warned"] or now}
        return call, reason, now, round(state["spent"], 6)

    return _walk(rows, ["run_id"], "call_id bigint, blocked_by string, warned boolean, spent double", lambda row: {"start": row[0], "spent": 0.0, "n": 0, "warned": False}, spend)


#: Seconds of the slots that a key's calls are split by, so that a busy key isn't one task.
SLOT_S = 86_400


def _carried(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """rows with what slots (key, slot, ...) holds for their slot; slots is a row for each key and slot."""
    names = [c for c in slots.columns if c not in ("key", "slot")]
    s = slots.select(F.col("key").alias("__k"), F.col("slot").alias("__s"), *names)
    return rows.join(s, F.col("key").eqNullSafe(F.col("__k")) & (F.col("slot") == F.col("__s")), "left").drop("__k", "__s")


def failure_streaks(calls: DataFrame, key: str = "model") -> DataFrame:
    """Length of the run of failures that ends at each failed call of a key: where a breaker would open. Runs are
    counted within a key's slots of time; what is open at a slot's end is carried to the next."""
    rows = calls.select("call_id", F.col(key).alias("key"), F.unix_micros("created_at").alias("at"), "status").withColumn("slot", F.floor(F.col("at") / (SLOT_S * 1_000_000)))
    inside = Window.partitionBy("key", "slot").orderBy("at", "call_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("island", F.sum((F.col("status") == "ok").cast("int")).over(inside))
    here = Window.partitionBy("key", "slot", "island").orderBy("at", "call_id").rowsBetween(Window.unboundedPreceding, 0)
    bad = F.col("status") == "error"
    ends = rows.groupBy("key", "slot", "island").agg(F.count_if(bad).alias("n")).groupBy("key", "slot").agg(F.max_by("n", "island").alias("n"), (F.max("island") > 0).alias("cut"))
    order = Window.partitionBy("key").orderBy("slot")
    ends = ends.withColumn("era", F.sum(F.col("cut").cast("int")).over(order))
    ends = ends.withColumn("open", F.sum("n").over(Window.partitionBy("key", "era").orderBy("slot"))).withColumn("carry", F.lag("open").over(order)).select("key", "slot", "carry")
    counted = rows.withColumn("streak", F.count_if(bad).over(here)).where(bad)
    carry = F.when(F.col("island") == 0, F.coalesce("carry", F.lit(0))).otherwise(0)
    return _carried(counted, ends).select("call_id", F.col("key").alias(key), (F.col("streak") + carry).alias("streak"))


def breaker_states(calls: DataFrame, key: str = "model", failures: int = 5, reset_s: int = 30) -> DataFrame:
    """(call_id, state): closed, open or half_open as each call finds it. After `failures` in a row it opens, after
    reset_s seconds one call is let through; its success closes, its failure opens again. A call that finds it open is
    refused and changes nothing, nor does a blocked one.

    A success without a failure in the reset_s seconds before it surely leaves the breaker closed. A key's calls are
    cut after such successes, which are found by slots of time, and each part is walked by itself.
    """
    reset = reset_s * 1_000_000
    rows = calls.select(F.col(key).alias("key"), F.unix_micros("created_at").alias("at"), "call_id", F.coalesce("status", F.lit("")).alias("status"))
    rows = rows.withColumn("slot", F.floor(F.col("at") / (max(reset_s, SLOT_S) * 1_000_000)))
    inside = Window.partitionBy("key", "slot").orderBy("at", "call_id")
    earlier = Window.partitionBy("key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    failed_at = F.when(~F.col("status").isin("ok", "blocked"), F.col("at"))
    before = rows.groupBy("key", "slot").agg(F.max(failed_at).alias("f")).select("key", "slot", F.max("f").over(earlier).alias("before"))
    rows = _carried(rows.withColumn("failed", F.max(failed_at).over(inside.rowsBetween(Window.unboundedPreceding, 0))), before)
    last = F.greatest("failed", "before")
    sure = F.when((F.col("status") == "ok") & (last.isNull() | (F.col("at") - last >= reset)), F.struct("at", "call_id"))
    rows = rows.withColumn("sure", sure)
    cuts = rows.groupBy("key", "slot").agg(F.max("sure").alias("c")).select("key", "slot", F.max("c").over(earlier).alias("cut"))
    rows = _carried(rows.withColumn("own", F.max("sure").over(inside.rowsBetween(Window.unboundedPreceding, -1))), cuts)
    part = F.coalesce("own", "cut")
    rows = rows.select("key", part["at"].alias("part_at"), part["call_id"].alias("part_id"), "at", "call_id", "status")

    def audit(state: dict, row: tuple) -> tuple:
        at, call, status = row
        opened = state["opened"]
        found = "closed" if opened is None else "half_open" if at - opened >= reset else "open"
        if found == "open" or status == "blocked":
            return call, found
        if status == "ok":
            state |= {"bad": 0, "opened": None}
        else:
            state["bad"] += 1
            if found == "half_open" or state["bad"] >= failures:
                state["opened"] = at
        return call, found

    return _walk(rows, ["key", "part_at", "part_id"], "call_id bigint, state string", lambda row: {"bad": 0, "opened": None}, audit)


def count_by(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))
