"""Runs, candidates, decisions: summaries, selection, paging, work lists."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.session import written

ACTIVE = ("queued", "generating", "evaluating")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by an order that should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def list_runs(runs: DataFrame, tenant: int, origin: str | None = None, status: str | None = None) -> DataFrame:
    out = runs.where(F.col("tenant") == tenant)
    out = out if origin is None else out.where(F.col("origin") == origin)
    return out if status is None else out.where(F.col("status") == status)


def stale_runs(runs: DataFrame, limit_s: int = 60, active: tuple[str, ...] = ACTIVE) -> DataFrame:
    """Active runs whose last sign of life (heartbeat, else creation) is older than the limit; ages in seconds."""
    return runs.where(F.col("status").isin(*active) & (F.coalesce("heartbeat_age", "created_age") > limit_s))


def page(runs: DataFrame, limit: int = 20, cursor: str | None = None) -> DataFrame:
    """The newest rows after a cursor, one more than the limit so that the caller knows whether there are others.
    Rows are ordered by (created_at, run_id), both descending."""
    limit = max(1, min(100, limit))
    if cursor is not None:
        at, run_id = read_cursor(cursor)
        t = F.lit(at).cast("timestamp")
        runs = runs.where((F.col("created_at") < t) | ((F.col("created_at") == t) & (F.col("run_id") < run_id)))
    return runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit + 1)


def make_cursor(created_at: str, run_id: int) -> str:
    return base64.urlsafe_b64encode(json.dumps([created_at, run_id]).encode()).decode()


def read_cursor(cursor: str) -> tuple[str, int]:
    try:
        at, run_id = json.loads(base64.urlsafe_b64decode(cursor.encode()))
        return str(at), int(run_id)
    except (ValueError, TypeError) as error:
        raise ValueError("malformed cursor") from error


def page_offset(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def select_best(candidates: DataFrame) -> DataFrame:
    """Of each run the passing candidate with the greatest composite, the earliest of equals. Needs passed, composite,
    attempt, slot."""
    return latest(candidates.where("passed"), ["run_id"], [F.desc("composite"), F.asc("attempt"), F.asc("slot"), F.asc("candidate_id")])


def choose_base(candidates: DataFrame) -> DataFrame:
    """Of each run the candidate to repair: the fewest failures other than text, then composite, then order. A
    technical failure counts as all of them."""
    false = lambda c: F.coalesce((~F.col(c)).cast("int"), F.lit(0))
    others = false("product_pass") + false("context_pass") + false("composition_pass")
    failures = F.when(~F.col("technical_pass"), 4).otherwise(others)
    rows = candidates.withColumn("failures", failures)
    return latest(rows, ["run_id"], [F.asc("failures"), F.desc("composite"), F.asc("attempt"), F.asc("slot"), F.asc("candidate_id")])


def nat_and_final(candidates: DataFrame, finals: DataFrame) -> DataFrame:
    """The first draft (attempt 0, lowest slot) and the final candidate of each run. finals: (run_id, candidate_id)."""
    nat = candidates.where("attempt = 0").groupBy("run_id").agg(F.min_by("candidate_id", F.struct("slot", "candidate_id")).alias("candidate_id")).withColumn("item_set", F.lit("nat"))
    return nat.unionByName(finals.select("run_id", "candidate_id").withColumn("item_set", F.lit("final")))


def run_summaries(runs: DataFrame, briefs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Runs with their brief and the candidate shown: the approved, else the best. runs carries approved_id and best_id."""
    shown = candidates.select(F.col("candidate_id").alias("shown_id"), F.col("composite"), F.col("kind"))
    rows = runs.withColumn("shown_id", F.coalesce("approved_id", "best_id"))
    return rows.join(briefs, "brief_id").join(shown, "shown_id", "left")


def run_detail(candidates: DataFrame, evaluations: DataFrame, checks: DataFrame) -> DataFrame:
    """One document for each run: its candidates in order, each with its latest evaluation and ordered checks."""
    listed = checks.groupBy(F.col("item_id").alias("candidate_id")).agg(F.array_sort(F.collect_list(F.struct("dimension", "check_name", "method", "passed"))).alias("checks"))
    newest = latest(evaluations, ["candidate_id"], [F.desc("evaluation_id")]).select("candidate_id", "version", "technical_pass", "text_pass", "product_pass", "context_pass", "composition_pass")
    dims = lambda c: F.map_concat(
        F.create_map(*[x for d in ("technical", "text", "product", "context") for x in (F.lit(d), c[f"{d}_pass"])]),
        F.when(c["composition_pass"].isNotNull(), F.create_map(F.lit("composition"), c["composition_pass"])).otherwise(F.create_map().cast("map<string,boolean>")),
    )
    rows = candidates.select("run_id", "candidate_id", "attempt", "slot").join(newest, "candidate_id", "left").join(listed, "candidate_id", "left")
    # the maps are made after the shuffle: their names would be most of it
    listed_dims = [f"{d}_pass" for d in ("technical", "text", "product", "context", "composition")]
    sort = F.array_sort(F.collect_list(F.struct("attempt", "slot", "candidate_id", "version", *listed_dims, "checks")))
    shown = lambda c: F.struct(c["attempt"], c["slot"], c["candidate_id"], c["version"], dims(c).alias("dimensions"), c["checks"])
    return rows.groupBy("run_id").agg(sort.alias("candidates")).select("run_id", F.transform("candidates", shown).alias("candidates"))


def model_fallbacks(candidates: DataFrame) -> DataFrame:
    """First candidate of each run that another model served than was asked for; overlays aside."""
    rows = candidates.where((F.col("kind") != "overlay") & (F.col("requested_model") != F.col("served_model")))
    first = F.min_by(F.struct("candidate_id", "requested_model", "served_model"), F.struct("attempt", "slot", "candidate_id")).alias("c")
    return rows.groupBy("run_id").agg(first).select("run_id", "c.*")


def image_to_run(shown: DataFrame, runs: DataFrame) -> DataFrame:
    """(image_id, run_id): the newest golden run that shows each image. shown: (image_id, run_id)."""
    golden = runs.where("origin = 'golden'").select("run_id", "created_at")
    return shown.join(golden, "run_id").groupBy("image_id").agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"))


def failing_drafts(runs: DataFrame, candidates: DataFrame) -> DataFrame:
    """First-round candidates of each brief's latest finished run that don't pass. candidates carries passed."""
    done = latest(runs.where(F.col("status").isin("approved", "passed", "held", "rejected")), ["brief_id"], [F.desc("created_at"), F.desc("run_id")])
    return candidates.where("attempt = 0").join(done.select("run_id", "brief_id"), "run_id").where(~F.coalesce("passed", F.lit(False)))


def work_list(briefs: DataFrame, runs: DataFrame, fresh_s: int = 60, force: bool = False) -> DataFrame:
    """What to do for each brief by its latest run: skip, redo, in_progress, resume or new."""
    last = latest(runs, ["brief_id"], [F.desc("created_at"), F.desc("run_id")]).select("brief_id", "run_id", "status", "heartbeat_age")
    done, redo = F.col("status").isin("approved", "passed", "held", "rejected"), F.col("status").isin("failed", "interrupted", "cancelled")
    todo = (
        F.when(F.col("status").isNull(), "new")
        .when(done, "redo" if force else "skip")
        .when(redo, "redo")
        .when(F.coalesce(F.col("heartbeat_age") < fresh_s, F.lit(False)), "in_progress")
        .otherwise("resume")
    )
    return briefs.join(last, "brief_id", "left").select("brief_id", "run_id", todo.alias("todo"))


def nearest_rank(df: DataFrame, column: str, p: float, *by: str) -> DataFrame:
    """Percentile by nearest rank: place round(p (n - 1)), half to even. Values are counted first, so that what is
    sorted are distinct values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("__c"))
    part = Window.partitionBy(*by)
    upto = part.orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({"__to": F.sum("__c").over(upto), "__n": F.sum("__c").over(part)})
    at = F.bround(F.lit(float(p)) * (F.col("__n") - 1), 0).cast("long")
    return ranked.where((at < F.col("__to")) & (at >= F.col("__to") - F.col("__c"))).select(*by, F.col(column).alias("value"))


def _rank_of(values: str, p: float) -> Column:
    """The same of a column that holds a sorted array."""
    return F.get(values, F.bround(F.lit(float(p)) * (F.size(values) - 1), 0).cast("int"))


def run_metrics(runs: DataFrame, decisions: DataFrame, evaluations: DataFrame, window: int = 1000) -> DataFrame:
    """One row over the newest `window` runs: counts, rates, cost, nearest-rank latencies, and pass rates of the
    dimensions over all their evaluations. The window bounds what is gathered for the percentiles."""
    chosen = runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(window)
    overrides = latest(decisions, ["run_id"], [F.desc("decision_id")]).where("is_override").select("run_id", F.lit(True).alias("overridden"))
    rows = chosen.join(overrides, "run_id", "left")
    finished = F.col("first_attempt_pass").isNotNull()
    rate = lambda a, b, digits=4: F.round(F.try_divide(a, b), digits)
    approved = F.col("status") == "approved"
    out = rows.agg(
        F.count("*").alias("runs"),
        F.count_if(finished).alias("finished"),
        F.count_if(approved).alias("approved"),
        rate(F.count_if(approved), F.count_if(finished)).alias("approval_rate"),
        rate(F.count_if(F.col("first_attempt_pass")), F.count_if(finished)).alias("first_attempt_rate"),
        rate(F.count_if(F.col("outcome") == "overlay"), F.count_if(F.col("outcome").isNotNull())).alias("overlay_share"),
        F.round(F.avg(F.when(finished, F.col("repair_count"))), 4).alias("mean_repairs"),
        F.count_if(approved & F.col("overridden")).alias("override_count"),
        F.round(F.sum(F.col("cost_usd").cast("double")), 6).alias("total_cost"),
        F.array_sort(F.collect_list("latency_ms")).alias("l"),
    )
    dims = evaluations.join(chosen.select("run_id"), "run_id").agg(
        *[F.round(F.avg(F.col(f"{d}_pass").cast("int")), 4).alias(f"{d}_rate") for d in ("technical", "text", "product", "context", "composition")]
    )
    return out.withColumns({"p50_ms": _rank_of("l", 0.5), "p95_ms": _rank_of("l", 0.95)}).drop("l").join(F.broadcast(dims))


def pipeline_quality(outputs: DataFrame) -> DataFrame:
    """One row over final outputs: statuses, pass rates, spend of all finals over those shipped, linear percentiles."""
    shipped = F.col("status").isin("approved", "passed")
    finished = F.col("first_attempt_pass").isNotNull()
    n = F.count_if(finished)
    return outputs.agg(
        F.count("*").alias("finals"),
        F.count_if(shipped).alias("shipped"),
        F.round(F.try_divide(F.count_if(F.col("first_attempt_pass")), n), 6).alias("first_attempt_rate"),
        F.round(F.try_divide(F.count_if(finished & shipped), n), 6).alias("after_repair_rate"),
        F.round(F.try_divide(F.count_if(F.col("outcome") == "native"), F.count_if(F.col("outcome").isNotNull())), 6).alias("native_rate"),
        F.round(F.avg("repair_count"), 6).alias("mean_repairs"),
        F.round(F.try_divide(F.sum(F.col("cost_usd").cast("double")), F.count_if(shipped)), 6).alias("cost_per_shipped"),
        F.round(F.percentile("latency_ms", 0.5), 3).alias("p50_ms"),
        F.round(F.percentile("latency_ms", 0.95), 3).alias("p95_ms"),
    )


def batch_spend(runs: DataFrame, cap: float, budget: float) -> DataFrame:
    """Spend of each batch and origin; refused when it and the reserve for one more run exceed the budget."""
    active = F.count_if(F.col("status").isin(*ACTIVE))
    rows = runs.groupBy("batch_label", "origin").agg(F.round(F.sum(F.col("cost_usd").cast("double")), 6).alias("spend"), active.alias("in_flight"))
    return rows.withColumn("refused", F.col("spend") + (F.col("in_flight") + 1) * cap > budget)


def rollup_runs(candidates: DataFrame, costs: DataFrame) -> DataFrame:
    """A run from its candidates (passed, attempt, kind, composite) and its ledger cost: first_attempt_pass, repairs,
    best candidate, outcome."""
    best = select_best(candidates).select("run_id", F.col("candidate_id").alias("best_id"), F.col("kind").alias("best_kind"))
    rows = candidates.groupBy("run_id").agg(
        F.bool_or(F.coalesce("passed", F.lit(False)) & (F.col("attempt") == 0)).alias("first_attempt_pass"), F.max("attempt").alias("repairs"), F.count("*").alias("candidates")
    )
    outcome = F.when(F.col("best_kind") == "overlay", "overlay").when(F.col("best_id").isNotNull(), "native")
    joined = rows.join(best, "run_id", "left").join(costs, "run_id", "left")
    return joined.select("run_id", "first_attempt_pass", "repairs", "candidates", "best_id", outcome.alias("outcome"), F.coalesce("cost", F.lit(0.0)).alias("cost"))


def link_runs(manifest: DataFrame, runs: DataFrame, candidates: DataFrame) -> DataFrame:
    """How each manifest row (item_id, run_id, image_id) finds its run: by id, by a candidate that shows its image, or
    not at all (create)."""
    by_id = manifest.join(runs.select(F.col("run_id").alias("known")), F.col("run_id") == F.col("known"), "left")
    shown = candidates.groupBy(F.col("candidate_id").alias("image_id")).agg(F.min("run_id").alias("shown_by"))
    rows = by_id.join(shown, "image_id", "left")
    link = F.when(F.col("known").isNotNull(), "id").when(F.col("shown_by").isNotNull(), "image").otherwise("create")
    return rows.select("item_id", link.alias("link"), F.coalesce("known", "shown_by").alias("linked_run"))


def verify_refs(cited: DataFrame, allowed: DataFrame, key: str = "ref") -> DataFrame:
    """(ref, valid) of each distinct cited reference."""
    known = allowed.select(F.col(key), F.lit(True).alias("valid")).distinct()
    return cited.select(key).distinct().join(known, key, "left").select(key, F.coalesce("valid", F.lit(False)).alias("valid"))


def _climbed(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows (id, up, root, primes, least, depth) once every row knows the root above it, and how many are left without one.

    Each round doubles the steps up that an open row knows; only open rows are joined. Rounds end when one settles no row: what is left
    then is below a ring or on it."""
    rows, before = written(rows), None
    left = rows.where("up IS NOT NULL").count()
    while left and left != before:
        rows, before = written(_doubled(rows)), left
        left = rows.where("up IS NOT NULL").count()
    return rows, left


def _doubled(rows: DataFrame) -> DataFrame:
    above = rows.select(F.col("id").alias("__id"), F.col("up").alias("__up"), F.col("root").alias("__root"), F.col("primes").alias("__primes"), F.col("least").alias("__least"), F.col("depth").alias("__depth"))
    met = rows.where("up IS NOT NULL").join(above, F.col("up") == F.col("__id"))
    moved = met.select("id", F.col("__up").alias("up"), F.coalesce("root", "__root").alias("root"), (F.col("primes") + F.col("__primes")).alias("primes"), F.least("least", "__least").alias("least"), (F.col("depth") + F.col("__depth")).alias("depth"))
    # a union has the partitions of both sides, whose number would grow with each round
    return rows.where("up IS NULL").unionByName(moved).coalesce(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def lineage(candidates: DataFrame, repairs: DataFrame | None = None, fallbacks: DataFrame | None = None) -> DataFrame:
    """(candidate_id, label, depth) of every candidate: roots are A, B, ... by (attempt, slot) in their run; a child has its
    parent's label and a prime, its later siblings one more each; depth is the number of steps down from the root.

    A candidate without a parent_id has that of the repair (from_id, result_id) or else of the fallback (source_id, result_id) that
    it is the result of. Ids that name no candidate make roots. In a ring of parents the smallest id is a root. Any depth: pointers
    are doubled until all have met their roots, one written table a round. Candidate ids are unique."""
    rows = candidates.select("run_id", "candidate_id", "attempt", "slot", "parent_id")
    for links, source in ((repairs, "from_id"), (fallbacks, "source_id")):
        if links is not None:
            of = links.where("result_id IS NOT NULL").groupBy(F.col("result_id").alias("__of")).agg(F.min(source).alias("__source"))
            rows = rows.join(of, F.col("candidate_id") == F.col("__of"), "left").withColumn("parent_id", F.coalesce("parent_id", "__source")).drop("__of", "__source")
    known = rows.select(F.col("candidate_id").alias("pid"))
    rows = written(rows.join(known, F.col("parent_id") == F.col("pid"), "left").drop("parent_id"))

    def start(rows: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("run_id", "pid").orderBy("attempt", "slot", "candidate_id")).cast("long")
        top = F.col("pid").isNull()
        return rows.select(
            F.col("candidate_id").alias("id"), F.col("pid").alias("up"), F.when(top, F.struct("run_id", place.alias("place"))).alias("root"), F.when(top, F.lit(0).cast("long")).otherwise(place).alias("primes"),
            F.col("candidate_id").alias("least"), F.when(top, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("depth"),
        )

    told, left = _climbed(start(rows))
    if left:  # rings: after as many doublings as rows are left, each open row points into its ring and a ring's rows have seen all of it
        for _ in range(left.bit_length()):
            told = written(_doubled(told))
        rings = told.where("up IS NOT NULL").select(F.col("up").alias("id")).distinct()
        heads = told.join(rings, "id", "left_semi").select(F.col("least").alias("__head")).distinct()
        rows = written(rows.join(heads, F.col("candidate_id") == F.col("__head"), "left").withColumn("pid", F.when(F.col("__head").isNull(), F.col("pid"))).drop("__head"))
        told, _ = _climbed(start(rows))
    label = F.concat(F.chr(64 + F.col("root.place")), F.repeat(F.lit("\u2032"), F.col("primes").cast("int")))
    return told.select(F.col("id").alias("candidate_id"), label.alias("label"), "depth")
