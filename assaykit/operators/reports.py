"""Reports over final outputs and versions: exact percentiles of large groups, pipeline quality, versions side by side, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.operators.metrics import confusion, item_verdict, with_outcomes

#: What counts as shipped, the longest edge of a small enough image, and the checks of notes and drift.
SHIPPED, MAX_EDGE = ("passed", "approved"), 1024
LABEL_NOTES, DRIFT, OCR = ("vlm_label_subtext_preserved",), "hue_drift", "ocr_cer"


def exact_percentiles(df: DataFrame, column: str, ps: list[float], *by: str, nearest: bool = False, accuracy: int = 10_000) -> DataFrame:
    """(by, p, n, value): the exact percentiles ps of a numeric column for each group, without a group's values in one buffer.

    A first pass brackets each percentile between two values by mergeable sketches; a second counts what lies under each
    bracket and the distinct values in it, and only those, a share of about 8 / accuracy of the group and its ties, are sorted.
    Linear interpolation between the neighbouring ranks, or the value at the nearest rank (half to even). Nulls and NaN count
    nowhere; a group without values has no row. A null group is a group. Ties are counted once with their number."""
    if not ps or not all(0 <= p <= 1 for p in ps):
        raise ValueError("percentiles are between 0 and 1")
    keys = [f"__k{i}" for i in range(len(by))]
    value = F.col(column).cast("double")
    rows = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], value.alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    slack = 4 / accuracy
    ends = [max(0.0, p - slack) for p in ps], [min(1.0, p + slack) for p in ps]
    low, high = (F.percentile_approx("__v", [float(e) for e in side], accuracy) for side in ends)
    brackets = rows.groupBy(*keys).agg(low.alias("__low"), high.alias("__high"), F.min("__v").alias("__least"), F.max("__v").alias("__most"), F.count("*").alias("__n"))
    # the ends of the range are known; elsewhere the sketch is wrong by less than the slack
    at_start, at_end = ([float(e) == x for e in side] for side, x in zip(ends, (0.0, 1.0)))
    widened = brackets.select(
        *[F.col(k).alias(f"__b{i}") for i, k in enumerate(keys)], "__n",
        F.array(*[F.col("__least") if s else F.col("__low")[i] for i, s in enumerate(at_start)]).alias("__low"),
        F.array(*[F.col("__most") if s else F.col("__high")[i] for i, s in enumerate(at_end)]).alias("__high"),
    )
    if by:
        met = rows.join(widened, [F.col(k).eqNullSafe(F.col(f"__b{i}")) for i, k in enumerate(keys)]).drop(*[f"__b{i}" for i in range(len(keys))])
    else:
        met = rows.crossJoin(F.broadcast(widened))  # one row
    # of each percentile: what is under (0) and above (2) its bracket as one row each, what is in it (1) by its value
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.col("__low")[i].alias("low"), F.col("__high")[i].alias("high")) for i in range(len(ps))])
    told = met.select(*keys, "__n", "__v", F.explode(places).alias("x")).select(*keys, "__n", "__v", "x.i", F.when(F.col("__v") < F.col("x.low"), 0).when(F.col("__v") > F.col("x.high"), 2).otherwise(1).alias("side"))
    counted = told.groupBy(*keys, "__n", "i", "side", F.when(F.col("side") == 1, F.col("__v")).alias("v")).agg(F.count("*").alias("c"), F.min("__v").alias("first"), F.max("__v").alias("last"))
    upto = Window.partitionBy(*keys, "i").orderBy("side", "v").rowsBetween(Window.unboundedPreceding, 0)
    p = F.array(*[F.lit(float(x)) for x in ps])[F.col("i")]
    place = p * (F.col("__n") - 1)
    ranked = counted.withColumns({"to": F.sum("c").over(upto), "p": p, "down": F.bround(place, 0).cast("long") if nearest else F.floor(place), "up": F.bround(place, 0).cast("long") if nearest else F.ceil(place)})
    holds = lambda rank: (F.col(rank) < F.col("to")) & (F.col(rank) >= F.col("to") - F.col("c"))
    # beside the bracket only the neighbouring value is known
    known = lambda rank: F.when(F.col(rank) == F.col("to") - F.col("c"), F.when(F.col("side") > 0, F.col("first"))).otherwise(F.when(F.col("side") == 1, F.col("v")))
    at = lambda rank: F.coalesce(known(rank), F.when((F.col("side") == 0) & (F.col(rank) == F.col("to") - 1), F.col("last")))
    ends_of = ranked.where(holds("down") | holds("up")).groupBy(*keys, "p", "__n").agg(
        F.max(F.when(holds("down"), at("down"))).alias("a"), F.max(F.when(holds("up"), at("up"))).alias("b")
    )
    part = F.col("p") * (F.col("__n") - 1) - F.floor(F.col("p") * (F.col("__n") - 1))
    between = F.col("a") if nearest else F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * part)
    missed = F.col("a").isNull() | F.col("b").isNull()
    sure = F.when(missed, F.raise_error(F.lit("a percentile lies outside of its bracket: raise accuracy")).cast("double")).otherwise(between)
    return ends_of.select(*[F.col(k).alias(b) for k, b in zip(keys, by)], "p", F.col("__n").alias("n"), sure.alias("value"))


def _rate(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part, whole), 6)


def checked_outputs(outputs: DataFrame, checks: DataFrame) -> DataFrame:
    """outputs with what their checks (item_id, name, passed, value, note) say: exact (a read of the text without an error), label_note,
    drift_measured and drift_noted. An output that wasn't evaluated has none of them."""
    true = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    name, note = F.col("name"), F.coalesce("note", F.lit(False))
    told = checks.where(name.isin(OCR, DRIFT, *LABEL_NOTES)).groupBy(F.col("item_id").alias("__id")).agg(
        true((name == OCR) & F.col("passed") & (F.col("value") == 0)).alias("exact"),
        true(name.isin(*LABEL_NOTES) & note).alias("label_note"),
        true((name == DRIFT) & F.col("value").isNotNull()).alias("drift_measured"),
        true((name == DRIFT) & note).alias("drift_noted"),
    )
    rows = outputs.join(told, F.col("item_id") == F.col("__id"), "left").drop("__id")
    return rows.withColumns({c: F.coalesce(F.col(c) & F.col("evaluated"), F.lit(False)) for c in ("exact", "label_note", "drift_measured", "drift_noted")})


def pipeline_report(outputs: DataFrame, checks: DataFrame, max_edge: int = MAX_EDGE) -> DataFrame:
    """One row over the final outputs, rates over all finals where no other base is named; null over nothing.

    outputs: item_id, item_set, group_id, status, outcome, first_attempt_pass, repair_count, cost_usd, latency_ms, text_verification,
    exclude_native, width, height, evaluated. Text is exact where a shipped output's read has no error, else by construction. The
    native rate is over shipped outputs that aren't excluded; sizes are of all outputs that have one; notes of evaluated finals,
    drift of those where it was measured; latencies of shipped ones, linear percentiles."""
    final, shipped = F.col("item_set") == "final", (F.col("item_set") == "final") & F.col("status").isin(*SHIPPED)
    rows = checked_outputs(outputs, checks)
    built = ~F.col("exact") & (F.col("text_verification") == "construction")
    pool = shipped & ~F.coalesce("exclude_native", F.lit(False))
    sized = F.col("width").isNotNull() & F.col("height").isNotNull()
    drift = final & F.col("evaluated") & F.col("drift_measured")
    cost = F.sum(F.when(final, F.col("cost_usd").cast("double")))
    n, ships = F.count_if(final), F.count_if(shipped)
    out = rows.agg(
        n.alias("briefs"), ships.alias("shipped"),
        _rate(F.count_if(final & F.col("first_attempt_pass")), n).alias("first_attempt_rate"), _rate(ships, n).alias("after_repair_rate"),
        F.count_if(shipped & F.col("exact")).alias("exact_read"), F.count_if(shipped & built).alias("exact_built"), _rate(F.count_if(shipped & (F.col("exact") | built)), ships).alias("exact_rate"),
        F.count_if(pool).alias("native_n"), _rate(F.count_if(pool & (F.col("outcome") == "native")), F.count_if(pool)).alias("native_rate"),
        F.round(F.avg(F.when(final, F.col("repair_count"))), 6).alias("mean_repairs"), F.round(cost, 6).alias("total_cost"), _rate(cost, ships).alias("cost_per_shipped"),
        F.count_if(sized).alias("images_checked"), _rate(F.count_if(sized & (F.greatest("width", "height") <= max_edge)), F.count_if(sized)).alias("resolution_rate"),
        F.count_if(final & F.col("evaluated")).alias("evaluated_n"), _rate(F.count_if(final & F.col("label_note")), F.count_if(final & F.col("evaluated"))).alias("label_note_rate"),
        F.count_if(drift).alias("drift_n"), _rate(F.count_if(drift & F.col("drift_noted")), F.count_if(drift)).alias("drift_rate"),
    )
    took = exact_percentiles(outputs.where(shipped), "latency_ms", [0.5, 0.95])
    wide = took.agg(*[F.round(F.max(F.when(F.col("p") == p, F.col("value"))), 3).alias(f"p{p * 100:.0f}_ms") for p in (0.5, 0.95)])
    return out.crossJoin(F.broadcast(wide))  # one row each


def status_counts(outputs: DataFrame) -> DataFrame:
    """Final outputs of each status."""
    return outputs.where("item_set = 'final'").groupBy("status").agg(F.count("*").alias("n"))


def drift_by_group(outputs: DataFrame, checks: DataFrame) -> DataFrame:
    """For each group of final outputs where drift was measured: how many, and the share with a note."""
    rows = checked_outputs(outputs.where("item_set = 'final'"), checks).where("drift_measured")
    return rows.groupBy("group_id").agg(F.count("*").alias("n"), F.round(F.avg(F.col("drift_noted").cast("int")), 3).alias("drift_rate"))


def ledger_latency(calls: DataFrame) -> DataFrame:
    """Linear p50 and p95 of each kind's uncached calls, a kind of any size."""
    took = exact_percentiles(calls.where(~F.col("cached")), "latency_ms", [0.5, 0.95], "kind")
    at = lambda p: F.round(F.max(F.when(F.col("p") == p, F.col("value"))), 3)
    return took.groupBy("kind").agg(F.max("n").alias("uncached"), at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"))


def points(before: Column, after: Column) -> Column:
    """Change between two rates in whole percentage points, half up, as "+25 pp"; null where one is missing."""
    change = F.floor((after - before) * 100 + 0.5).cast("long")
    sign = F.when(change > 0, "+").when(change < 0, "−").otherwise("±")
    return F.concat(sign, F.abs(change).cast("string"), F.lit(" pp"))


def compare_rates(items: DataFrame, versions: list[str]) -> DataFrame:
    """Pass rates of natural and final items by set and dimension, versions side by side: for each version the human labels
    (n, rate) and the evaluator's verdicts (n, rate), and the change of both from the first version to the last.

    versions are declared, so that the pivot needs no pass of its own; a version without rows has n 0 and a null rate."""
    rows = with_outcomes(items.where(F.col("item_set").isin("nat", "final")))
    human = F.when((F.col("label_source") == "human"), F.col("label"))
    judged = F.when(F.col("assessed"), F.coalesce("predicted", F.lit(False)))
    wide = rows.groupBy("item_set", "dimension").pivot("version", versions).agg(
        F.count(human).alias("human_n"), F.avg(human.cast("int")).alias("human_rate"), F.count(judged).alias("judged_n"), F.avg(judged.cast("int")).alias("judged_rate")
    )
    return _side_by_side(wide, versions, ["human_n", "judged_n"], ["human_rate", "judged_rate"], "item_set", "dimension")


def compare_precision(items: DataFrame, versions: list[str]) -> DataFrame:
    """Precision, recall and F1 of each dimension over natural and planted items, versions side by side, with their change."""
    rows = confusion(with_outcomes(items.where(F.col("item_set").isin("nat", "plant"))), "version", "dimension")
    names = ["prec", "recall", "f1"]
    wide = rows.groupBy("dimension").pivot("version", versions).agg(*[F.max(c).alias(c) for c in ("n", *names)])
    return _side_by_side(wide, versions, ["n"], names, "dimension")


def _side_by_side(wide: DataFrame, versions: list[str], counts: list[str], rates: list[str], *by: str) -> DataFrame:
    first, last = versions[0], versions[-1]
    of = lambda v, c: F.col(f"`{v}_{c}`")
    cells = [F.coalesce(of(v, c), F.lit(0)).cast("long").alias(f"{v}_{c}") for v in versions for c in counts]
    cells += [F.round(of(v, c), 6).alias(f"{v}_{c}") for v in versions for c in rates]
    return wide.select(*by, *cells, *[points(of(first, c), of(last, c)).alias(f"{c}_change") for c in rates])


def derive_tags(items: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """(item_id, tags): what an item, its label and its run (item_id, first_attempt_pass, repair_count, outcome, status) are
    filtered by, in this order. A human label passes if all that are labelled pass; without labels it agrees with anything."""
    human = F.col("label_source") == "human"
    values = F.map_values("labels")
    overall = F.when(F.size(values) > 0, F.when(F.forall(values, lambda v: v), "pass").otherwise("fail"))
    given = [
        F.when(F.col("split") == "heldout", "held-out split").otherwise("calibration split"),
        F.when(human, "human-labelled"),
        F.when(human & (overall != item_verdict()), "disagrees with human"),
    ]
    rows = items
    if runs is not None:
        known = runs.select(F.col("item_id").alias("__of"), *[F.col(c).alias(f"__{c}") for c in ("first_attempt_pass", "repair_count", "outcome", "status")])
        rows = items.join(known, F.col("item_id") == F.col("__of"), "left")
        given += [
            F.when(F.col("__first_attempt_pass"), "first-attempt pass"), F.when(F.col("__repair_count") > 0, "repaired"),
            F.when(F.col("__outcome") == "overlay", "text fallback"), F.when(F.col("__status") == "needs_review", "held for review"),
        ]
    return rows.select("item_id", F.array_compact(F.array(*given)).alias("tags"))


