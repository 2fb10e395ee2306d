"""Meta-evaluation: how an evaluator agrees with labels.

The positive class is FAIL. A null prediction ("unverified") counts as FAIL, a missing key ("not assessed") is left
out; a missing or null label is "unlabelled", which is tested before "not assessed".
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.sources.bridge import DIMENSIONS

CORE = ("technical", "text", "product", "context")


def items_from_wide(wide: DataFrame) -> DataFrame:
    """Items with maps from a frame with label_*, assessed_* and pred_* columns."""

    def filled(keep, value: str) -> Column:
        entries = F.array(*[F.when(keep(d), F.struct(F.lit(d).alias("key"), F.col(f"{value}_{d}").alias("value"))) for d in DIMENSIONS])
        return F.map_from_entries(F.array_compact(entries))

    return wide.withColumns(
        {"labels": filled(lambda d: F.col(f"label_{d}").isNotNull(), "label"), "dimensions": filled(lambda d: F.col(f"assessed_{d}"), "pred")}
    )


def with_outcomes(items: DataFrame, dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """One row for each item and dimension: label, assessed, predicted, outcome (tp, fp, fn, tn; null if unlabelled or
    not assessed)."""
    rows = items.select("*", F.explode(F.array(*map(F.lit, dims))).alias("dimension"))
    rows = rows.select(
        *[c for c in items.columns if c not in ("labels", "dimensions")],
        "dimension",
        F.try_element_at("labels", "dimension").alias("label"),
        F.map_contains_key("dimensions", F.col("dimension")).alias("assessed"),
        F.try_element_at("dimensions", "dimension").alias("predicted"),
    )
    fails = ~F.coalesce("predicted", F.lit(False))
    outcome = (
        F.when(F.col("label").isNull() | ~F.col("assessed"), F.lit(None).cast("string"))
        .when(~F.col("label") & fails, "tp")
        .when(F.col("label") & fails, "fp")
        .when(~F.col("label"), "fn")
        .otherwise("tn")
    )
    return rows.withColumn("outcome", outcome)


def _ratios(df: DataFrame) -> DataFrame:
    """Precision, recall and F1 from tp, fp, fn: null on nothing to divide by; F1 is 0 where both are 0."""
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    f1 = F.when(p + r == 0, 0.0).otherwise(2 * p * r / F.when(p + r == 0, 1).otherwise(p + r))
    return df.withColumns({"prec": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(f1, 6)})


def _counts() -> list[Column]:
    ones = [F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "fn", "tn")]
    unlabelled = F.col("label").isNull()
    return [F.count("outcome").alias("n"), *ones, F.count_if(~unlabelled & ~F.col("assessed")).alias("not_assessed"), F.count_if(unlabelled).alias("unlabelled")]


def confusion(outcomes: DataFrame, *by: str) -> DataFrame:
    """Counts and ratios of a with_outcomes() frame for each group."""
    return _ratios(outcomes.groupBy(*by).agg(*_counts()))


def dimension_metrics(items: DataFrame) -> DataFrame:
    """Confusion counts, precision, recall and F1 for each dimension over natural and planted items."""
    return confusion(with_outcomes(items.where(F.col("item_set").isin("nat", "plant"))), "dimension")


def metrics_by_split(items: DataFrame) -> DataFrame:
    """The same for each split and over all (split null), in one pass."""
    rows = with_outcomes(items.where(F.col("item_set").isin("nat", "plant")))
    sets = rows.groupingSets([[F.col("split"), F.col("dimension")], [F.col("dimension")]], F.col("split"), F.col("dimension"))
    return _ratios(sets.agg(*_counts()))


def overall_label(labels: str = "labels", dims: tuple[str, ...] = CORE) -> Column:
    """False if any dimension is labelled False; True if all are labelled True (composition counts only when labelled);
    else null."""
    values = [F.try_element_at(labels, F.lit(d)) for d in dims]
    extra = F.try_element_at(labels, F.lit("composition"))
    false = reduce(lambda a, b: a | b, [F.coalesce(~v, F.lit(False)) for v in [*values, extra]])
    true = reduce(lambda a, b: a & b, [F.coalesce(v, F.lit(False)) for v in values])
    return F.when(false, False).when(true, True)


def overall_prediction(labels: str = "labels", dimensions: str = "dimensions") -> Column:
    """False unless technical is True; then False if a labelled and assessed dimension isn't True."""
    technical = F.coalesce(F.try_element_at(dimensions, F.lit("technical")), F.lit(False))
    fails = [
        F.map_contains_key(dimensions, d) & F.try_element_at(labels, F.lit(d)).isNotNull() & ~F.coalesce(F.try_element_at(dimensions, F.lit(d)), F.lit(False)) for d in DIMENSIONS
    ]
    return technical & ~reduce(lambda a, b: a | b, fails)


def _kappa(rows: DataFrame, *by: str) -> DataFrame:
    """n, agree, agreement and Cohen's kappa of boolean columns human and machine; kappa is null for no rows or where
    chance agreement is 1."""
    both = F.col("human").isNotNull() & F.col("machine").isNotNull()
    counted = rows.groupBy(*by).agg(
        F.count_if(both).alias("n"),
        F.count_if(both & (F.col("human") == F.col("machine"))).alias("agree"),
        F.count_if(both & F.col("human")).alias("h"),
        F.count_if(both & F.col("machine")).alias("m"),
    )
    n = F.col("n")
    po, pe = F.try_divide("agree", n), F.try_divide(F.col("h") * F.col("m") + (n - F.col("h")) * (n - F.col("m")), n * n)
    kappa = F.when(F.abs(1 - pe) > 1e-9, (po - pe) / F.when(F.abs(1 - pe) > 1e-9, 1 - pe))
    return counted.select(*by, "n", "agree", F.round(po, 6).alias("agreement"), F.round(kappa, 6).alias("kappa"))


def human_agreement(items: DataFrame) -> DataFrame:
    """Agreement and kappa of the overall label and prediction of natural items that a human labelled."""
    rows = items.where((F.col("item_set") == "nat") & (F.col("label_source") == "human"))
    return _kappa(rows.select(overall_label().alias("human"), F.when(overall_label().isNotNull(), overall_prediction()).alias("machine")))


def dimension_agreement(items: DataFrame) -> DataFrame:
    """The same for each set and dimension; groups without rows stay, with n 0."""
    rows = with_outcomes(items).where(F.col("label_source") == "human")
    pairs = rows.select("item_set", "dimension", F.when(F.col("assessed"), F.col("label")).alias("human"), F.coalesce("predicted", F.lit(False)).alias("machine"))
    spark = items.sparkSession
    grid = spark.createDataFrame([(s, d) for s in ("nat", "final", "plant") for d in DIMENSIONS], "item_set string, dimension string")
    return _kappa(grid.join(pairs, ["item_set", "dimension"], "left"), "item_set", "dimension")


def planted_classes(items: DataFrame, strict: bool = False, control: str = "none") -> DataFrame:
    """For each mutation of planted items: n, caught, the dimensions expected to fail, and the ids that were missed.

    An item is caught if every dimension that its labels fail is flagged; unverified counts as flagged unless strict.
    """
    fails = F.filter(F.map_entries("labels"), lambda e: ~e["value"])
    expected = F.transform(fails, lambda e: e["key"])
    value = lambda d: F.try_element_at("dimensions", d)
    flagged = (lambda d: F.coalesce(~value(d), F.lit(False))) if strict else (lambda d: F.map_contains_key("dimensions", d) & ~F.coalesce(value(d), F.lit(False)))
    rows = items.where((F.col("item_set") == "plant") & (F.col("mutation") != control)).select("item_id", "mutation", expected.alias("expected"), F.forall(expected, flagged).alias("caught"))
    rows = rows.where(F.size("expected") > 0)
    counted = rows.groupBy("mutation").agg(
        F.count("*").alias("n"), F.count_if("caught").alias("caught"), F.array_sort(F.collect_list(F.when(~F.col("caught"), F.col("item_id")))).alias("missed")
    )
    dims = rows.select("mutation", F.explode("expected").alias("d")).groupBy("mutation").agg(F.array_join(F.array_sort(F.collect_set("d")), ",").alias("expected"))
    return counted.join(dims, "mutation")


def known_good(items: DataFrame, control: str = "none") -> DataFrame:
    """Controls (planted without a mutation) and how many of them pass in every assessed dimension."""
    verdict = F.forall(F.map_values("dimensions"), lambda v: F.coalesce(v, F.lit(False)))
    return items.where((F.col("item_set") == "plant") & (F.col("mutation") == control)).agg(F.count("*").alias("n"), F.count_if(verdict).alias("passed"))


def disputed(items: DataFrame, rulings: DataFrame) -> DataFrame:
    """Metrics with and without the disputed pairs. rulings: (version, item_id, dimension); a planted item inherits
    those of its source where its own label is a pass."""
    rows = with_outcomes(items.where(F.col("item_set").isin("nat", "plant")))
    r = rulings.select(F.col("version").alias("r_version"), F.col("item_id").alias("r_item"), F.col("dimension").alias("r_dim"), F.lit(True).alias("hit")).distinct()
    own = rows.join(r, (rows["version"] == r["r_version"]) & (rows["item_id"] == r["r_item"]) & (rows["dimension"] == r["r_dim"]), "left").drop("r_version", "r_item", "r_dim").withColumnRenamed("hit", "own")
    both = own.join(r, (own["version"] == r["r_version"]) & (own["source_id"] == r["r_item"]) & (own["dimension"] == r["r_dim"]), "left").drop("r_version", "r_item", "r_dim")
    dropped = F.coalesce("own", F.lit(False)) | (F.coalesce("hit", F.lit(False)) & F.coalesce("label", F.lit(False)))
    marked = both.withColumn("kept", ~dropped)
    everything = confusion(marked, "dimension").withColumn("rows", F.lit("all"))
    return everything.unionByName(confusion(marked.where("kept"), "dimension").withColumn("rows", F.lit("undisputed")))


def layer_verdicts(checks: DataFrame, dims: DataFrame | None = None) -> DataFrame:
    """Verdict of each layer (method) for each item and dimension: False if a check fails, else null if one is
    unverified, else True; n: its checks.

    dims: (item_id, dimension, passed), the own verdict of each assessed dimension, null if unverified. A layer that has all
    checks of a dimension takes that verdict, as it knows severities (a check that should pass fails no dimension), and the
    layer `combined` is that verdict. What has no row in dims isn't assessed and gives none. Without dims: by checks alone.
    """
    fold = [F.bool_or(~F.col("passed")).alias("f"), F.bool_or(F.col("passed").isNull()).alias("u"), F.count("*").alias("n")]
    verdict = F.when(F.coalesce("f", F.lit(False)), False).when(F.col("u"), F.lit(None).cast("boolean")).otherwise(True)
    if dims is None:
        rows = checks.groupBy("item_id", "dimension", "method").agg(*fold)
        return rows.select("item_id", "dimension", F.col("method").alias("layer"), verdict.alias("verdict"), "n")
    told = checks.select("item_id", "dimension", "method", "passed", F.lit(False).alias("own"))
    rows = told.unionByName(dims.select("item_id", "dimension", F.lit("combined").alias("method"), "passed", F.lit(True).alias("own")))
    rows = rows.repartition("item_id", "dimension").groupBy("item_id", "dimension", "own", "method").agg(*fold).withColumn("verdict", verdict)
    pair = Window.partitionBy("item_id", "dimension")
    every = F.coalesce(F.sum(F.when(~F.col("own"), F.col("n"))).over(pair), F.lit(0))
    rows = rows.withColumns({"every": every, "assessed": F.bool_or("own").over(pair), "whole": F.bool_or(F.when(F.col("own"), F.col("verdict"))).over(pair)}).where("assessed")
    takes = F.when(F.col("own") | (F.col("n") == F.col("every")), F.col("whole")).otherwise(F.col("verdict"))
    return rows.select("item_id", "dimension", F.col("method").alias("layer"), takes.alias("verdict"), F.when(F.col("own"), F.col("every")).otherwise(F.col("n")).alias("n"))


def ablation(labels: DataFrame, layers: DataFrame) -> DataFrame:
    """Precision, recall and F1 for each layer and dimension, by version and pooled (version null).

    labels: (item_id, version, dimension, label); layers: (item_id, dimension, layer, verdict). The layer `combined`
    fails if any layer fails.
    """
    # one row for each item and dimension until labels have met it, so that layers are worked out and shuffled once
    listed = layers.groupBy("item_id", "dimension").agg(F.collect_list(F.struct("layer", "verdict")).alias("l"))
    passes = F.forall("l", lambda x: F.coalesce(x["verdict"], F.lit(False)))
    every = listed.select("item_id", "dimension", F.array_append("l", F.struct(F.lit("combined").alias("layer"), passes.alias("verdict"))).alias("l"))
    rows = labels.where(F.col("label").isNotNull()).join(every, ["item_id", "dimension"]).select("version", "dimension", "label", F.inline("l"))
    fails = ~F.coalesce("verdict", F.lit(False))
    outcome = F.when(~F.col("label") & fails, "tp").when(fails, "fp").when(~F.col("label"), "fn").otherwise("tn")
    rows = rows.withColumn("outcome", outcome)
    cols = [F.col("version"), F.col("layer"), F.col("dimension")]
    sets = rows.groupingSets([cols, cols[1:]], *cols)
    return _ratios(sets.agg(F.count("*").alias("n"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "fn", "tn")]))


def compare_versions(items: DataFrame) -> DataFrame:
    """Human and evaluator pass rates for each version, set and dimension."""
    rows = with_outcomes(items).where(F.col("label").isNotNull() & F.col("assessed"))
    return rows.groupBy("version", "item_set", "dimension").agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.col("label").cast("int")), 6).alias("human_pass_rate"),
        F.round(F.avg(F.coalesce("predicted", F.lit(False)).cast("int")), 6).alias("evaluator_pass_rate"),
    )


def threshold_sweep(scores: DataFrame, grid: list[float]) -> DataFrame:
    """Best threshold by F1 on calibration rows of (score, label, split), lowest on ties, and its figures on held-out
    rows. A row fails if its score is under the threshold; rows without a score count nowhere. Rows are counted once by the
    number of thresholds that they reach, so that only those counts meet the grid."""
    grid = sorted(set(grid))
    steps = F.broadcast(scores.sparkSession.createDataFrame(list(enumerate(grid)), "place int, threshold double"))
    reached = F.size(F.filter(F.array(*[F.lit(float(g)) for g in grid]), lambda t: t <= F.col("score")))
    bins = scores.where("score IS NOT NULL").groupBy("split", reached.alias("reached")).agg(F.count_if(~F.col("label")).alias("bad"), F.count_if("label").alias("good"))
    some = lambda n, c: F.coalesce(F.sum(F.when(c, F.col(n))), F.lit(0))
    fails = F.col("reached") <= F.col("place")
    counted = bins.crossJoin(steps).groupBy("split", "threshold").agg(
        some("bad", fails).alias("tp"), some("good", fails).alias("fp"), some("bad", ~fails).alias("fn"), some("good", ~fails).alias("tn")
    )
    rated = _ratios(counted)
    best = rated.where(F.col("split") == "calibration").agg(F.max_by("threshold", F.struct(F.coalesce("f1", F.lit(-1.0)), -F.col("threshold"))).alias("threshold"))
    return rated.join(F.broadcast(best), "threshold")


def item_verdict() -> Column:
    """fail if a dimension is False, else unverified if one is null or none is assessed, else pass."""
    values = F.map_values("dimensions")
    return F.when(F.exists(values, lambda v: F.coalesce(~v, F.lit(False))), "fail").when((F.size(values) == 0) | F.exists(values, lambda v: v.isNull()), "unverified").otherwise("pass")


def disagreements(items: DataFrame, ignore_nulls: bool = False) -> DataFrame:
    """Human-labelled items whose overall label differs from the verdict. ignore_nulls: the label is True if no
    dimension is labelled False and any is labelled."""
    values = F.map_values("labels")
    lenient = F.when(F.exists(values, lambda v: ~v), False).when(F.size(values) > 0, True)
    label = lenient if ignore_nulls else overall_label()
    rows = items.where(F.col("label_source") == "human").select("item_id", "version", label.alias("label"), item_verdict().alias("verdict"))
    return rows.where(F.col("label") != (F.col("verdict") == "pass"))


def stability(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two judgings (item_id, check_name, method, passed): matched items, common checks by vlm, flips and their rate.
    An item counts even if it has no common check."""
    a = first.where("method = 'vlm'").select("item_id", "check_name", F.col("passed").alias("a"))
    b = second.where("method = 'vlm'").select("item_id", "check_name", F.col("passed").alias("b"))
    items = first.select("item_id").distinct().join(second.select("item_id").distinct(), "item_id").agg(F.count("*").alias("items"))
    common = a.join(b, ["item_id", "check_name"]).agg(F.count("*").alias("checks"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("flips"))
    return items.join(F.broadcast(common)).withColumn("rate", F.round(F.try_divide("flips", "checks"), 6))


def compare_baseline(metrics: DataFrame, targets: DataFrame, baseline: DataFrame) -> DataFrame:
    """metrics and baseline: (name, value); targets: (name, op, target). Every name of the three, with the present and
    the first value and whether the target is met; null if a value is missing. Without a baseline it is the present."""
    now = metrics.select("name", F.col("value").alias("now"))
    base = baseline.select("name", F.col("value").alias("baseline"))
    rows = now.join(base, "name", "full").join(targets, "name", "full")
    met = F.when(F.col("op") == ">=", F.col("now") >= F.col("target")).when(F.col("op") == "<=", F.col("now") <= F.col("target"))
    return rows.select("name", F.coalesce("baseline", "now").alias("baseline"), "now", "op", "target", met.alias("met"))
