"""Checks of items: verdicts from checks, checklists, range rules, data-quality rules, and a registry of named checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dimension_from_checks(checks: DataFrame) -> DataFrame:
    """For each item and dimension: verdict (fail over unverified over pass), score (share of passed checks), and the
    names of failed and of unknown checks."""
    failed, unknown = ~F.col("passed"), F.col("passed").isNull()
    rows = checks.groupBy("item_id", "dimension").agg(
        F.count("*").alias("n"),
        F.count_if("passed").alias("p"),
        F.array_join(F.array_sort(F.collect_list(F.when(failed, F.col("check_name")))), ",").alias("failed"),
        F.array_join(F.array_sort(F.collect_list(F.when(unknown, F.col("check_name")))), ",").alias("unknown"),
    )
    verdict = F.when(F.col("failed") != "", "fail").when(F.col("unknown") != "", "unverified").otherwise("pass")
    return rows.select("item_id", "dimension", verdict.alias("verdict"), F.round(F.col("p") / F.col("n"), 6).alias("score"), "failed", "unknown")


def overall_verdict(dims: DataFrame) -> DataFrame:
    """Of (item_id, verdict, score): fail over unverified over pass, and the mean score to 4 places."""
    rows = dims.groupBy("item_id").agg(F.bool_or(F.col("verdict") == "fail").alias("f"), F.bool_or(F.col("verdict") == "unverified").alias("u"), F.round(F.avg("score"), 4).alias("composite"))
    return rows.select("item_id", F.when(F.col("f"), "fail").when(F.col("u"), "unverified").otherwise("pass").alias("verdict"), "composite")


def score_checklist(checks: DataFrame, answers: DataFrame) -> DataFrame:
    """checks: (item_id, check_name, severity must/should, pass_on yes/no); answers: (item_id, check_name, answer
    yes/no/unsure). An unsure must fails, a missing answer is unknown. passed: False if a must fails, null if one is
    unknown; score: share of shoulds that pass, 1 without any."""
    rows = checks.join(answers, ["item_id", "check_name"], "left")
    ok = F.when(F.col("answer").isNull(), F.lit(None).cast("boolean")).otherwise(F.col("answer") == F.col("pass_on"))
    rows = rows.withColumn("ok", ok)
    must, should = F.col("severity") == "must", F.col("severity") == "should"
    grouped = rows.groupBy("item_id").agg(
        F.count_if(must & ~F.col("ok")).alias("f"), F.count_if(must & F.col("ok").isNull()).alias("u"), F.count_if(should).alias("s"), F.count_if(should & F.col("ok")).alias("sp")
    )
    passed = F.when(F.col("f") > 0, False).when(F.col("u") == 0, True)
    return grouped.select("item_id", passed.alias("passed"), F.round(F.coalesce(F.try_divide("sp", "s"), F.lit(1.0)), 6).alias("score"))


def ratio_check(ratio: Column, low: float = 0.6, high: float = 1.25) -> Column:
    return ratio.between(low, high)


def area_check(area: Column, expected: Column, most: float = 4.0, least: float = 0.12, note: float = 2.0) -> Column:
    """fail beyond the extreme factors, note beyond the mild one, else pass; unknown without an expectation."""
    factor = F.try_divide(area, expected)
    return F.when(factor.isNull(), "unknown").when((factor > most) | (factor < least), "fail").when((factor > note) | (factor < 1 / note), "note").otherwise("pass")


def row_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) of row rules in one pass; a rule that is null for a row isn't violated."""
    counts = df.agg(*[F.count_if(~r).alias(n) for n, r in rules.items()])
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*[F.col(n) for n in rules]))).alias("rule", "violations"))


def unique_rule(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once; nulls are equal to each other."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def foreign_rule(df: DataFrame, key: str, target: DataFrame, other: str) -> DataFrame:
    """Rows whose key isn't in the target; null keys are let through."""
    return df.where(F.col(key).isNotNull()).join(target.select(F.col(other).alias("__k")), F.col(key) == F.col("__k"), "left_anti")


@dataclass(frozen=True)
class Check:
    name: str
    dimension: str
    method: str
    severity: str
    value: Callable[[], Column]
    threshold: float
    passes: Callable[[Column, float], Column]


REGISTRY: dict[str, Check] = {}


def register_check(name: str, dimension: str, value: Callable[[], Column], threshold: float, passes: Callable[[Column, float], Column], method: str = "deterministic", severity: str = "must") -> None:
    """Add a named check: a value of a row and when it passes against the threshold."""
    REGISTRY[name] = Check(name, dimension, method, severity, value, threshold, passes)


def run_checks(df: DataFrame, key: str, names: list[str] | None = None) -> DataFrame:
    """The long table of checks, all of them in one projection of df."""
    chosen = [REGISTRY[n] for n in names or sorted(REGISTRY)]
    rows = F.array(
        *[
            F.struct(
                F.lit(c.dimension).alias("dimension"), F.lit(c.name).alias("check_name"), F.lit(c.method).alias("method"), F.lit(c.severity).alias("severity"),
                c.passes(c.value(), c.threshold).alias("passed"), c.value().cast("double").alias("value"), F.lit(float(c.threshold)).alias("threshold"),
            )
            for c in chosen
        ]
    )
    return df.select(F.col(key).alias("item_id"), F.inline(rows))


#: The failure code of a check by its name; technical checks and those of the vision judge have their own.
CODES = {
    "color_delta_e": "PRODUCT_COLOR_DRIFT",
    "comp.realistic_scale": "COMPOSITION_SCALE",
    "comp.scale_sanity": "COMPOSITION_SCALE",
    "comp.scale_ratio": "COMPOSITION_SCALE",
    "comp.natural_integration": "COMPOSITION_INTEGRATION",
    "ocr_cer": "TEXT_MISMATCH",
    "vlm_readback": "TEXT_MISMATCH",
    "critical_tokens": "TEXT_TOKENS_MISSING",
    "stray_text": "STRAY_TEXT",
    "vlm_stray_text": "STRAY_TEXT",
    "overlay_pending": "OVERLAY_PENDING",
}


def failure_codes(checks: DataFrame) -> DataFrame:
    """(item_id, code, checks) of the failed checks (item_id, dimension, check_name, passed, value, gating): a code once
    for each item, with the names of its checks. A product count says missing at 0 or null, else duplicated; context
    checks count where gating is true. Checks without a code give none."""
    name, dim = F.col("check_name"), F.col("dimension")
    known = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    code = (
        F.when(dim == "technical", "TECHNICAL")
        .when(name == "product_count", F.when(F.floor(F.coalesce("value", F.lit(0))) == 0, "PRODUCT_MISSING").otherwise("PRODUCT_DUPLICATED"))
        .when((dim == "product") & F.startswith(name, F.lit("vlm_")), "PRODUCT_CHECK")
        .when((dim == "context") & F.col("gating"), "CONTEXT_CHECK")
        .otherwise(F.try_element_at(known, name))
    )
    rows = checks.where(~F.col("passed")).select("item_id", code.alias("code"), "check_name").where("code IS NOT NULL")
    return rows.groupBy("item_id", "code").agg(F.array_join(F.array_sort(F.collect_set("check_name")), ",").alias("checks"))


def triage(evals: DataFrame, max_repairs: int = 2, text_repairs: int = 1) -> DataFrame:
    """(evaluation_id, codes, route, action): the first route that fits an evaluation, and what it does.

    evals: evaluation_id, <dimension>_pass (null: unverified), composition_judged (false: none was asked for), repairs
    and text_repairs used, affordable, stray (text outside the zone), in_zone (product in it), overlay (overlay-only
    text, or one pending). Without a repair left a failure that only a new image mends goes to review; text is laid
    over in any case. codes: the dimensions that failed.
    """
    failed = {d: F.coalesce(~F.col(f"{d}_pass"), F.lit(False)) for d in ("technical", "text", "product", "context", "composition")}
    unjudged = F.coalesce(~F.col("composition_judged"), F.lit(False)) & F.col("composition_pass").isNull()
    open_ = [F.col("product_pass").isNull(), F.col("context_pass").isNull(), F.col("composition_pass").isNull() & ~unjudged]
    passes = reduce(lambda a, b: a & b, [F.col(f"{d}_pass") for d in ("technical", "text", "product", "context")]) & (F.col("composition_pass") | unjudged)
    can = F.coalesce((F.col("repairs") < max_repairs) & F.col("affordable"), F.lit(False))
    outside = F.coalesce("stray", F.lit(False)) | F.coalesce("in_zone", F.lit(False))
    routes: list[tuple[Column, str, str]] = [
        (passes, "passed", "approve"),
        (~F.coalesce("technical_pass", F.lit(False)), "technical", "regenerate"),
        *[(failed[d], d, f"repair_{d}") for d in ("product", "context", "composition")],
        (reduce(lambda a, b: a | b, open_), "unverified", "needs_review"),
        (outside, "text_outside_zone", "clean_plate"),
        (F.coalesce("overlay", F.lit(False)), "overlay_only", "overlay"),
        (failed["text"] & can & (F.col("text_repairs") < text_repairs), "text_in_zone", "repair_text"),
        (F.lit(True), "text_exhausted", "overlay"),
    ]
    needs_image = ("technical", "product", "context", "composition", "text_outside_zone")

    def first(fits: Column, row: str, action: str, rest: Column) -> Column:
        found = F.struct(F.lit(row).alias("route"), F.lit(action).alias("action"))
        if row in needs_image:
            found = F.when(can, found).otherwise(F.struct(F.lit("exhausted").alias("route"), F.lit("needs_review").alias("action")))
        return F.when(fits, found).otherwise(rest)

    route = reduce(lambda rest, r: first(*r, rest), reversed(routes), F.lit(None).cast("struct<route:string,action:string>"))
    codes = F.array_join(F.array_compact(F.array(*[F.when(f, F.lit(d)) for d, f in failed.items()])), ",")
    return evals.select("evaluation_id", codes.alias("codes"), route.alias("r")).select("evaluation_id", "codes", "r.route", "r.action")
