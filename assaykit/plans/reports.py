"""Queries of the reports over final outputs, versions and tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaykit.operators import golden as G
from assaykit.operators import metrics as M
from assaykit.operators import reports as R
from assaykit.plans.evaluation import OUTCOME, VERDICT, items
from assaykit.plans.registry import query
from assaykit.session import written
from assaykit.sources.bridge import DIMENSIONS, table, twin

SHIPS = "item_set = 'final' AND status IN ('passed', 'approved')"
TOLD = """SELECT o.*, evaluated AND EXISTS (SELECT 1 FROM v_outputchecks c WHERE c.item_id = o.item_id AND name = 'ocr_cer' AND passed AND value = 0) AS exact,
      evaluated AND EXISTS (SELECT 1 FROM v_outputchecks c WHERE c.item_id = o.item_id AND name = 'vlm_label_subtext_preserved' AND note) AS label_note,
      evaluated AND EXISTS (SELECT 1 FROM v_outputchecks c WHERE c.item_id = o.item_id AND name = 'hue_drift' AND value IS NOT NULL) AS measured,
      evaluated AND EXISTS (SELECT 1 FROM v_outputchecks c WHERE c.item_id = o.item_id AND name = 'hue_drift' AND note) AS noted FROM v_outputs o"""


def outputs(spark, sf_dir):
    return table(spark, sf_dir, "v_outputs"), table(spark, sf_dir, "v_outputchecks")


@query(
    "pipeline_report",
    twin(f"""WITH t AS ({TOLD}), s AS (SELECT *, exact AS e, NOT exact AND coalesce(text_verification = 'construction', false) AS built FROM t WHERE {SHIPS}), f AS (SELECT * FROM t WHERE item_set = 'final')
    SELECT (SELECT count(*) FROM f) AS briefs, (SELECT count(*) FROM s) AS shipped, (SELECT round(count(*) FILTER (first_attempt_pass) / count(*), 6) FROM f) AS first_attempt_rate,
      round((SELECT count(*) FROM s) / (SELECT count(*) FROM f), 6) AS after_repair_rate, (SELECT count(*) FILTER (e) FROM s) AS exact_read, (SELECT count(*) FILTER (built) FROM s) AS exact_built,
      (SELECT round(count(*) FILTER (e OR built) / count(*), 6) FROM s) AS exact_rate, (SELECT count(*) FROM s WHERE NOT exclude_native) AS native_n,
      (SELECT round(count(*) FILTER (outcome = 'native') / count(*), 6) FROM s WHERE NOT exclude_native) AS native_rate, (SELECT round(avg(repair_count), 6) FROM f) AS mean_repairs,
      (SELECT round(sum(CAST(cost_usd AS double)), 6) FROM f) AS total_cost, round((SELECT sum(CAST(cost_usd AS double)) FROM f) / (SELECT count(*) FROM s), 6) AS cost_per_shipped,
      (SELECT count(*) FROM t WHERE width IS NOT NULL AND height IS NOT NULL) AS images_checked,
      (SELECT round(count(*) FILTER (width <= 1024 AND height <= 1024) / count(*), 6) FROM t WHERE width IS NOT NULL AND height IS NOT NULL) AS resolution_rate,
      (SELECT count(*) FROM f WHERE evaluated) AS evaluated_n, (SELECT round(count(*) FILTER (label_note) / count(*), 6) FROM f WHERE evaluated) AS label_note_rate,
      (SELECT count(*) FROM f WHERE measured) AS drift_n, (SELECT round(count(*) FILTER (noted) / count(*), 6) FROM f WHERE measured) AS drift_rate,
      (SELECT round(quantile_cont(latency_ms, 0.5), 3) FROM s) AS p50_ms, (SELECT round(quantile_cont(latency_ms, 0.95), 3) FROM s) AS p95_ms"""),
)
def pipeline_report(spark, sf_dir):
    return R.pipeline_report(*outputs(spark, sf_dir))


@query("status_counts", twin("SELECT status, count(*) AS n FROM v_outputs WHERE item_set = 'final' GROUP BY status"))
def status_counts(spark, sf_dir):
    return R.status_counts(outputs(spark, sf_dir)[0])


@query("drift_by_group", twin(f"WITH t AS ({TOLD}) SELECT group_id, count(*) AS n, round(count(*) FILTER (noted) / count(*), 3) AS drift_rate FROM t WHERE item_set = 'final' AND measured GROUP BY group_id"))
def drift_by_group(spark, sf_dir):
    return R.drift_by_group(*outputs(spark, sf_dir))


@query(
    "ledger_latency",
    twin("SELECT kind, count(*) AS uncached, round(quantile_cont(latency_ms, 0.5), 3) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 3) AS p95_ms FROM v_calls WHERE NOT cached GROUP BY kind"),
)
def ledger_latency(spark, sf_dir):
    return R.ledger_latency(table(spark, sf_dir, "v_calls"))


@query(
    "price_percentiles",
    twin("""SELECT flag, p, count(price) AS n, round(CASE p WHEN 0.0 THEN min(price) WHEN 0.25 THEN quantile_cont(CAST(price AS double), 0.25) WHEN 0.5 THEN quantile_cont(CAST(price AS double), 0.5)
      WHEN 0.99 THEN quantile_cont(CAST(price AS double), 0.99) ELSE max(price) END, 4) AS value
    FROM v_candidates CROSS JOIN (VALUES (0.0), (0.25), (0.5), (0.99), (1.0)) k(p) GROUP BY flag, p""").replace("SELECT flag, p,", "SELECT flag, CAST(p AS double) AS p,"),
)
def price_percentiles(spark, sf_dir):
    found = R.exact_percentiles(table(spark, sf_dir, "v_candidates"), "price", [0.0, 0.25, 0.5, 0.99, 1.0], "flag")
    return found.withColumn("value", F.round("value", 4))


VERSIONS = ["v1", "v2", "v3"]


def _change(name: str) -> str:
    points = f"CAST(floor((v3_{name} - v1_{name}) * 100 + 0.5) AS bigint)"
    return f"CASE WHEN {points} > 0 THEN '+' || {points} || ' pp' WHEN {points} < 0 THEN '−' || -{points} || ' pp' WHEN {points} = 0 THEN '±0 pp' END AS {name}_change"


def _versions(cells: list[tuple[str, str]]) -> str:
    return ", ".join(f"{sql.format(v=v)} AS {v}_{name}" for v in VERSIONS for name, sql in cells)


_HUMAN, _JUDGED = "version = '{v}' AND label_source = 'human' AND label IS NOT NULL", "version = '{v}' AND assessed"
_RATED = [
    ("human_n", f"count(*) FILTER ({_HUMAN})"), ("human_rate", f"avg(CAST(label AS int)) FILTER ({_HUMAN})"),
    ("judged_n", f"count(*) FILTER ({_JUDGED})"), ("judged_rate", f"avg(CAST(coalesce(predicted, false) AS int)) FILTER ({_JUDGED})"),
]


@query(
    "compare_rates",
    twin(f"""WITH w AS (SELECT item_set, dimension, {_versions(_RATED)} FROM v_dims WHERE item_set IN ('nat', 'final') GROUP BY item_set, dimension)
    SELECT item_set, dimension, {", ".join(f"round({v}_{c}, 6) AS {v}_{c}" if c.endswith("rate") else f"{v}_{c}" for v in VERSIONS for c, _ in _RATED)}, {_change("human_rate")}, {_change("judged_rate")} FROM w"""),
)
def compare_rates(spark, sf_dir):
    return R.compare_rates(items(spark, sf_dir), VERSIONS)


_OF = "count(*) FILTER (version = '{v}' AND outcome"
_TP, _FP, _FN = (f"{_OF} = '{o}')" for o in ("tp", "fp", "fn"))
_BOTH = [
    ("n", f"{_OF} IS NOT NULL)"), ("prec", f"round({_TP} / nullif({_TP} + {_FP}, 0), 6)"), ("recall", f"round({_TP} / nullif({_TP} + {_FN}, 0), 6)"),
    ("f1", f"CASE WHEN {_TP} + {_FP} = 0 OR {_TP} + {_FN} = 0 THEN NULL ELSE round(2.0 * {_TP} / (2 * {_TP} + {_FP} + {_FN}), 6) END"),
]


@query(
    "compare_precision",
    twin(f"""WITH o AS ({OUTCOME}), w AS (SELECT dimension, {_versions(_BOTH)} FROM o WHERE item_set IN ('nat', 'plant') GROUP BY dimension)
    SELECT *, {", ".join(map(_change, ("prec", "recall", "f1")))} FROM w"""),
)
def compare_precision(spark, sf_dir):
    return R.compare_precision(items(spark, sf_dir), VERSIONS)


LABELLED = "[" + ", ".join(f"label_{d}" for d in DIMENSIONS) + "]"
TAGS = f"""SELECT item_id, concat_ws('|', CASE WHEN split = 'heldout' THEN 'held-out split' ELSE 'calibration split' END, CASE WHEN label_source = 'human' THEN 'human-labelled' END,
      CASE WHEN label_source = 'human' AND CASE WHEN list_contains({LABELLED}, false) THEN 'fail' WHEN list_contains({LABELLED}, true) THEN 'pass' END <> {VERDICT} THEN 'disagrees with human' END,
      CASE WHEN r.first_attempt_pass THEN 'first-attempt pass' END, CASE WHEN r.repair_count > 0 THEN 'repaired' END, CASE WHEN r.outcome = 'overlay' THEN 'text fallback' END,
      CASE WHEN r.run_status = 'needs_review' THEN 'held for review' END) AS tags
    FROM v_items LEFT JOIN (SELECT run_id, first_attempt_pass, repair_count, outcome, CASE WHEN status IN ('held', 'rejected') THEN 'needs_review' ELSE status END AS run_status FROM v_runs) r ON run_id = item_id"""


@query("item_tags", twin(TAGS))
def item_tags(spark, sf_dir):
    status = F.when(F.col("status").isin("held", "rejected"), "needs_review").otherwise(F.col("status"))
    runs = table(spark, sf_dir, "v_runs").select(F.col("run_id").alias("item_id"), "first_attempt_pass", "repair_count", "outcome", status.alias("status"))
    return R.derive_tags(M.items_from_wide(table(spark, sf_dir, "v_items")), runs).select("item_id", F.array_join("tags", "|").alias("tags"))


EMPTY = {
    "images": "image_sha string, origin string",
    "runs": "run_id bigint, brief_id bigint, status string, outcome string, approved_id bigint, best_id bigint",
    "candidates": "candidate_id bigint, run_id bigint, image_sha string, parent_id bigint, attempt int, slot int",
    "labels": "image_sha string, labeller string, rubric_version string, text boolean, product boolean, context boolean, composition boolean",
    "planted": "image_sha string, source_sha string, mutation string",
    "evaluations": "image_sha string, candidate_id bigint, version string, verdict string, n_checks bigint, technical boolean, text boolean, product boolean, context boolean, composition boolean",
    "events": "run_id bigint, seq bigint, type string, candidate_id bigint, status string",
}


def golden_files(spark, sf_dir) -> G.Files:
    """A data set's files: items of brief b and version belong to run b of it, natural ones before final ones."""
    rows = written(table(spark, sf_dir, "v_items").select(
        F.concat(F.lit("sha"), F.col("item_id")).alias("image_sha"), "item_id", "item_set", F.floor(F.col("item_id") / 5).alias("run_id"), "brief_id", "version", "mutation", "source_id", "label_source",
        *[f"label_{d}" for d in DIMENSIONS], *[F.when(F.col(f"assessed_{d}"), F.col(f"pred_{d}")).alias(d) for d in DIMENSIONS],
    ))
    labels = [F.col(f"label_{d}").alias(d) for d in G.LABELLED]
    status = F.when(F.col("run_id") % 4 == 0, "approved").when(F.col("run_id") % 4 == 1, "passed").otherwise("needs_review")
    first = rows.where("(item_set = 'nat' AND item_id % 5 = 0) OR item_set = 'final'")
    outputs = first.select(
        "image_sha", "item_set", "run_id", "brief_id", F.when(F.col("item_set") == "nat", 0).otherwise(1).alias("attempt"), F.lit(0).alias("slot"), status.alias("status"),
        F.lit("native").alias("outcome"), F.when(F.col("run_id") % 8 != 4, "pass").alias("verdict"), F.when(F.col("item_id") % 7 == 0, "old").otherwise("new").alias("evaluator_version"),
    )
    planted = rows.where("item_set = 'plant'").select("image_sha", F.concat(F.lit("sha"), F.col("source_id")).alias("source_sha"), "mutation", *labels)
    verdict = F.when(F.col("technical"), "pass").otherwise("fail")
    return G.Files(
        outputs, rows.where("label_source = 'human'").select("image_sha", F.lit("1").alias("rubric_version"), *labels), planted,
        rows.where("item_id % 3 <> 0").select("image_sha", F.lit("new").alias("version"), verdict.alias("verdict"), *DIMENSIONS),
        table(spark, sf_dir, "v_checks").select(F.concat(F.lit("sha"), F.col("item_id")).alias("image_sha"), F.col("check_name").alias("name"), "passed"),
    )


_FINALS = "SELECT item_id, CAST(floor(item_id / 5) AS bigint) AS run_id FROM v_items WHERE item_set = 'final'"


@query(
    "golden_import",
    twin(f"""WITH f AS ({_FINALS}), k AS (SELECT item_id, CAST(floor(item_id / 5) AS bigint) AS run_id, item_set FROM v_items WHERE item_set = 'final' OR (item_set = 'nat' AND item_id % 5 = 0)),
      c AS (SELECT k.* FROM k WHERE run_id IN (SELECT run_id FROM f)), known AS (SELECT item_id FROM k UNION SELECT item_id FROM v_items WHERE item_set = 'plant'),
      e AS (SELECT item_id FROM c WHERE item_id % 3 <> 0 AND item_id % 7 <> 0)
    SELECT 'images' AS name, count(*) AS n FROM known UNION ALL SELECT 'runs', count(*) FROM f UNION ALL SELECT 'candidates', count(*) FROM c
    UNION ALL SELECT 'labels', count(*) + (SELECT count(*) FROM v_items WHERE item_set = 'plant') FROM v_items WHERE label_source = 'human' AND item_id IN (SELECT item_id FROM known)
    UNION ALL SELECT 'planted', count(*) FROM v_items WHERE item_set = 'plant'
    UNION ALL SELECT 'evaluations', (SELECT count(*) FROM e) + count(*) FROM known WHERE item_id % 3 <> 0
    UNION ALL SELECT 'events', 2 * (SELECT count(*) FROM f) + (SELECT count(*) FROM c) + count(*) FROM e"""),
)
def golden_import(spark, sf_dir):
    """Rows of each table after two imports, the second of which adds nothing."""
    files = G.settled(golden_files(spark, sf_dir))
    nothing = G.Tables(**{name: spark.createDataFrame([], schema) for name, schema in EMPTY.items()})
    once = G.golden_import(files, nothing)
    return G.golden_import(files, G.Tables(**{name: written(getattr(once, name)) for name in EMPTY})).counts()
