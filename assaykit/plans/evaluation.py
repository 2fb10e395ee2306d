"""Queries of the meta-evaluation and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaykit.operators import metrics as M
from assaykit.plans.registry import query
from assaykit.sources.bridge import table, twin


def items(spark, sf_dir):
    return M.items_from_wide(table(spark, sf_dir, "v_items"))


OUTCOME = """SELECT *, CASE WHEN label IS NULL OR NOT assessed THEN NULL WHEN NOT label AND coalesce(predicted, false) = false THEN 'tp'
  WHEN coalesce(predicted, false) = false THEN 'fp' WHEN NOT label THEN 'fn' ELSE 'tn' END AS outcome FROM v_dims"""
COUNTS = """CAST(count(outcome) AS bigint) AS n, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn,
  count(*) FILTER (outcome = 'tn') AS tn, count(*) FILTER (label IS NOT NULL AND NOT assessed) AS not_assessed, count(*) FILTER (label IS NULL) AS unlabelled"""
RATIOS = """round(tp / nullif(tp + fp, 0), 6) AS prec, round(tp / nullif(tp + fn, 0), 6) AS recall,
  CASE WHEN tp + fp = 0 OR tp + fn = 0 THEN NULL WHEN tp = 0 THEN 0.0 ELSE round(2.0 * tp / (2 * tp + fp + fn), 6) END AS f1"""
LABEL = """CASE WHEN label_technical = false OR label_text = false OR label_product = false OR label_context = false OR label_composition = false THEN false
  WHEN label_technical AND label_text AND label_product AND label_context THEN true END"""
PREDICTION = "(coalesce(pred_technical, false) AND NOT (" + " OR ".join(f"(assessed_{d} AND label_{d} IS NOT NULL AND NOT coalesce(pred_{d}, false))" for d in M.DIMENSIONS) + "))"
KAPPA = """n, agree, round(agree / nullif(n, 0), 6) AS agreement,
  round(CASE WHEN n > 0 AND abs(1 - (h * m + (n - h) * (n - m)) / (n * n)) > 1e-9
    THEN (agree / n - (h * m + (n - h) * (n - m)) / (n * n)) / (1 - (h * m + (n - h) * (n - m)) / (n * n)) END, 6) AS kappa"""
AGREE = """count(*) FILTER (human IS NOT NULL AND machine IS NOT NULL) AS n, count(*) FILTER (human = machine) AS agree,
  count(*) FILTER (human AND machine IS NOT NULL) AS h, count(*) FILTER (machine AND human IS NOT NULL) AS m"""
PASSES = " AND ".join(f"(NOT assessed_{d} OR coalesce(pred_{d}, false))" for d in M.DIMENSIONS)
FAILS = " OR ".join(f"(assessed_{d} AND coalesce(NOT pred_{d}, false))" for d in M.DIMENSIONS)


@query("item_outcomes", twin(f"SELECT item_id, dimension, label, assessed, CASE WHEN assessed THEN predicted END AS predicted, outcome FROM ({OUTCOME}) o"))
def item_outcomes(spark, sf_dir):
    return M.with_outcomes(items(spark, sf_dir)).select("item_id", "dimension", "label", "assessed", "predicted", "outcome")


METRICS = f"SELECT dimension, {COUNTS} FROM ({OUTCOME}) o WHERE item_set IN ('nat', 'plant') GROUP BY dimension"


@query("dimension_metrics", twin(f"SELECT dimension, n, tp, fp, fn, tn, not_assessed, unlabelled, {RATIOS} FROM ({METRICS}) c"))
def dimension_metrics(spark, sf_dir):
    return M.dimension_metrics(items(spark, sf_dir))


@query(
    "metrics_by_split",
    twin(f"""SELECT split, dimension, n, tp, fp, fn, tn, not_assessed, unlabelled, {RATIOS} FROM (
      SELECT split, dimension, {COUNTS} FROM ({OUTCOME}) o WHERE item_set IN ('nat', 'plant') GROUP BY GROUPING SETS ((split, dimension), (dimension))) c"""),
)
def metrics_by_split(spark, sf_dir):
    return M.metrics_by_split(items(spark, sf_dir))


AGREEMENT = f"""SELECT {AGREE} FROM (SELECT {LABEL} AS human, CASE WHEN {LABEL} IS NOT NULL THEN {PREDICTION} END AS machine
      FROM v_items WHERE item_set = 'nat' AND label_source = 'human') x"""


@query("human_agreement", twin(f"SELECT {KAPPA} FROM ({AGREEMENT}) c"))
def human_agreement(spark, sf_dir):
    return M.human_agreement(items(spark, sf_dir))


@query(
    "dimension_agreement",
    twin(f"""SELECT item_set, dimension, {KAPPA} FROM (SELECT s.item_set, d.dimension, {AGREE}
      FROM (SELECT DISTINCT item_set FROM v_dims) s CROSS JOIN (SELECT DISTINCT dimension FROM v_dims) d
      LEFT JOIN (SELECT item_set, dimension, CASE WHEN assessed THEN label END AS human, assessed AND coalesce(predicted, false) AS machine FROM v_dims WHERE label_source = 'human') x
      ON x.item_set = s.item_set AND x.dimension = d.dimension GROUP BY s.item_set, d.dimension) c"""),
)
def dimension_agreement(spark, sf_dir):
    return M.dimension_agreement(items(spark, sf_dir))


def _planted(flag: str) -> str:
    return twin(f"""WITH e AS (
      SELECT item_id, mutation, string_agg(dimension, ',' ORDER BY dimension) AS expected, bool_and({flag}) AS caught
      FROM v_dims WHERE item_set = 'plant' AND mutation <> 'none' AND label = false GROUP BY item_id, mutation),
    d AS (SELECT DISTINCT mutation, dimension FROM v_dims WHERE item_set = 'plant' AND mutation <> 'none' AND label = false)
    SELECT mutation, n, caught, missed, expected FROM (SELECT mutation, count(*) AS n, count(*) FILTER (caught) AS caught,
      coalesce(string_agg(CAST(item_id AS varchar), ',' ORDER BY item_id) FILTER (NOT caught), '') AS missed FROM e GROUP BY mutation) a
    JOIN (SELECT mutation, string_agg(dimension, ',' ORDER BY dimension) AS expected FROM d GROUP BY mutation) b USING (mutation)""")


@query("planted_classes", _planted("assessed AND coalesce(predicted, false) = false"))
def planted_classes(spark, sf_dir):
    found = M.planted_classes(items(spark, sf_dir))
    return found.withColumn("missed", F.array_join(F.col("missed").cast("array<string>"), ","))


@query("planted_classes_strict", _planted("assessed AND coalesce(NOT predicted, false)"))
def planted_classes_strict(spark, sf_dir):
    found = M.planted_classes(items(spark, sf_dir), strict=True)
    return found.withColumn("missed", F.array_join(F.col("missed").cast("array<string>"), ","))


@query("known_good", twin(f"SELECT count(*) AS n, count(*) FILTER ({PASSES}) AS passed FROM v_items WHERE item_set = 'plant' AND mutation = 'none'"))
def known_good(spark, sf_dir):
    return M.known_good(items(spark, sf_dir))


RULED = "SELECT version, item_id, dimension FROM v_dims WHERE item_id % 50 IN (0, 5) AND dimension IN ('text', 'context')"


@query(
    "disputed_metrics",
    twin(f"""WITH r AS ({RULED}), o AS ({OUTCOME}), k AS (
      SELECT o.*, (r1.item_id IS NOT NULL) OR (r2.item_id IS NOT NULL AND coalesce(o.label, false)) AS dropped FROM o
      LEFT JOIN r r1 ON o.version = r1.version AND o.item_id = r1.item_id AND o.dimension = r1.dimension
      LEFT JOIN r r2 ON o.version = r2.version AND o.source_id = r2.item_id AND o.dimension = r2.dimension
      WHERE o.item_set IN ('nat', 'plant')),
    c AS (SELECT dimension, 'all' AS rows, {COUNTS} FROM k GROUP BY dimension UNION ALL SELECT dimension, 'undisputed', {COUNTS} FROM k WHERE NOT dropped GROUP BY dimension)
    SELECT dimension, rows, n, tp, fp, fn, tn, not_assessed, unlabelled, {RATIOS} FROM c"""),
)
def disputed_metrics(spark, sf_dir):
    it = items(spark, sf_dir)
    rulings = it.where("item_id % 50 IN (0, 5)").select("version", "item_id", F.explode(F.array(F.lit("text"), F.lit("context"))).alias("dimension"))
    return M.disputed(it, rulings)


LAYERS = """SELECT item_id, dimension, method AS layer, CASE WHEN coalesce(bool_or(NOT passed), false) THEN false WHEN bool_or(passed IS NULL) THEN NULL ELSE true END AS verdict,
  count(*) AS n FROM v_checks GROUP BY item_id, dimension, method"""


_FIVE = ", ".join(f"'{d}', {d}_pass" for d in M.DIMENSIONS)


@query(
    "layer_verdicts",
    twin(f"""WITH l AS (SELECT *, sum(n) OVER (PARTITION BY item_id, dimension) AS every FROM ({LAYERS}) x),
    d AS (SELECT item_id, dimension, CASE WHEN coalesce(bool_or(NOT passed), false) THEN false WHEN bool_or(passed IS NULL) THEN NULL ELSE true END AS passed
      FROM ({" UNION ALL ".join(f"SELECT candidate_id AS item_id, '{d}' AS dimension, {d}_pass AS passed FROM v_evaluations" for d in M.DIMENSIONS)}) e GROUP BY item_id, dimension)
    SELECT d.item_id, d.dimension, l.layer, CASE WHEN l.n = l.every THEN d.passed ELSE l.verdict END AS verdict, l.n FROM l JOIN d ON l.item_id IS NOT DISTINCT FROM d.item_id AND l.dimension = d.dimension
    UNION ALL SELECT d.item_id, d.dimension, 'combined', d.passed, CAST(coalesce(sum(l.n), 0) AS bigint) FROM d LEFT JOIN l ON l.item_id IS NOT DISTINCT FROM d.item_id AND l.dimension = d.dimension
      GROUP BY d.item_id, d.dimension, d.passed"""),
)
def layer_verdicts(spark, sf_dir):
    """The own verdicts of dimensions are those of v_evaluations."""
    dims = table(spark, sf_dir, "v_evaluations").select(F.col("candidate_id").alias("item_id"), F.expr(f"stack({len(M.DIMENSIONS)}, {_FIVE}) AS (dimension, passed)"))
    return M.layer_verdicts(table(spark, sf_dir, "v_checks"), dims)


@query(
    "layer_ablation",
    twin(f"""WITH l AS ({LAYERS}), e AS (SELECT item_id, dimension, layer, verdict FROM l UNION ALL
      SELECT item_id, dimension, 'combined', NOT bool_or(NOT coalesce(verdict, false)) FROM l GROUP BY item_id, dimension),
    t AS (SELECT candidate_id AS item_id, version, 'text' AS dimension, text_pass AS label FROM v_evaluations UNION ALL SELECT candidate_id, version, 'product', product_pass FROM v_evaluations),
    o AS (SELECT version, layer, dimension, CASE WHEN NOT label AND NOT coalesce(verdict, false) THEN 'tp' WHEN NOT coalesce(verdict, false) THEN 'fp' WHEN NOT label THEN 'fn' ELSE 'tn' END AS outcome
      FROM t JOIN e USING (item_id, dimension) WHERE label IS NOT NULL),
    c AS (SELECT version, layer, dimension, count(*) AS n, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn,
      count(*) FILTER (outcome = 'tn') AS tn FROM o GROUP BY GROUPING SETS ((version, layer, dimension), (layer, dimension)))
    SELECT version, layer, dimension, n, tp, fp, fn, tn, {RATIOS} FROM c"""),
)
def layer_ablation(spark, sf_dir):
    ev = table(spark, sf_dir, "v_evaluations")
    labels = ev.select(F.col("candidate_id").alias("item_id"), "version", F.expr("stack(2, 'text', text_pass, 'product', product_pass) AS (dimension, label)"))
    checks = table(spark, sf_dir, "v_checks").repartition("item_id", "dimension")  # one shuffle for the layers, their list and the join
    return M.ablation(labels, M.layer_verdicts(checks))


@query(
    "compare_versions",
    twin("""SELECT version, item_set, dimension, count(*) AS n, round(avg(CAST(label AS int)), 6) AS human_pass_rate,
      round(avg(CAST(coalesce(predicted, false) AS int)), 6) AS evaluator_pass_rate FROM v_dims WHERE label IS NOT NULL AND assessed GROUP BY version, item_set, dimension"""),
)
def compare_versions(spark, sf_dir):
    return M.compare_versions(items(spark, sf_dir))


GRID = [400.0, 800.0, 1200.0, 1600.0, 2400.0, 3200.0, 4800.0, 6400.0]


@query(
    "threshold_sweep",
    twin(f"""WITH g AS (SELECT unnest({GRID})::double AS threshold), c AS (
      SELECT split, threshold, count(*) FILTER (NOT label_text AND n_chars < threshold) AS tp, count(*) FILTER (label_text AND n_chars < threshold) AS fp,
        count(*) FILTER (NOT label_text AND n_chars >= threshold) AS fn, count(*) FILTER (label_text AND n_chars >= threshold) AS tn
      FROM v_items CROSS JOIN g WHERE label_text IS NOT NULL GROUP BY split, threshold),
    r AS (SELECT split, threshold, tp, fp, fn, tn, {RATIOS} FROM c)
    SELECT r.* FROM r WHERE threshold = (SELECT threshold FROM r WHERE split = 'calibration' ORDER BY coalesce(f1, -1) DESC, threshold LIMIT 1)"""),
)
def threshold_sweep(spark, sf_dir):
    wide = table(spark, sf_dir, "v_items").where("label_text IS NOT NULL")
    return M.threshold_sweep(wide.select("split", F.col("n_chars").cast("double").alias("score"), F.col("label_text").alias("label")), GRID)


VERDICT = f"CASE WHEN {FAILS} THEN 'fail' WHEN NOT ({PASSES}) THEN 'unverified' ELSE 'pass' END"


def _disagreements(label: str) -> str:
    return twin(f"""SELECT item_id, version, label, verdict FROM (SELECT item_id, version, {label} AS label, {VERDICT} AS verdict FROM v_items WHERE label_source = 'human') x
      WHERE label IS NOT NULL AND label <> (verdict = 'pass')""")


ANY_FALSE = " OR ".join(f"coalesce(NOT label_{d}, false)" for d in M.DIMENSIONS)
ANY = " OR ".join(f"label_{d} IS NOT NULL" for d in M.DIMENSIONS)


@query("disagreements", _disagreements(LABEL))
def disagreements(spark, sf_dir):
    return M.disagreements(items(spark, sf_dir))


@query("disagreements_lenient", _disagreements(f"CASE WHEN {ANY_FALSE} THEN false WHEN {ANY} THEN true END"))
def disagreements_lenient(spark, sf_dir):
    return M.disagreements(items(spark, sf_dir), ignore_nulls=True)


@query(
    "judge_stability",
    twin("""WITH a AS (SELECT run_id * 10 + attempt AS item_id, candidate_no, composition_pass, text_pass FROM v_evaluations WHERE slot = 0),
    b AS (SELECT run_id * 10 + attempt AS item_id, candidate_no, composition_pass, text_pass FROM v_evaluations WHERE slot = 1)
    SELECT count(*) AS items, 2 * count(*) AS checks,
      CAST(sum(CAST(a.text_pass IS DISTINCT FROM b.text_pass AS int) + CAST(a.composition_pass IS DISTINCT FROM b.composition_pass AS int)) AS bigint) AS flips,
      round(sum(CAST(a.text_pass IS DISTINCT FROM b.text_pass AS int) + CAST(a.composition_pass IS DISTINCT FROM b.composition_pass AS int)) / (2 * count(*)), 6) AS rate
    FROM a JOIN b USING (item_id)"""),
)
def judge_stability(spark, sf_dir):
    ev = table(spark, sf_dir, "v_evaluations").withColumn("item_id", F.expr("run_id * 10 + attempt"))
    long = ev.select("item_id", "slot", F.lit("vlm").alias("method"), F.expr("stack(2, 'text', text_pass, 'composition', composition_pass) AS (check_name, passed)"))
    return M.stability(long.where("slot = 0"), long.where("slot = 1"))


@query(
    "compare_baseline",
    twin(f"""WITH m AS (SELECT split, dimension, n, tp, fp, fn, tn, {RATIOS} FROM (SELECT split, dimension, {COUNTS} FROM ({OUTCOME}) o GROUP BY split, dimension) c),
    now AS (SELECT dimension || '_recall' AS name, recall AS v FROM m WHERE split = 'heldout'), base AS (SELECT dimension || '_recall' AS name, recall AS v FROM m WHERE split = 'calibration' AND dimension <> 'text'),
    t AS (SELECT dimension || '_recall' AS name, '>=' AS op, 0.5 AS target FROM m WHERE split = 'heldout' AND dimension <> 'context' UNION ALL SELECT 'cost', '<=', 0.1)
    SELECT name, coalesce(base.v, now.v) AS baseline, now.v AS now, op, CAST(target AS double) AS target, CASE op WHEN '>=' THEN now.v >= target WHEN '<=' THEN now.v <= target END AS met
    FROM now FULL JOIN base USING (name) FULL JOIN t USING (name)"""),
)
def compare_baseline(spark, sf_dir):
    rated = M.confusion(M.with_outcomes(items(spark, sf_dir)), "split", "dimension").select("split", "dimension", F.concat("dimension", F.lit("_recall")).alias("name"), F.col("recall").alias("value"))
    held = rated.where("split = 'heldout'")
    wanted = held.where("dimension <> 'context'").select("name", F.lit(">=").alias("op"), F.lit(0.5).alias("target"))
    targets = wanted.unionByName(spark.createDataFrame([("cost", "<=", 0.1)], "name string, op string, target double"))
    return M.compare_baseline(held, targets, rated.where("split = 'calibration' AND dimension <> 'text'"))


@query(
    "success_criteria",
    twin(f"""WITH c AS (SELECT dimension, n, tp, fp, fn, tn, {RATIOS} FROM ({METRICS}) x), a AS (SELECT {KAPPA} FROM ({AGREEMENT}) y),
    v AS (SELECT dimension || '_recall' AS name, recall AS now, 0.9 AS target FROM c WHERE dimension <> 'composition' UNION ALL
      SELECT dimension || '_precision', prec, 0.85 FROM c WHERE dimension <> 'composition' UNION ALL SELECT 'human_agreement', agreement, 0.85 FROM a)
    SELECT name, now AS baseline, now, '>=' AS op, CAST(target AS double) AS target, now >= target AS met FROM v"""),
)
def success_criteria(spark, sf_dir):
    it = items(spark, sf_dir)
    melted = M.dimension_metrics(it).where("dimension <> 'composition'").select(F.expr("stack(2, dimension || '_recall', recall, 0.9D, dimension || '_precision', prec, 0.85D) AS (name, value, target)"))
    melted = melted.unionByName(M.human_agreement(it).select(F.lit("human_agreement").alias("name"), F.col("agreement").alias("value"), F.lit(0.85).alias("target")))
    targets = melted.select("name", F.lit(">=").alias("op"), "target")
    return M.compare_baseline(melted, targets, melted.limit(0))


@query(
    "evaluation_report",
    twin(f"""SELECT 'dimension' AS section, dimension AS name, n, {RATIOS}, CAST(NULL AS double) AS kappa FROM ({METRICS}) c
    UNION ALL SELECT 'split', split || '/' || dimension, n, {RATIOS}, NULL FROM (SELECT split, dimension, {COUNTS} FROM ({OUTCOME}) o WHERE item_set IN ('nat', 'plant') GROUP BY split, dimension) s
    UNION ALL SELECT 'agreement', 'overall', n, agreement, NULL, NULL, kappa FROM (SELECT {KAPPA} FROM ({AGREEMENT}) a) b"""),
)
def evaluation_report(spark, sf_dir):
    """The flagship: metrics for each dimension and split, and the agreement with people, in one frame."""
    it = items(spark, sf_dir)
    sets = M.metrics_by_split(it).select(
        F.when(F.col("split").isNull(), "dimension").otherwise("split").alias("section"),
        F.concat_ws("/", "split", "dimension").alias("name"), "n", "prec", "recall", "f1", F.lit(None).cast("double").alias("kappa"),
    )
    none = F.lit(None).cast("double")
    agreement = M.human_agreement(it).select(F.lit("agreement").alias("section"), F.lit("overall").alias("name"), "n", F.col("agreement").alias("prec"), none.alias("recall"), none.alias("f1"), "kappa")
    return sets.unionByName(agreement)
