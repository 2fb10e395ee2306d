"""Queries of runs, the ledger and checks, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaykit.operators import checks as C
from assaykit.operators import ledger as L
from assaykit.operators import runs as R
from assaykit.plans.registry import query
from assaykit.sources.bridge import DIMENSIONS, table, twin

NOW = "TIMESTAMP '2002-01-01 00:00:00'"
PASSED = "coalesce(technical_pass, false) AND coalesce(text_pass, false) AND coalesce(product_pass, false) AND coalesce(context_pass, false) AND coalesce(composition_pass, true)"
ROWS = "run_id, tenant, origin, status, CAST(cost_usd AS double) AS cost, created_day"


def runs(spark, sf_dir):
    return table(spark, sf_dir, "v_runs")


def judged(spark, sf_dir):
    """Candidates with their evaluation and whether it passes."""
    ev = table(spark, sf_dir, "v_evaluations").select("candidate_id", *[f"{d}_pass" for d in DIMENSIONS])
    return table(spark, sf_dir, "v_candidates").join(ev, "candidate_id").withColumn("passed", F.expr(PASSED))


JUDGED = f"SELECT c.*, technical_pass, text_pass, product_pass, context_pass, composition_pass, {PASSED} AS passed FROM v_candidates c JOIN (SELECT candidate_id, technical_pass, text_pass, product_pass, context_pass, composition_pass FROM v_evaluations) e USING (candidate_id)"


def shown(df):
    return df.select("run_id", "tenant", "origin", "status", F.col("cost_usd").cast("double").alias("cost"), "created_day")


@query("list_runs", twin(f"SELECT {ROWS} FROM v_runs WHERE tenant = 1 AND origin = 'golden' AND status = 'approved'"))
def list_runs(spark, sf_dir):
    return shown(R.list_runs(runs(spark, sf_dir), 1, "golden", "approved"))


@query("stale_runs", twin(f"SELECT {ROWS} FROM v_runs WHERE status IN ('queued', 'generating', 'evaluating') AND coalesce(heartbeat_age, date_diff('second', created_at, {NOW})) > 60"))
def stale_runs(spark, sf_dir):
    aged = runs(spark, sf_dir).withColumn("created_age", F.expr(f"unix_seconds({NOW}) - unix_seconds(CAST(created_at AS timestamp))"))
    return shown(R.stale_runs(aged))


@query("runs_page", twin(f"SELECT {ROWS} FROM v_runs ORDER BY created_at DESC, run_id DESC LIMIT 21"))
def runs_page(spark, sf_dir):
    return shown(R.page(runs(spark, sf_dir), 20))


@query("runs_page_after", twin(f"SELECT {ROWS} FROM v_runs WHERE created_at < TIMESTAMP '1999-06-01' OR (created_at = TIMESTAMP '1999-06-01' AND run_id < 5000) ORDER BY created_at DESC, run_id DESC LIMIT 21"))
def runs_page_after(spark, sf_dir):
    return shown(R.page(runs(spark, sf_dir), 20, R.make_cursor("1999-06-01 00:00:00", 5000)))


@query("items_page", twin("SELECT item_id, version FROM v_items ORDER BY item_id LIMIT 25 OFFSET 50"))
def items_page(spark, sf_dir):
    return R.page_offset(table(spark, sf_dir, "v_items").select("item_id", "version"), [F.asc("item_id")], 25, 50)


LATEST = "SELECT run_id, evaluation_id, version, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY attempt DESC, slot DESC, evaluation_id DESC) AS rn FROM v_evaluations) x WHERE rn = 1"


@query("latest_evaluation", twin(LATEST))
def latest_evaluation(spark, sf_dir):
    return R.latest(table(spark, sf_dir, "v_evaluations"), ["run_id"], [F.desc("attempt"), F.desc("slot"), F.desc("evaluation_id")]).select("run_id", "evaluation_id", "version", "candidate_id")


BEST = f"SELECT run_id, candidate_id, composite, kind FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY composite DESC, attempt, slot, candidate_id) AS rn FROM ({JUDGED}) j WHERE passed) x WHERE rn = 1"


@query("select_best", twin(f"SELECT run_id, candidate_id, composite FROM ({BEST}) b"))
def select_best(spark, sf_dir):
    return R.select_best(judged(spark, sf_dir)).select("run_id", "candidate_id", "composite")


@query(
    "choose_base",
    twin(f"""SELECT run_id, candidate_id, failures FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY failures, composite DESC, attempt, slot, candidate_id) AS rn FROM (
      SELECT *, CASE WHEN NOT technical_pass THEN 4 ELSE coalesce(CAST(NOT product_pass AS int), 0) + coalesce(CAST(NOT context_pass AS int), 0) + coalesce(CAST(NOT composition_pass AS int), 0) END AS failures
      FROM ({JUDGED}) j) k) x WHERE rn = 1"""),
)
def choose_base(spark, sf_dir):
    return R.choose_base(judged(spark, sf_dir)).select("run_id", "candidate_id", "failures")


@query(
    "nat_and_final",
    twin(f"""SELECT run_id, candidate_id, 'nat' AS item_set FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY slot, candidate_id) AS rn FROM v_candidates WHERE attempt = 0) x WHERE rn = 1
      UNION ALL SELECT run_id, candidate_id, 'final' FROM ({BEST}) b"""),
)
def nat_and_final(spark, sf_dir):
    return R.nat_and_final(table(spark, sf_dir, "v_candidates"), R.select_best(judged(spark, sf_dir)))


@query(
    "run_summaries",
    twin(f"""SELECT r.run_id, r.brief_id, c_mktsegment AS segment, r.status, b.composite, b.kind FROM v_runs r JOIN customer c ON r.brief_id = c.c_custkey LEFT JOIN ({BEST}) b ON r.run_id = b.run_id"""),
)
def run_summaries(spark, sf_dir):
    best = R.select_best(judged(spark, sf_dir))
    approved = F.when(F.col("status") == "approved", F.col("candidate_id"))
    rows = runs(spark, sf_dir).join(best.select("run_id", "candidate_id"), "run_id", "left").select("run_id", "brief_id", "status", approved.alias("approved_id"), F.col("candidate_id").alias("best_id"))
    briefs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("brief_id"), F.col("c_mktsegment").alias("segment"))
    return R.run_summaries(rows, briefs, table(spark, sf_dir, "v_candidates")).select("run_id", "brief_id", "segment", "status", "composite", "kind")


@query(
    "run_detail",
    twin("""WITH k AS (SELECT item_id, count(*) AS n, count(*) FILTER (passed) AS p FROM v_checks GROUP BY item_id)
    SELECT c.run_id, count(*) AS candidates, CAST(sum(k.n) AS bigint) AS checks, CAST(sum(k.p) AS bigint) AS passed_checks,
      CAST(sum(4 + CAST(e.composition_pass IS NOT NULL AS int)) AS bigint) AS dimensions, string_agg(CAST(c.candidate_id AS varchar), ',' ORDER BY c.attempt, c.slot, c.candidate_id) AS ids
    FROM v_candidates c JOIN v_evaluations e USING (candidate_id) LEFT JOIN k ON k.item_id = c.candidate_id GROUP BY c.run_id"""),
)
def run_detail(spark, sf_dir):
    doc = R.run_detail(table(spark, sf_dir, "v_candidates"), table(spark, sf_dir, "v_evaluations"), table(spark, sf_dir, "v_checks"))
    total = lambda f: F.aggregate("candidates", F.lit(0).cast("long"), lambda a, c: a + f(c))
    passed = lambda c: F.size(F.filter(c["checks"], lambda k: k["passed"]))
    return doc.select(
        "run_id", F.size("candidates").cast("long").alias("candidates"), total(lambda c: F.size(c["checks"])).alias("checks"), total(passed).alias("passed_checks"),
        total(lambda c: F.size(c["dimensions"])).alias("dimensions"), F.array_join(F.transform("candidates", lambda c: c["candidate_id"].cast("string")), ",").alias("ids"),
    )


@query(
    "model_fallbacks",
    twin("""SELECT run_id, candidate_id, requested_model, served_model FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY attempt, slot, candidate_id) AS rn FROM v_candidates
      WHERE kind <> 'overlay' AND requested_model <> served_model) x WHERE rn = 1"""),
)
def model_fallbacks(spark, sf_dir):
    return R.model_fallbacks(table(spark, sf_dir, "v_candidates"))


@query(
    "image_to_run",
    twin("""SELECT image_id, run_id FROM (SELECT c.part_id AS image_id, r.run_id, row_number() OVER (PARTITION BY c.part_id ORDER BY r.created_at DESC, r.run_id DESC) AS rn
      FROM v_candidates c JOIN v_runs r USING (run_id) WHERE r.origin = 'golden') x WHERE rn = 1"""),
)
def image_to_run(spark, sf_dir):
    return R.image_to_run(table(spark, sf_dir, "v_candidates").select(F.col("part_id").alias("image_id"), "run_id"), runs(spark, sf_dir))


@query(
    "failing_drafts",
    twin(f"""SELECT j.candidate_id, d.brief_id, j.run_id FROM ({JUDGED}) j JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY brief_id ORDER BY created_at DESC, run_id DESC) AS rn
      FROM v_runs WHERE status IN ('approved', 'passed', 'held', 'rejected')) x WHERE rn = 1) d USING (run_id) WHERE j.attempt = 0 AND NOT j.passed"""),
)
def failing_drafts(spark, sf_dir):
    return R.failing_drafts(runs(spark, sf_dir), judged(spark, sf_dir)).select("candidate_id", "brief_id", "run_id")


@query(
    "work_list",
    twin("""SELECT c_custkey AS brief_id, run_id, CASE WHEN status IS NULL THEN 'new' WHEN status IN ('approved', 'passed', 'held', 'rejected') THEN 'skip'
      WHEN status IN ('failed', 'interrupted', 'cancelled') THEN 'redo' WHEN coalesce(heartbeat_age < 60, false) THEN 'in_progress' ELSE 'resume' END AS todo
    FROM customer LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY brief_id ORDER BY created_at DESC, run_id DESC) AS rn FROM v_runs) x WHERE rn = 1) r ON r.brief_id = c_custkey"""),
)
def work_list(spark, sf_dir):
    return R.work_list(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("brief_id")), runs(spark, sf_dir))


def _rank(p: float, col: str, rows: str) -> str:
    return f"(SELECT {col} FROM (SELECT {col}, row_number() OVER (ORDER BY {col}) - 1 AS r, count(*) OVER () AS n FROM {rows} WHERE {col} IS NOT NULL) q WHERE r = CAST(round_even({p} * (n - 1), 0) AS bigint))"


@query(
    "run_metrics",
    twin(f"""WITH w AS (SELECT * FROM v_runs ORDER BY created_at DESC, run_id DESC LIMIT 1000),
    o AS (SELECT DISTINCT run_id FROM w WHERE run_id % 7 = 0)
    SELECT count(*) AS runs, count(*) FILTER (first_attempt_pass IS NOT NULL) AS finished, count(*) FILTER (status = 'approved') AS approved,
      round(count(*) FILTER (status = 'approved') / count(*) FILTER (first_attempt_pass IS NOT NULL), 4) AS approval_rate,
      round(count(*) FILTER (first_attempt_pass) / count(*) FILTER (first_attempt_pass IS NOT NULL), 4) AS first_attempt_rate,
      round(count(*) FILTER (outcome = 'overlay') / count(*) FILTER (outcome IS NOT NULL), 4) AS overlay_share,
      round(avg(CASE WHEN first_attempt_pass IS NOT NULL THEN repair_count END), 4) AS mean_repairs,
      count(*) FILTER (status = 'approved' AND o.run_id IS NOT NULL) AS override_count, round(sum(CAST(cost_usd AS double)), 6) AS total_cost,
      {_rank(0.5, "latency_ms", "w")} AS p50_ms, {_rank(0.95, "latency_ms", "w")} AS p95_ms,
      {", ".join(f"(SELECT round(avg(CAST({d}_pass AS int)), 4) FROM v_evaluations JOIN w USING (run_id)) AS {d}_rate" for d in DIMENSIONS)}
    FROM w LEFT JOIN o USING (run_id)"""),
)
def run_metrics(spark, sf_dir):
    r = runs(spark, sf_dir)
    decisions = r.select("run_id", F.col("run_id").alias("decision_id"), (F.col("run_id") % 7 == 0).alias("is_override"))
    return R.run_metrics(r, decisions, table(spark, sf_dir, "v_evaluations"))


@query(
    "pipeline_quality",
    twin("""SELECT count(*) AS finals, count(*) FILTER (status IN ('approved', 'passed')) AS shipped, round(count(*) FILTER (first_attempt_pass) / count(first_attempt_pass), 6) AS first_attempt_rate,
      round(count(*) FILTER (first_attempt_pass IS NOT NULL AND status IN ('approved', 'passed')) / count(first_attempt_pass), 6) AS after_repair_rate,
      round(count(*) FILTER (outcome = 'native') / count(outcome), 6) AS native_rate, round(avg(repair_count), 6) AS mean_repairs,
      round(sum(CAST(cost_usd AS double)) / count(*) FILTER (status IN ('approved', 'passed')), 6) AS cost_per_shipped,
      round(quantile_cont(latency_ms, 0.5), 3) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 3) AS p95_ms FROM v_runs"""),
)
def pipeline_quality(spark, sf_dir):
    return R.pipeline_quality(runs(spark, sf_dir))


@query(
    "batch_spend",
    twin("""SELECT batch_label, origin, spend, in_flight, spend + (in_flight + 1) * 0.3 > 500 AS refused FROM (
      SELECT batch_label, origin, round(sum(CAST(cost_usd AS double)), 6) AS spend, count(*) FILTER (status IN ('queued', 'generating', 'evaluating')) AS in_flight FROM v_runs GROUP BY batch_label, origin) x"""),
)
def batch_spend(spark, sf_dir):
    return R.batch_spend(runs(spark, sf_dir), 0.3, 500.0)


COST = "SELECT run_id, sum(est_cost_usd) AS cost FROM v_calls GROUP BY run_id"


@query(
    "rollup_runs",
    twin(f"""SELECT j.run_id, bool_or(passed AND attempt = 0) AS first_attempt_pass, max(attempt) AS repairs, count(*) AS candidates, max(b.candidate_id) AS best_id,
      CASE WHEN max(b.kind) = 'overlay' THEN 'overlay' WHEN max(b.candidate_id) IS NOT NULL THEN 'native' END AS outcome, round(coalesce(max(k.cost), 0), 6) AS cost
    FROM ({JUDGED}) j LEFT JOIN ({BEST}) b ON b.run_id = j.run_id LEFT JOIN ({COST}) k ON k.run_id = j.run_id GROUP BY j.run_id"""),
)
def rollup_runs(spark, sf_dir):
    costs = L.run_cost(table(spark, sf_dir, "v_calls"), table(spark, sf_dir, "v_calls"))
    return R.rollup_runs(judged(spark, sf_dir), costs)


@query(
    "link_runs",
    twin("""SELECT m.item_id, CASE WHEN r.run_id IS NOT NULL THEN 'id' WHEN c.run_id IS NOT NULL THEN 'image' ELSE 'create' END AS link, coalesce(r.run_id, c.run_id) AS linked_run
    FROM (SELECT event_id AS item_id, event_id * 3 AS run_id, event_id * 7 AS image_id FROM events) m LEFT JOIN v_runs r ON r.run_id = m.run_id
    LEFT JOIN (SELECT candidate_id, min(run_id) AS run_id FROM v_candidates GROUP BY candidate_id) c ON c.candidate_id = m.image_id"""),
)
def link_runs(spark, sf_dir):
    manifest = table(spark, sf_dir, "events").select(F.col("event_id").alias("item_id"), (F.col("event_id") * 3).alias("run_id"), (F.col("event_id") * 7).alias("image_id"))
    return R.link_runs(manifest, runs(spark, sf_dir), table(spark, sf_dir, "v_candidates"))


@query("verify_refs", twin("SELECT DISTINCT l_partkey * 2 AS ref, p_partkey IS NOT NULL AS valid FROM lineitem LEFT JOIN part ON p_partkey = l_partkey * 2"))
def verify_refs(spark, sf_dir):
    return R.verify_refs(table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 2).alias("ref")), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ref")))


@query(
    "lineage",
    twin("""WITH RECURSIVE k AS (SELECT run_id, candidate_id, CASE WHEN parent_id IN (SELECT candidate_id FROM v_candidates) THEN parent_id END AS parent_id, attempt, slot FROM v_candidates),
    c AS (SELECT *, row_number() OVER (PARTITION BY run_id, parent_id ORDER BY attempt, slot, candidate_id) AS place FROM k),
    tree AS (SELECT candidate_id, chr(CAST(64 + place AS int)) AS label, 0 AS depth FROM c WHERE parent_id IS NULL
      UNION ALL SELECT c.candidate_id, t.label || repeat('′', c.place), t.depth + 1 FROM tree t JOIN c ON c.parent_id = t.candidate_id WHERE t.depth < 16)
    SELECT k.candidate_id, label FROM k LEFT JOIN tree ON tree.candidate_id = k.candidate_id""").replace("WITH v_candidates", "WITH RECURSIVE v_candidates", 1).replace(", RECURSIVE k AS", ", k AS", 1),
)
def lineage(spark, sf_dir):
    return R.lineage(table(spark, sf_dir, "v_candidates")).select("candidate_id", "label")


@query(
    "percentile_nearest",
    twin("SELECT kind, latency_ms AS value FROM (SELECT kind, latency_ms, row_number() OVER (PARTITION BY kind ORDER BY latency_ms, call_id) - 1 AS r, count(*) OVER (PARTITION BY kind) AS n FROM v_calls) q WHERE r = CAST(round_even(0.9 * (n - 1), 0) AS bigint)"),
)
def percentile_nearest(spark, sf_dir):
    return R.nearest_rank(table(spark, sf_dir, "v_calls"), "latency_ms", 0.9, "kind")


@query(
    "ops_summary",
    twin(f"""WITH w AS (SELECT *, CASE WHEN status = 'ok' AND NOT cached THEN latency_ms END AS l FROM (SELECT * FROM v_calls ORDER BY created_at DESC, call_id DESC LIMIT 2000) x)
    SELECT count(*) AS calls, round(sum(est_cost_usd), 6) AS total_cost, round(avg(est_cost_usd), 6) AS mean_cost, round(avg(CAST(cached AS int)), 6) AS cache_rate,
      round(avg(CAST(fallback_used AS int)), 6) AS fallback_rate, round(avg(CAST(status <> 'ok' AS int)), 6) AS error_rate, {_rank(0.5, "l", "w")} AS p50_ms, {_rank(0.95, "l", "w")} AS p95_ms FROM w"""),
)
def ops_summary(spark, sf_dir):
    return L.ops_summary(table(spark, sf_dir, "v_calls"))


@query(
    "ledger_breakdown",
    twin("""SELECT a.kind, calls, uncached, p50_ms, p95_ms, cache_rate, spend, mean_per_run, max_per_run FROM (
      SELECT kind, count(*) AS calls, count(*) FILTER (NOT cached) AS uncached, round(quantile_cont(CASE WHEN NOT cached THEN latency_ms END, 0.5), 3) AS p50_ms,
        round(quantile_cont(CASE WHEN NOT cached THEN latency_ms END, 0.95), 3) AS p95_ms, round(avg(CAST(cached AS int)), 6) AS cache_rate, round(sum(est_cost_usd), 6) AS spend FROM v_calls GROUP BY kind) a
    JOIN (SELECT kind, round(avg(n), 6) AS mean_per_run, max(n) AS max_per_run FROM (SELECT kind, run_id, count(*) AS n FROM v_calls GROUP BY kind, run_id) x GROUP BY kind) b USING (kind)"""),
)
def ledger_breakdown(spark, sf_dir):
    return L.ledger_breakdown(table(spark, sf_dir, "v_calls"))


@query(
    "run_cost",
    twin("SELECT r.run_id, round(coalesce(c.cost, 0), 6) AS cost FROM (SELECT DISTINCT run_id FROM v_runs) r LEFT JOIN (SELECT run_id, sum(est_cost_usd) AS cost FROM v_calls WHERE kind <> 'error' GROUP BY run_id) c USING (run_id)"),
)
def run_cost(spark, sf_dir):
    return L.run_cost(table(spark, sf_dir, "v_calls"), runs(spark, sf_dir), "error")


@query(
    "daily_budget",
    twin("""SELECT created_day AS day, round(sum(est_cost_usd), 6) AS spend, round(sum(est_cost_usd), 6) > 16 AS over,
      86400 - CAST(floor(epoch(max(created_at))) - epoch(date_trunc('day', max(created_at))) AS bigint) AS resets_in_s FROM v_calls GROUP BY created_day"""),
)
def daily_budget(spark, sf_dir):
    return L.daily_budget(table(spark, sf_dir, "v_calls"), 16.0)


PRICES = [("model", "tokens", 2.5), ("model1", "tokens", 5.0), ("model2", "seconds", 0.02), ("mod", "seconds", 0.01), ("model3", "images", 0.04)]
PRICE_ROWS = ", ".join(f"('{a}', '{b}', {c}::double)" for a, b, c in PRICES)
UNITS = "SELECT call_id, model, CASE call_id % 4 WHEN 0 THEN 'tokens' WHEN 1 THEN 'seconds' WHEN 2 THEN 'images' ELSE 'bytes' END AS unit_type, CAST(k * 100 + 1 AS double) AS units FROM {v_calls}"


@query(
    "price_calls",
    twin(f"""WITH u AS ({UNITS.replace("{v_calls}", "v_calls")}), p(prefix, unit_type, price) AS (VALUES {PRICE_ROWS})
    SELECT call_id, round(coalesce(max_by(units * price / CASE WHEN u.unit_type = 'tokens' THEN 1000000 ELSE 1 END, length(prefix)), 0), 8) AS cost
    FROM u LEFT JOIN p ON p.unit_type = u.unit_type AND starts_with(u.model, p.prefix) GROUP BY call_id"""),
)
def price_calls(spark, sf_dir):
    calls = spark.sql(UNITS, v_calls=table(spark, sf_dir, "v_calls"))
    return L.price_calls(calls, spark.createDataFrame(PRICES, "prefix string, unit_type string, price double"))


@query(
    "call_demand",
    twin("SELECT call_id, run_id, count(*) OVER (PARTITION BY run_id ORDER BY created_at RANGE BETWEEN INTERVAL '86399.999999 seconds' PRECEDING AND CURRENT ROW) AS in_window FROM v_calls"),
)
def call_demand(spark, sf_dir):
    return L.demand(table(spark, sf_dir, "v_calls"), "run_id", 86400)


def steps(columns: str, by: str, start: str, step: str, result: str) -> str:
    """SQL that walks the calls of each key in order: state at the start, then a step for each call."""
    text = twin(f"""WITH s AS (SELECT {by} AS key, epoch_us(created_at) AS us, call_id, row_number() OVER (PARTITION BY {by} ORDER BY created_at, call_id) AS n, {columns} FROM v_calls),
    w AS ({start} UNION ALL {step}) SELECT {result} FROM w WHERE n > 0""")
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "rate_limit",
    steps(
        "status", "run_id",
        "SELECT key, CAST(0 AS bigint) AS n, CAST(NULL AS bigint) AS call_id, CAST([] AS bigint[]) AS held, false AS admitted, CAST(NULL AS bigint) AS retry_after FROM s WHERE n = 1",
        """SELECT key, n, call_id, CASE WHEN len(live) < 2 THEN list_append(live, us) ELSE live END, len(live) < 2, CASE WHEN len(live) >= 2 THEN CAST(ceil((live[1] + 86400000000 - us) / 1000000) AS bigint) END
          FROM (SELECT s.key, s.n, s.call_id, s.us, [h FOR h IN w.held IF s.us - h < 86400000000] AS live FROM w JOIN s ON s.key = w.key AND s.n = w.n + 1) x""",
        "call_id, admitted, retry_after",
    ),
)
def rate_limit(spark, sf_dir):
    return L.rate_limit(table(spark, sf_dir, "v_calls"), "run_id", 2, 86400)


@query(
    "budget_walk",
    steps(
        "coalesce(est_cost_usd, 0) AS cost", "run_id",
        "SELECT key, CAST(0 AS bigint) AS n, CAST(NULL AS bigint) AS call_id, us AS began, CAST(0 AS double) AS total, 0 AS used, false AS told, CAST(NULL AS varchar) AS blocked_by, false AS warned FROM s WHERE n = 1",
        """SELECT key, n, call_id, began, CASE WHEN b IS NULL THEN total + cost ELSE total END, CASE WHEN b IS NULL THEN used + 1 ELSE used END, told OR (b IS NULL AND total + cost >= 0.8 * 1.5), b, b IS NULL AND NOT told AND total + cost >= 0.8 * 1.5
          FROM (SELECT s.key, s.n, s.call_id, s.cost, w.began, w.total, w.used, w.told, CASE WHEN s.us - w.began > 1728000000000 THEN 'deadline' WHEN w.used >= 40 THEN 'calls' WHEN w.total + s.cost > 1.5 + 1e-9 THEN 'budget' END AS b
            FROM w JOIN s ON s.key = w.key AND s.n = w.n + 1) x""",
        "call_id, blocked_by, warned, round(total, 6) AS spent",
    ),
)
def budget_walk(spark, sf_dir):
    return L.budget_walk(table(spark, sf_dir, "v_calls"), 1.5, 40, 20 * 86_400_000)


@query(
    "failure_streaks",
    twin("""SELECT call_id, model, count(*) OVER (PARTITION BY model, island ORDER BY created_at, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS streak FROM (
      SELECT *, sum(CAST(status = 'ok' AS int)) OVER (PARTITION BY model ORDER BY created_at, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM v_calls) x WHERE status = 'error'"""),
)
def failure_streaks(spark, sf_dir):
    return L.failure_streaks(table(spark, sf_dir, "v_calls"))


@query(
    "breaker_states",
    steps(
        "status", "run_id",
        "SELECT key, CAST(0 AS bigint) AS n, CAST(NULL AS bigint) AS call_id, CAST(NULL AS varchar) AS state, 0 AS bad, CAST(NULL AS bigint) AS opened FROM s WHERE n = 1",
        """SELECT key, n, call_id, state, CASE WHEN state = 'open' OR status = 'blocked' THEN bad WHEN status = 'ok' THEN 0 ELSE bad + 1 END,
          CASE WHEN state = 'open' OR status = 'blocked' THEN opened WHEN status = 'ok' THEN NULL WHEN state = 'half_open' OR bad + 1 >= 2 THEN us ELSE opened END
          FROM (SELECT s.key, s.n, s.call_id, s.us, s.status, w.bad, w.opened, CASE WHEN w.opened IS NULL THEN 'closed' WHEN s.us - w.opened >= 86400000000 THEN 'half_open' ELSE 'open' END AS state
            FROM w JOIN s ON s.key = w.key AND s.n = w.n + 1) x""",
        "call_id, state",
    ),
)
def breaker_states(spark, sf_dir):
    return L.breaker_states(table(spark, sf_dir, "v_calls"), "run_id", 2, 86400)


@query("count_by_kind", twin("SELECT kind, status, count(*) AS n FROM v_calls GROUP BY kind, status"))
def count_by_kind(spark, sf_dir):
    return L.count_by(table(spark, sf_dir, "v_calls"), "kind", "status")


FROM_CHECKS = """SELECT item_id, dimension, CASE WHEN failed <> '' THEN 'fail' WHEN unknown <> '' THEN 'unverified' ELSE 'pass' END AS verdict, round(p / n, 6) AS score, failed, unknown FROM (
  SELECT item_id, dimension, count(*) AS n, count(*) FILTER (passed) AS p, coalesce(string_agg(check_name, ',' ORDER BY check_name) FILTER (NOT passed), '') AS failed,
    coalesce(string_agg(check_name, ',' ORDER BY check_name) FILTER (passed IS NULL), '') AS unknown FROM v_checks GROUP BY item_id, dimension) x"""


@query("dimension_from_checks", twin(FROM_CHECKS))
def dimension_from_checks(spark, sf_dir):
    return C.dimension_from_checks(table(spark, sf_dir, "v_checks"))


@query(
    "overall_verdict",
    twin(f"SELECT item_id, CASE WHEN bool_or(verdict = 'fail') THEN 'fail' WHEN bool_or(verdict = 'unverified') THEN 'unverified' ELSE 'pass' END AS verdict, round(avg(score), 4) AS composite FROM ({FROM_CHECKS}) d GROUP BY item_id"),
)
def overall_verdict(spark, sf_dir):
    return C.overall_verdict(C.dimension_from_checks(table(spark, sf_dir, "v_checks")))


CHECKLIST = "SELECT run_id AS item_id, candidate_no AS check_name, CASE WHEN part_id % 3 = 0 THEN 'should' ELSE 'must' END AS severity, CASE WHEN line_status = 'O' THEN 'yes' ELSE 'no' END AS pass_on FROM {v_candidates}"
ANSWERS = "SELECT run_id AS item_id, candidate_no AS check_name, CASE WHEN supplier_id % 13 = 0 THEN 'unsure' WHEN supplier_id % 5 = 0 THEN 'no' WHEN line_status = 'O' THEN 'yes' ELSE 'no' END AS answer FROM {v_candidates} WHERE part_id % 10 <> 0"


@query(
    "score_checklist",
    twin(f"""WITH c AS ({CHECKLIST.replace("{", "").replace("}", "")}), a AS ({ANSWERS.replace("{", "").replace("}", "")}), k AS (SELECT c.item_id, severity, answer = pass_on AS ok FROM c LEFT JOIN a USING (item_id, check_name))
    SELECT item_id, CASE WHEN count(*) FILTER (severity = 'must' AND NOT ok) > 0 THEN false WHEN count(*) FILTER (severity = 'must' AND ok IS NULL) = 0 THEN true END AS passed,
      round(coalesce(count(*) FILTER (severity = 'should' AND ok) / nullif(count(*) FILTER (severity = 'should'), 0), 1.0), 6) AS score FROM k GROUP BY item_id"""),
)
def score_checklist(spark, sf_dir):
    v = table(spark, sf_dir, "v_candidates")
    return C.score_checklist(spark.sql(CHECKLIST, v_candidates=v), spark.sql(ANSWERS, v_candidates=v))


@query(
    "quality_rules",
    twin("""SELECT 'price_positive' AS rule, count(*) FILTER (NOT l_extendedprice > 0) AS violations FROM lineitem
    UNION ALL SELECT 'returned_is_final', count(*) FILTER (l_returnflag = 'R' AND NOT l_linestatus = 'F') FROM lineitem UNION ALL SELECT 'flag_known', count(*) FILTER (l_returnflag NOT IN ('A', 'N')) FROM lineitem
    UNION ALL SELECT 'unique_line', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) u
    UNION ALL SELECT 'order_exists', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)"""),
)
def quality_rules(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rules = {"price_positive": F.col("l_extendedprice") > 0, "returned_is_final": (F.col("l_returnflag") != "R") | (F.col("l_linestatus") == "F"), "flag_known": F.col("l_returnflag").isin("A", "N")}
    many = C.unique_rule(li, "l_orderkey", "l_linenumber").agg(F.lit("unique_line").alias("rule"), F.count("*").alias("violations"))
    lost = C.foreign_rule(li, "l_orderkey", table(spark, sf_dir, "orders"), "o_orderkey").agg(F.lit("order_exists").alias("rule"), F.count("*").alias("violations"))
    return C.row_rules(li, rules).unionByName(many).unionByName(lost)


@query(
    "range_checks",
    twin("""SELECT p_partkey AS part_id, p_size / 40.0 BETWEEN 0.6 AND 1.25 AS ratio_ok, CASE WHEN p_size / e IS NULL THEN 'unknown' WHEN p_size / e > 4 OR p_size / e < 0.12 THEN 'fail'
      WHEN p_size / e > 2 OR p_size / e < 0.5 THEN 'note' ELSE 'pass' END AS area FROM (SELECT *, nullif(p_partkey % 30, 0) AS e FROM part) p"""),
)
def range_checks(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    expected = F.when(F.col("p_partkey") % 30 != 0, F.col("p_partkey") % 30)
    return part.select(F.col("p_partkey").alias("part_id"), C.ratio_check(F.col("p_size") / 40.0).alias("ratio_ok"), C.area_check(F.col("p_size"), expected).alias("area"))


C.register_check("length", "technical", lambda: F.length("body"), 400, lambda v, t: v >= t)
# of an empty text NaN, which passes, as 0 / 0 does in SQL
C.register_check("digits", "text", lambda: F.when(F.length("body") == 0, float("nan")).otherwise(F.length(F.translate("body", "0123456789", "")) * 1.0 / F.length("body")), 0.99, lambda v, t: v >= t)
C.register_check("lines", "composition", lambda: F.length("body") - F.length(F.replace("body", F.lit("\n"), F.lit(""))), 1, lambda v, t: v >= t, severity="should")


@query(
    "run_checks",
    twin("""SELECT item_id, 'technical' AS dimension, 'length' AS check_name, 'must' AS severity, length(body) >= 400 AS passed, length(body)::double AS value FROM v_items
    UNION ALL SELECT item_id, 'text', 'digits', 'must', length(translate(body, '0123456789', '')) / length(body) >= 0.99, length(translate(body, '0123456789', '')) / length(body) FROM v_items
    UNION ALL SELECT item_id, 'composition', 'lines', 'should', length(body) - length(replace(body, chr(10), '')) >= 1, (length(body) - length(replace(body, chr(10), '')))::double FROM v_items"""),
)
def run_checks(spark, sf_dir):
    """Of v_items; its join with labels only repeats items that have several, so checks go through it in place of texts."""
    bodies = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("body"))
    rows = C.run_checks(bodies, "item_id", ["length", "digits", "lines"]).select("item_id", "dimension", "check_name", "severity", "passed", "value")
    return rows.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id")), "item_id", "left")


NAMES = """SELECT candidate_id AS item_id, CAST(part_id % 4 AS double) AS value, part_id % 2 = 0 AS gating, x.dimension, x.check_name, CASE WHEN (part_id + x.n) % 11 = 0 THEN NULL ELSE (part_id + x.n) % 5 <> 0 END AS passed
FROM {v_candidates} CROSS JOIN (VALUES (1, 'technical', 'blank'), (2, 'product', 'product_count'), (3, 'product', 'vlm_shape'), (4, 'product', 'color_delta_e'), (5, 'context', 'snow'), (6, 'composition', 'comp.scale_ratio'),
  (7, 'composition', 'comp.realistic_scale'), (8, 'composition', 'comp.natural_integration'), (9, 'text', 'ocr_cer'), (10, 'text', 'vlm_readback'), (11, 'text', 'critical_tokens'), (12, 'text', 'stray_text'), (13, 'text', 'legibility')) AS x(n, dimension, check_name)"""


@query(
    "failure_codes",
    twin(f"""WITH c AS ({NAMES.replace("{", "").replace("}", "")})
    SELECT item_id, code, string_agg(DISTINCT check_name, ',' ORDER BY check_name) AS checks FROM (SELECT item_id, check_name, CASE
      WHEN dimension = 'technical' THEN 'TECHNICAL' WHEN check_name = 'product_count' AND value < 1 THEN 'PRODUCT_MISSING' WHEN check_name = 'product_count' THEN 'PRODUCT_DUPLICATED'
      WHEN check_name LIKE 'vlm!_%' ESCAPE '!' AND dimension = 'product' THEN 'PRODUCT_CHECK' WHEN dimension = 'context' AND gating THEN 'CONTEXT_CHECK' WHEN check_name = 'color_delta_e' THEN 'PRODUCT_COLOR_DRIFT'
      WHEN check_name IN ('comp.realistic_scale', 'comp.scale_sanity', 'comp.scale_ratio') THEN 'COMPOSITION_SCALE' WHEN check_name = 'comp.natural_integration' THEN 'COMPOSITION_INTEGRATION'
      WHEN check_name IN ('ocr_cer', 'vlm_readback') THEN 'TEXT_MISMATCH' WHEN check_name = 'critical_tokens' THEN 'TEXT_TOKENS_MISSING' WHEN check_name IN ('stray_text', 'vlm_stray_text') THEN 'STRAY_TEXT'
      WHEN check_name = 'overlay_pending' THEN 'OVERLAY_PENDING' END AS code FROM c WHERE NOT passed) x WHERE code IS NOT NULL GROUP BY item_id, code"""),
)
def failure_codes(spark, sf_dir):
    return C.failure_codes(spark.sql(NAMES, v_candidates=table(spark, sf_dir, "v_candidates")))


TRIAGE = """SELECT e.*, attempt AS repairs, CAST(e.candidate_no % 2 AS int) AS text_repairs, c.part_id % 4 <> 0 AS affordable, e.run_id % 6 = 0 AS overlay,
  c.part_id % 9 = 1 AS stray, c.part_id % 10 = 2 AS in_zone, e.candidate_no % 4 <> 0 AS composition_judged FROM {v_evaluations} e JOIN (SELECT candidate_id, part_id FROM {v_candidates}) c ON c.candidate_id = e.candidate_id"""


@query(
    "triage",
    twin(f"""WITH t AS (SELECT *, repairs < 2 AND affordable AS can FROM ({TRIAGE.replace("{", "").replace("}", "")}) x), r AS (SELECT evaluation_id,
      concat_ws(',', CASE WHEN NOT technical_pass THEN 'technical' END, CASE WHEN NOT text_pass THEN 'text' END, CASE WHEN NOT product_pass THEN 'product' END, CASE WHEN NOT context_pass THEN 'context' END,
        CASE WHEN NOT composition_pass THEN 'composition' END) AS codes,
      CASE WHEN technical_pass AND text_pass AND product_pass AND context_pass AND (composition_pass OR composition_pass IS NULL AND NOT composition_judged) THEN 'passed'
        WHEN technical_pass IS DISTINCT FROM true THEN CASE WHEN can THEN 'technical' ELSE 'exhausted' END
        WHEN product_pass = false OR context_pass = false OR composition_pass = false THEN
          CASE WHEN NOT can THEN 'exhausted' WHEN product_pass = false THEN 'product' WHEN context_pass = false THEN 'context' ELSE 'composition' END
        WHEN product_pass IS NULL OR context_pass IS NULL OR composition_pass IS NULL AND composition_judged THEN 'unverified'
        WHEN stray OR in_zone THEN CASE WHEN can THEN 'text_outside_zone' ELSE 'exhausted' END
        WHEN overlay THEN 'overlay_only' WHEN text_pass = false AND can AND text_repairs < 1 THEN 'text_in_zone' ELSE 'text_exhausted' END AS route FROM t)
    SELECT *, CASE route WHEN 'passed' THEN 'approve' WHEN 'technical' THEN 'regenerate' WHEN 'text_outside_zone' THEN 'clean_plate' WHEN 'text_in_zone' THEN 'repair_text' WHEN 'overlay_only' THEN 'overlay'
      WHEN 'text_exhausted' THEN 'overlay' WHEN 'unverified' THEN 'needs_review' WHEN 'exhausted' THEN 'needs_review' ELSE 'repair_' || route END AS action FROM r"""),
)
def triage(spark, sf_dir):
    return C.triage(spark.sql(TRIAGE, v_evaluations=table(spark, sf_dir, "v_evaluations"), v_candidates=table(spark, sf_dir, "v_candidates")))
