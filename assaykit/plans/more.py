"""Queries of enrichment, curation and write-side operators, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assaykit.functions import enrich as N
from assaykit.operators import curation as K
from assaykit.operators import metrics as M
from assaykit.operators import runs as R
from assaykit.operators import writes as W
from assaykit.plans.evaluation import FAILS, OUTCOME, PASSES, VERDICT, items
from assaykit.plans.operations import JUDGED, judged
from assaykit.plans.registry import query
from assaykit.sources.bridge import DIMENSIONS, table, twin


@query("filter_items", twin(f"SELECT DISTINCT item_id FROM ({OUTCOME}) o WHERE item_set <> 'plant' AND dimension = 'text' AND outcome = 'fp'"))
def filter_items(spark, sf_dir):
    return K.filter_items(M.with_outcomes(items(spark, sf_dir)), "natural", "text", "fp")


@query("filter_items_any", twin(f"SELECT DISTINCT item_id FROM ({OUTCOME}) o WHERE item_set = 'plant' AND outcome = 'tp'"))
def filter_items_any(spark, sf_dir):
    return K.filter_items(M.with_outcomes(items(spark, sf_dir)), "planted", outcome="tp")


@query("gallery", twin(f"SELECT item_id, product_id FROM v_items WHERE item_set = 'nat' AND {VERDICT} = 'fail' AND assessed_context AND coalesce(NOT pred_context, false)"))
def gallery(spark, sf_dir):
    failed = F.transform(F.filter(F.map_entries("dimensions"), lambda e: ~e["value"]), lambda e: e["key"])
    rows = items(spark, sf_dir).withColumns({"verdict": M.item_verdict(), "failed": failed, "tags": F.array(F.col("split"))})
    return K.gallery(rows, item_set="nat", verdict="fail", failed="context").select("item_id", "product_id")


@query(
    "eligible_bases",
    twin("""SELECT item_id FROM v_items WHERE item_set = 'nat' AND ((label_technical AND label_text AND label_product AND label_context) OR
      (label_technical IS NULL AND label_text IS NULL AND label_product IS NULL AND label_context IS NULL AND label_composition IS NULL))"""),
)
def eligible_bases(spark, sf_dir):
    return K.eligible_bases(items(spark, sf_dir), M.CORE, assume_pass=True).select("item_id")


@query(
    "reason_targets",
    twin("""SELECT item_id, concat_ws(',', CASE WHEN NOT label_product THEN 'product' END, CASE WHEN NOT label_context THEN 'context' END) AS failed FROM v_items
      WHERE item_set IN ('nat', 'final') AND (coalesce(NOT label_product, false) OR coalesce(NOT label_context, false))"""),
)
def reason_targets(spark, sf_dir):
    return K.reason_targets(items(spark, sf_dir)).select("item_id", F.array_join("failed", ",").alias("failed"))


OUT = "SELECT doc_id AS item_id, md5(text) AS sha, CASE WHEN doc_id % 2 = 0 THEN 'nat' ELSE 'final' END AS set FROM {documents} WHERE doc_id % 5 <> 3"
PLANT = "SELECT doc_id AS item_id, md5(text) AS sha, md5(concat(text, CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE '' END)) AS source_sha, doc_id % 3 = 0 AS constructed FROM {documents} WHERE doc_id % 5 = 3"
LAB = "SELECT md5(d.text) AS sha, s.set AS set, min(CAST(l.quality AS int)) = 1 AS ok FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id CROSS JOIN (SELECT 'nat' AS set UNION ALL SELECT 'plant') s GROUP BY md5(d.text), s.set"


def plain(text: str) -> str:
    return text.replace("{", "").replace("}", "")


@query(
    "build_cases",
    f"""WITH o AS ({plain(OUT)}), p AS ({plain(PLANT)}), l AS ({plain(LAB)})
    SELECT item_id, 'natural' AS origin, CASE WHEN l.sha IS NOT NULL THEN 'human' ELSE 'none' END AS label_source, l.ok AS label, false AS warning FROM o LEFT JOIN l ON o.sha = l.sha AND o.set = l.set
    UNION ALL SELECT item_id, 'planted', CASE WHEN l.sha IS NOT NULL THEN 'human' ELSE 'planted' END, CASE WHEN l.sha IS NOT NULL THEN l.ok ELSE constructed END, source_sha NOT IN (SELECT sha FROM o)
    FROM p LEFT JOIN l ON p.sha = l.sha AND l.set = 'plant'""",
)
def build_cases(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return K.build_cases(spark.sql(OUT, documents=d), spark.sql(PLANT, documents=d), spark.sql(LAB, documents=d, labels=lab))


@query(
    "enrich_items",
    """SELECT l_orderkey AS item_id, i.o_custkey AS image_width, s.o_custkey AS source_width, p_brand AS brand, CASE WHEN l_linenumber % 3 <> 0 THEN l_suppkey END AS run_id
    FROM lineitem LEFT JOIN orders i ON i.o_orderkey = l_orderkey LEFT JOIN orders s ON s.o_orderkey = l_orderkey * 2 LEFT JOIN part ON p_partkey = l_partkey""",
)
def enrich_items(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("item_id"), F.col("l_orderkey").alias("image_sha"), (F.col("l_orderkey") * 2).alias("source_sha"), F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("run_id"),
        F.when(F.col("l_linenumber") % 3 == 0, "plant").otherwise("nat").alias("item_set"),
    )
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("width"))
    products = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("brand"))
    return K.enrich_items(rows, images, products).select("item_id", "image_width", "source_width", "brand", "run_id")


NEWLAB = """SELECT l_partkey AS sha, 'nat' AS set, CASE WHEN l_suppkey % 2 = 0 THEN concat('human:', CAST(l_suppkey AS string)) ELSE 'model:x' END AS labeller,
  CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity > 10 END AS technical, l_tax > 0.02 AS text, l_discount < 0.09 AS product FROM {lineitem}"""
OLDLAB = "SELECT p_partkey AS sha, 'nat' AS set, 'human:a' AS labeller, true AS technical, true AS text, p_size > 10 AS product FROM {part} WHERE p_partkey % 2 = 0"


@query(
    "merge_labels",
    f"""WITH n AS ({plain(NEWLAB)}), o AS ({plain(OLDLAB)}) SELECT sha, labeller FROM o UNION ALL
    SELECT sha, min(labeller) FROM n WHERE labeller LIKE 'human:%' AND technical IS NOT NULL AND sha NOT IN (SELECT sha FROM o) GROUP BY sha""",
)
def merge_labels(spark, sf_dir):
    old = spark.sql(OLDLAB, part=table(spark, sf_dir, "part"))
    return K.merge_labels(old, spark.sql(NEWLAB, lineitem=table(spark, sf_dir, "lineitem"))).select("sha", "labeller")


@query("pool_items", twin("SELECT item_set, version, count(*) AS n FROM v_items GROUP BY item_set, version"))
def pool_items(spark, sf_dir):
    it = items(spark, sf_dir)
    parts = [it.where(F.col("item_set") == s) for s in ("nat", "final", "plant")]
    return K.pool(parts[0].drop("mutation"), *parts[1:]).groupBy("item_set", "version").agg(F.count("*").alias("n"))


@query("keep_generated", "SELECT doc_id AS item_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'new' ELSE 'old' END AS made FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'new' FROM labels WHERE doc_id % 2 = 1")
def keep_generated(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"))
    old, new = d.where("item_id % 2 = 0").withColumn("made", F.lit("old")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), F.lit("new").alias("made"))
    return K.keep_generated(old, new, d.select((-F.col("item_id") - 1).alias("item_id")))


@query(
    "diff_sets",
    """SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' ELSE 'both' END AS side FROM (SELECT p_partkey AS k FROM part) a
    FULL JOIN (SELECT DISTINCT l_partkey + 100 AS k FROM lineitem) b ON a.k = b.k""",
)
def diff_sets(spark, sf_dir):
    return K.diff_sets(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), table(spark, sf_dir, "lineitem").select((F.col("l_partkey") + 100).alias("k")), "k")


@query("content_catalog", "SELECT sha256(text) AS sha, max(octet_length(encode(text)))::bigint AS bytes, min(doc_id) AS first_id, count(*) AS copies, substr(sha256(text), 1, 2) AS prefix FROM documents GROUP BY 1, 5")
def content_catalog(spark, sf_dir):
    return K.content_catalog(table(spark, sf_dir, "documents"), "text", "doc_id")


def _version(name: str, columns: list[str]) -> str:
    row = "md5(concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS varchar), '~')" for c in sorted(columns)) + "))"
    fine = f"SELECT substr(h, 1, 5) AS b, md5(string_agg(h, '' ORDER BY h)) AS h, count(*) AS n FROM (SELECT {row} AS h FROM {name}) r GROUP BY 1"
    coarse = f"SELECT substr(b, 1, 2) AS b, md5(string_agg(h, '' ORDER BY b)) AS h, sum(n) AS n FROM ({fine}) f GROUP BY 1"
    return f"SELECT '{name}' AS name, CAST(sum(n) AS bigint) AS rows, substr(md5(string_agg(h, '' ORDER BY b)), 1, 12) AS version FROM ({coarse}) g"


@query("dataset_version", _version("labels", ["doc_id", "quality", "toxic"]) + " UNION ALL " + _version("conversations", ["conv_id", "turn", "role", "text"]) + " UNION ALL " + _version("documents", ["doc_id", "text", "lang", "source", "n_chars"]))
def dataset_version(spark, sf_dir):
    return K.dataset_version({n: table(spark, sf_dir, n) for n in ("labels", "conversations", "documents")})


PLAN = [("typo", 20, 1), ("swap", 15, 2), ("blank", 100000, 4)]


@query(
    "quota_sample",
    f"""WITH p(mutation, k, capability) AS (VALUES {", ".join(map(str, PLAN))}), r AS (SELECT mutation, k, doc_id, row_number() OVER (PARTITION BY mutation ORDER BY md5('7-' || doc_id || '-' || mutation), doc_id) AS place
      FROM documents JOIN p ON (doc_id % 8) & capability = capability)
    SELECT p.mutation, coalesce(taken, 0) AS taken, p.k - coalesce(taken, 0) AS shortfall, bases FROM p LEFT JOIN (
      SELECT mutation, count(*) AS taken, string_agg(CAST(doc_id AS varchar), ',' ORDER BY place) AS bases FROM r WHERE place <= k GROUP BY mutation) t USING (mutation)""",
)
def quota_sample(spark, sf_dir):
    bases = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("base_id"), (F.col("doc_id") % 8).cast("int").alias("capabilities"))
    return K.quota_sample(bases, spark.createDataFrame(PLAN, "mutation string, k int, capability int"))


@query(
    "pack_context",
    "SELECT conv_id, turn, CAST(used AS bigint) AS used FROM (SELECT conv_id, turn, sum(greatest(1, floor(length(text) / 4))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM conversations) x WHERE used <= 300",
)
def pack_context(spark, sf_dir):
    return K.pack(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 300).select("conv_id", "turn", F.col("used").cast("bigint").alias("used"))


@query("stalled", twin(f"SELECT candidate_id, parent_id, composite AS sim FROM ({JUDGED}) j WHERE parent_id IS NOT NULL AND NOT passed AND composite >= 0.98"))
def stalled(spark, sf_dir):
    rows = judged(spark, sf_dir)
    return K.stalled(rows, rows.select("candidate_id", F.col("composite").alias("sim")))


@query(
    "order_checks",
    twin("""SELECT item_id, coalesce(string_agg(check_name, ',' ORDER BY rn) FILTER (rn <= 3), '') AS evidence FROM (
      SELECT item_id, check_name, passed, CASE WHEN NOT passed THEN row_number() OVER (PARTITION BY item_id, coalesce(NOT passed, false) ORDER BY method <> 'deterministic',
        list_position(['technical', 'text', 'product', 'context', 'composition'], dimension), check_name) END AS rn FROM v_checks) x GROUP BY item_id"""),
)
def order_checks(spark, sf_dir):
    return K.order_checks(table(spark, sf_dir, "v_checks"))


@query(
    "numeric_order",
    twin(r"""SELECT split, product_id, row_number() OVER (PARTITION BY split ORDER BY regexp_extract(product_id, '^(\D*)', 1), coalesce(TRY_CAST(regexp_extract(product_id, '(\d+)', 1) AS bigint), 0), product_id) AS place
    FROM (SELECT DISTINCT split, product_id FROM v_items) x"""),
)
def numeric_order(spark, sf_dir):
    rows = table(spark, sf_dir, "v_items").select("split", "product_id").distinct()
    place = F.row_number().over(Window.partitionBy("split").orderBy(*K.numeric_order(F.col("product_id"))))
    return rows.select("split", "product_id", place.alias("place"))


@query(
    "facets",
    twin(f"""SELECT product_id, min_by(CASE WHEN item_id % 3 <> 0 THEN 'N' || item_id END, CASE WHEN item_id % 3 <> 0 THEN item_id END) AS name, count(*) AS items,
      coalesce(string_agg(DISTINCT tag, ',' ORDER BY tag) FILTER (tag NOT IN ('pass', 'fail', 'unverified')), '') AS tags
    FROM (SELECT *, CASE WHEN item_id % 4 = 0 THEN {VERDICT} ELSE split END AS tag FROM v_items) x GROUP BY product_id"""),
)
def facets(spark, sf_dir):
    tag = F.when(F.col("item_id") % 4 == 0, M.item_verdict()).otherwise(F.col("split"))
    rows = items(spark, sf_dir).select("item_id", "product_id", F.when(F.col("item_id") % 3 != 0, F.concat(F.lit("N"), "item_id")).alias("name"), tag.alias("tag"))
    return K.facets(rows)


CHANGES = "SELECT candidate_id, version, composite + 1 AS composite, evaluation_id FROM {v_evaluations} WHERE candidate_no % 3 = 0 UNION ALL SELECT candidate_id, version, composite + 2, evaluation_id + 1 FROM {v_evaluations} WHERE candidate_no = 6"


@query(
    "upsert",
    twin(f"""WITH c AS ({CHANGES.replace("{", "").replace("}", "")}) SELECT candidate_id, version, composite, evaluation_id FROM v_evaluations e WHERE candidate_id NOT IN (SELECT candidate_id FROM c)
      UNION ALL SELECT candidate_id, version, composite, evaluation_id FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id, version ORDER BY evaluation_id DESC) AS rn FROM c) x WHERE rn = 1"""),
)
def upsert(spark, sf_dir):
    ev = table(spark, sf_dir, "v_evaluations")
    return W.upsert(ev.select("candidate_id", "version", "composite", "evaluation_id"), spark.sql(CHANGES, v_evaluations=ev), ["candidate_id", "version"], "evaluation_id")


@query("replace_children", twin("SELECT item_id, check_name FROM v_checks WHERE item_id % 3 <> 0 UNION ALL SELECT item_id, 'redone' FROM (SELECT DISTINCT item_id FROM v_checks WHERE item_id % 3 = 0) x"))
def replace_children(spark, sf_dir):
    old = table(spark, sf_dir, "v_checks").select("item_id", "check_name")
    parents = old.where("item_id % 3 = 0").select("item_id").distinct()
    return W.replace_children(old, parents, parents.withColumn("check_name", F.lit("redone")), "item_id")


@query(
    "cache_apply",
    """SELECT coalesce(p_partkey, k) AS key, CASE WHEN p_partkey IS NULL THEN n - 1 ELSE p_size + coalesce(n, 0) END AS hits, p_partkey IS NULL AS is_new
    FROM (SELECT * FROM part WHERE p_partkey % 2 = 0) p FULL JOIN (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY l_partkey) r ON k = p_partkey""",
)
def cache_apply(spark, sf_dir):
    cache = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("long").alias("hits"))
    return W.cache_apply(cache, table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key")))


@query(
    "get_or_create",
    """SELECT sha, tenant, coalesce(o.id, n.id) AS id, o.id IS NULL AS created FROM (SELECT sha256(text) AS sha, doc_id % 2 AS tenant, min(doc_id) AS id FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1, 2) n
    LEFT JOIN (SELECT sha256(text) AS sha, doc_id % 2 AS tenant, min(doc_id) AS id FROM documents WHERE doc_id % 3 = 0 GROUP BY 1, 2) o USING (sha, tenant)""",
)
def get_or_create(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha"), (F.col("doc_id") % 2).alias("tenant"), F.col("doc_id").alias("id"))
    return W.get_or_create(rows.where("id % 3 = 0"), rows.where("id % 3 <> 0"), ["sha", "tenant"], "id")


@query(
    "idempotent_submit",
    """WITH q AS (SELECT o_orderkey AS id, o_custkey % 4 AS tenant, o_custkey % 500 AS key, o_orderpriority AS hash FROM orders), e AS (SELECT tenant, key, min(hash) AS known FROM q WHERE id % 50 = 0 GROUP BY tenant, key),
    r AS (SELECT *, first_value(hash) OVER (PARTITION BY tenant, key ORDER BY id) AS f, row_number() OVER (PARTITION BY tenant, key ORDER BY id) AS n FROM q WHERE id % 50 <> 0)
    SELECT id AS request_id, CASE WHEN coalesce(known, CASE WHEN n > 1 THEN f END) IS NULL THEN 'create' WHEN coalesce(known, f) = hash THEN 'replay' ELSE 'conflict' END AS result FROM r LEFT JOIN e USING (tenant, key)""",
)
def idempotent_submit(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), (F.col("o_custkey") % 4).alias("tenant"), (F.col("o_custkey") % 500).alias("key"), F.col("o_orderpriority").alias("hash"))
    return W.idempotent(rows.where("request_id % 50 = 0").groupBy("tenant", "key").agg(F.min("hash").alias("hash")), rows.where("request_id % 50 <> 0"))


DECIDE = "SELECT run_id AS decision_id, run_id + CASE WHEN run_id % 97 = 0 THEN 100000000 ELSE 0 END AS run_id, CASE WHEN run_id % 3 = 0 THEN 'reject' ELSE 'approve' END AS action, CASE WHEN run_id % 7 = 0 THEN 'ok' WHEN run_id % 11 = 0 THEN NULL ELSE 'looks fine' END AS reason FROM {v_runs}"


@query(
    "apply_decisions",
    twin(f"""WITH d AS ({DECIDE.replace("{", "").replace("}", "")}), j AS (SELECT d.*, r.status, CASE WHEN r.run_id % 13 <> 0 THEN r.run_id END AS shown FROM d LEFT JOIN v_runs r ON r.run_id = d.run_id),
    e AS (SELECT *, CASE WHEN status IS NULL THEN 'not_found' WHEN status NOT IN ('held', 'passed') THEN 'not_decidable' WHEN action = 'approve' AND status = 'held' AND length(coalesce(reason, '')) < 3 THEN 'reason_required'
      WHEN action = 'approve' AND status = 'held' AND shown IS NULL THEN 'no_candidate' END AS error,
      (action = 'approve' AND status = 'held') OR (action = 'reject' AND status = 'passed') AS o FROM j)
    SELECT decision_id, error IS NULL AS accepted, error, CASE WHEN error IS NULL THEN CASE action WHEN 'approve' THEN 'approved' ELSE 'rejected' END END AS new_status, error IS NULL AND o AS is_override,
      CASE WHEN error IS NULL AND o THEN CASE action WHEN 'approve' THEN 'all' ELSE 'overall' END END AS labels FROM e"""),
)
def apply_decisions(spark, sf_dir):
    runs = table(spark, sf_dir, "v_runs")
    return W.apply_decisions(runs.select("run_id", "status", F.when(F.col("run_id") % 13 != 0, F.col("run_id")).alias("shown_id")), spark.sql(DECIDE, v_runs=runs))


@query(
    "append_events",
    """SELECT run_id, coalesce(last, 0) + row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS seq, event_id FROM (SELECT user_id AS run_id, event_id FROM events WHERE event_id % 5 = 0) n
    LEFT JOIN (SELECT user_id AS run_id, count(*) AS last FROM events WHERE event_id % 5 <> 0 GROUP BY 1) l USING (run_id)""",
)
def append_events(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "event_id")
    log = ev.where("event_id % 5 <> 0")
    numbered = W.append_events(ev.limit(0).withColumn("seq", F.lit(0)), log)
    return W.append_events(numbered, ev)


@query("snapshot_merge", twin("SELECT coalesce(a.key, b.key) AS key, coalesce(a.output, b.output) AS output FROM (SELECT call_id AS key, kind AS output FROM v_calls) a FULL JOIN (SELECT run_id AS key, status AS output FROM v_runs) b ON a.key = b.key"))
def snapshot_merge(spark, sf_dir):
    old = table(spark, sf_dir, "v_calls").select(F.col("call_id").alias("key"), F.col("kind").alias("output"))
    return W.snapshot_merge(old, table(spark, sf_dir, "v_runs").select(F.col("run_id").alias("key"), F.col("status").alias("output")))


@query("snapshot_replay", twin("SELECT call_id AS key, kind AS output FROM v_calls"))
def snapshot_replay(spark, sf_dir):
    calls = table(spark, sf_dir, "v_calls").select(F.col("call_id").alias("key"), F.col("kind").alias("output"))
    return W.replay(calls.select("key"), calls)


ALIASES = [("nation_1", 1, "AA"), ("Nation 2", 2, "BB"), ("nation 2", 1, "CC"), ("NÄTION-3", 1, "DD"), ("nation 4", 3, "EE"), ("nation 4", 3, "AB")]
PLACE = "SELECT c_custkey AS place_id, replace(n_name, '_', CASE WHEN c_custkey % 2 = 0 THEN '-' ELSE '  ' END) AS place, CASE WHEN c_custkey % 3 = 0 THEN 'CC' END AS given FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey"


@query(
    "resolve_geo",
    f"""WITH a(k, priority, code) AS (VALUES ('nation 1', 1, 'AA'), ('nation 2', 2, 'BB'), ('nation 2', 1, 'CC'), ('nation 3', 1, 'DD'), ('nation 4', 3, 'EE'), ('nation 4', 3, 'AB')), p AS ({plain(PLACE)}),
    b AS (SELECT place_id, given, (SELECT code FROM a WHERE a.k = trim(regexp_replace(lower(place), '[^a-z0-9]+', ' ', 'g')) ORDER BY priority, code LIMIT 1) AS code FROM p)
    SELECT place_id, code, coalesce(given <> code, false) AS mismatch FROM b""",
)
def resolve_geo(spark, sf_dir):
    places = spark.sql(PLACE, customer=table(spark, sf_dir, "customer"), nation=table(spark, sf_dir, "nation"))
    return N.resolve_geo(places, spark.createDataFrame(ALIASES, "key string, priority int, code string"))


CLIMATE = "SELECT n_nationkey AS country, CASE n_nationkey % 4 WHEN 0 THEN 'temperate' WHEN 1 THEN 'tropical' WHEN 2 THEN 'arid' ELSE 'polar' END AS climate, CASE WHEN n_nationkey % 5 = 0 THEN 'S' ELSE 'N' END AS hemisphere FROM {nation}"
BRIEF = "SELECT o_orderkey AS brief_id, c_nationkey AS country, CASE o_orderkey % 5 WHEN 0 THEN 'Early summer' WHEN 1 THEN 'the  holidays' WHEN 2 THEN 'july' WHEN 3 THEN 'mid  winter ' ELSE 'whenever' END AS phrase FROM {orders} JOIN {customer} ON c_custkey = o_custkey"
TERM_ROWS = [("summer", 1, "named_season", [6, 7, 8]), ("winter", 1, "named_season", [12, 1, 2]), ("holidays", 1, "holiday", [12]), ("july", 1, "month", [7]), ("july", 2, "holiday", [7])]


@query(
    "effective_season",
    f"""WITH c AS ({plain(CLIMATE)}), b AS ({plain(BRIEF)}), x AS (SELECT brief_id, climate, hemisphere, CASE brief_id % 5 WHEN 0 THEN 'named_season' WHEN 1 THEN 'holiday' WHEN 2 THEN 'month' WHEN 3 THEN 'named_season' ELSE 'unknown' END AS kind,
      CASE brief_id % 5 WHEN 0 THEN CASE hemisphere WHEN 'S' THEN [12, 1, 2] ELSE [6, 7, 8] END WHEN 1 THEN [12] WHEN 2 THEN [7] WHEN 3 THEN CASE hemisphere WHEN 'S' THEN [6, 7, 8] ELSE [12, 1, 2] END END AS m FROM b JOIN c USING (country))
    SELECT brief_id, kind, array_to_string(m, ',') AS months, CASE WHEN m IS NULL THEN 'unspecified' WHEN climate = 'temperate' THEN CASE WHEN (m[1] = 7 OR m[1] = 6) = (hemisphere = 'N') THEN 'summer' ELSE 'winter' END
      WHEN climate = 'tropical' THEN CASE WHEN m[1] IN (6, 7) THEN 'wet' ELSE 'dry' END WHEN climate = 'arid' THEN CASE WHEN (m[1] IN (6, 7)) = (hemisphere = 'N') THEN 'hot' ELSE 'mild' END ELSE 'unspecified' END AS season FROM x""",
)
def effective_season(spark, sf_dir):
    countries = spark.sql(CLIMATE, nation=table(spark, sf_dir, "nation")).withColumn("wet", F.array(*map(F.lit, (5, 6, 7, 8, 9))))
    briefs = spark.sql(BRIEF, orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"))
    return N.effective_season(briefs, countries, spark.createDataFrame(TERM_ROWS, "key string, priority int, kind string, months array<int>"))


@query(
    "compile_policy",
    """SELECT n_nationkey AS country, 'no violence,' || CASE WHEN n_nationkey % 2 = 0 THEN 'modest,no alcohol' ELSE 'rule ' || n_regionkey END || CASE n_nationkey % 3 WHEN 0 THEN ',no pork' WHEN 1 THEN
      CASE WHEN n_nationkey % 2 = 0 THEN ',lights' ELSE ',no alcohol,lights' END ELSE '' END AS policy FROM nation""",
)
def compile_policy(spark, sf_dir):
    n = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(
        n.alias("country"), F.when(n % 2 == 1, F.array(F.concat(F.lit("rule "), "n_regionkey"))).alias("rules"), F.when(n % 3 == 0, F.array(F.lit("eid"))).when(n % 3 == 1, F.array(F.lit("diwali"), F.lit("other"))).otherwise(F.array().cast("array<string>")).alias("holidays")
    )
    return N.compile_policy(rows, ["no violence", "No Violence "], ["modest", "no alcohol"], {"eid": ["no pork"], "diwali": ["no alcohol", "lights"]})


@query(
    "scale_plan",
    """WITH c AS (SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_size * 3.5::double WHEN p_type LIKE 'ECONOMY%' THEN 6 WHEN p_type LIKE 'SMALL%' THEN 13 WHEN p_type LIKE 'STANDARD%' THEN 30 WHEN p_type LIKE 'LARGE%' THEN 90 END::double AS cm,
      CASE p_partkey % 4 WHEN 0 THEN 'close_up' WHEN 1 THEN 'medium' WHEN 2 THEN 'wide' END AS asked FROM part),
    f AS (SELECT *, CASE WHEN cm / 55 <= 0.6 THEN 'close_up' WHEN cm / 120 <= 0.6 THEN 'medium' ELSE 'wide' END AS tightest FROM c),
    g AS (SELECT *, coalesce(asked = tightest OR (asked = 'close_up' AND cm / 55 <= 0.6 AND cm / 35 >= 0.18) OR (asked = 'medium' AND cm / 120 <= 0.6 AND cm / 80 >= 0.18) OR (asked = 'wide' AND cm / 300 <= 0.6 AND cm / 180 >= 0.18), false) AS taken FROM f),
    h AS (SELECT *, CASE WHEN taken THEN asked ELSE tightest END AS framing FROM g),
    s AS (SELECT *, greatest(0.18::double, least(cm / CASE framing WHEN 'close_up' THEN 55 WHEN 'medium' THEN 120 ELSE 300 END, 0.6::double)) AS l, greatest(0.18::double, least(cm / CASE framing WHEN 'close_up' THEN 35 WHEN 'medium' THEN 80 ELSE 180 END, 0.6::double)) AS u FROM h),
    r AS (SELECT *, round(CASE WHEN u - l < 0.04 AND l > 0.18 THEN u - 0.06 ELSE l END, 3) AS low, round(CASE WHEN u - l < 0.04 AND l <= 0.18 THEN l + 0.06 ELSE u END, 3) AS high FROM s)
    SELECT p_partkey AS part_id, cm, CASE WHEN cm < 8 THEN 'tiny' WHEN cm < 20 THEN 'small' WHEN cm < 45 THEN 'medium' WHEN cm < 120 THEN 'large' WHEN cm >= 120 THEN 'xlarge' END AS band,
      CASE WHEN cm IS NOT NULL THEN framing END AS framing, CASE WHEN cm IS NOT NULL THEN low END AS low, CASE WHEN cm IS NOT NULL THEN high END AS high,
      CASE WHEN cm IS NOT NULL AND asked IS NOT NULL AND NOT taken THEN 'framing ' || asked || ' can''t show a ' || round_even(cm, 0)::bigint || ' cm product as the hero; used ' || tightest END AS note,
      CASE WHEN cm IS NOT NULL THEN round(low * low * 0.5 / 0.8, 6) END AS area_low, CASE WHEN cm IS NOT NULL THEN round(high * high * 0.5 / 0.8, 6) END AS area_high FROM r""",
)
def scale_plan(spark, sf_dir):
    asked = F.when(F.col("p_partkey") % 4 == 0, "close_up").when(F.col("p_partkey") % 4 == 1, "medium").when(F.col("p_partkey") % 4 == 2, "wide")
    words = [("ECONOMY", 6), ("SMALL", 13), ("STANDARD", 30), ("LARGE", 90)]
    plan = N.scale_plan(F.when(F.col("p_size") % 5 != 0, F.col("p_size") * F.lit(3.5)), F.col("p_type"), asked, F.lit(0.5), 0.8, words)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), plan.alias("p")).select("part_id", "p.*")


@query("json_fields", """SELECT event_id, CAST(json_extract(props, '$.k') AS bigint) AS k, CASE WHEN event_id % 3 = 0 THEN event_id || ',2,3,4' END AS box FROM events""")
def json_fields(spark, sf_dir):
    payload = F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(', "box": ['), F.when(F.col("event_id") % 3 == 0, F.concat("event_id", F.lit(",2,3,4"))).otherwise(F.lit("1,2")), F.lit("]}"))
    return table(spark, sf_dir, "events").select("event_id", N.json_fields(payload).alias("f")).select("event_id", "f.k", F.array_join(F.col("f.box").cast("array<string>"), ",").alias("box"))


CENTRES = "SELECT label AS ref_id, list(x ORDER BY pos) AS centre FROM (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) l GROUP BY label, pos) g GROUP BY label"
DISTANCES = f"SELECT vec_id, ref_id, list_sum(list_transform(list_zip(embedding, centre), lambda z: (z[1]::double - z[2]) * (z[1]::double - z[2]))) AS d FROM embeddings CROSS JOIN ({CENTRES}) c"


def _refs(spark, sf_dir):
    return N.centroids(table(spark, sf_dir, "embeddings"), "label").select(F.col("label").alias("ref_id"), "centre")


@query("nearest_ref", f"SELECT vec_id, min_by(ref_id, d) AS ref_id, round(min(d), 4) AS distance FROM ({DISTANCES}) x GROUP BY vec_id")
def nearest_ref(spark, sf_dir):
    return N.nearest(table(spark, sf_dir, "embeddings"), _refs(spark, sf_dir))


@query("farthest_ref", f"SELECT vec_id, max_by(ref_id, d) AS ref_id, round(max(d), 4) AS distance FROM ({DISTANCES}) x GROUP BY vec_id")
def farthest_ref(spark, sf_dir):
    return N.nearest(table(spark, sf_dir, "embeddings"), _refs(spark, sf_dir), farthest=True)


def _half(k: int) -> str:
    return f"SELECT label, max(n) AS n, list(x ORDER BY pos) AS centre FROM (SELECT label, pos, avg(x) AS x, count(*) AS n FROM (SELECT label, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings WHERE vec_id % 2 = {k}) l GROUP BY label, pos) g GROUP BY label"


@query(
    "set_drift",
    f"""WITH a AS ({_half(0)}), b AS ({_half(1)}), d AS (SELECT a.label, max(a.n) AS n, min(sqrt(list_sum(list_transform(list_zip(a.centre, b.centre), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS d FROM a CROSS JOIN b GROUP BY a.label),
    w AS (SELECT d, n / (SELECT sum(n) FROM d) AS w FROM d), s AS (SELECT round(sum(w * d) / sum(w), 4) AS drift, round(max(d) FILTER (w >= 0.1), 4) AS worst FROM w)
    SELECT drift, worst, drift <= 8 AND coalesce(worst, 0) <= 12 AS within FROM s""",
)
def set_drift(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    ref = N.centroids(v.where("vec_id % 2 = 0"), "label")
    total = ref.agg(F.sum("n").alias("t"))
    return N.set_drift(ref.join(F.broadcast(total)).select((F.col("n") / F.col("t")).alias("weight"), "centre"), N.centroids(v.where("vec_id % 2 = 1"), "label"))


BOX = """SELECT run_id AS image_id, candidate_id AS box_id, candidate_no, part_id % 80 / 100.0D AS x0, supplier_id % 80 / 100.0D AS y0, part_id % 80 / 100.0D + 0.05D + candidate_no / 100.0D AS x1, supplier_id % 80 / 100.0D + 0.1D AS y1, flag FROM {v_candidates}"""
DBOX = plain(BOX).replace("0D", "0::double").replace("0.05D", "0.05::double").replace("0.1D", "0.1::double").replace("0.05::double", "0.05::double").replace("0.05D", "0.05")


@query(
    "box_relations",
    twin(f"""WITH x AS ({DBOX.replace("0.05D", "0.05::double").replace("0.1D", "0.1::double")}), p AS (SELECT a.image_id, a.box_id, b.box_id AS zone_id, a.x0, a.y0, a.x1, a.y1, b.x0 AS u0, b.y0 AS v0, b.x1 AS u1, b.y1 AS v1
      FROM x a JOIN x b ON a.image_id = b.image_id AND a.candidate_no % 2 = 0 AND b.candidate_no % 2 = 1),
    m AS (SELECT *, greatest(0.0, least(x1, u1) - greatest(x0, u0)) * greatest(0.0, least(y1, v1) - greatest(y0, v0)) / ((x1 - x0) * (y1 - y0)) AS part FROM p),
    r AS (SELECT image_id, box_id, zone_id, (x0 + x1) / 2 BETWEEN u0 AND u1 AND (y0 + y1) / 2 BETWEEN v0 AND v1 AS centre_in, part >= 0.5 AS half_in,
      greatest(x0, u0) - least(x1, u1) <= 0.02 AND greatest(y0, v0) - least(y1, v1) <= 0.02 AS near, part > 0.05 AS crowding FROM m)
    SELECT * FROM r WHERE near OR half_in OR crowding"""),
)
def box_relations(spark, sf_dir):
    rows = spark.sql(BOX, v_candidates=table(spark, sf_dir, "v_candidates"))
    zones = rows.where("candidate_no % 2 = 1").withColumnRenamed("box_id", "zone_id")
    return N.box_relations(rows.where("candidate_no % 2 = 0"), zones)


@query("primary_box", twin(f"""SELECT image_id, box_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY flag = 'A' DESC, (x1 - x0) * (y1 - y0) DESC, box_id) AS rn FROM ({DBOX.replace("0.05D", "0.05::double").replace("0.1D", "0.1::double")}) x) y WHERE rn = 1"""))
def primary_box(spark, sf_dir):
    return N.primary_box(spark.sql(BOX, v_candidates=table(spark, sf_dir, "v_candidates")).withColumn("matches", F.col("flag") == "A"))


@query(
    "reading_order",
    twin("""WITH w AS (SELECT run_id AS image_id, candidate_id AS word_id, flag || candidate_no AS t, part_id % 50 AS x, supplier_id % 40 AS y, 6 AS h FROM v_candidates),
    n AS (SELECT *, CAST(coalesce(y - lag(y) OVER o > lag(h) OVER o / 2.0, false) AS int) AS new FROM w WINDOW o AS (PARTITION BY image_id ORDER BY y, x, word_id)),
    l AS (SELECT *, sum(new) OVER (PARTITION BY image_id ORDER BY y, x, word_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS line FROM n)
    SELECT image_id, string_agg(t, ' ' ORDER BY line, x, word_id) AS text FROM l GROUP BY image_id"""),
)
def reading_order(spark, sf_dir):
    rows = table(spark, sf_dir, "v_candidates").select(
        F.col("run_id").alias("image_id"), F.col("candidate_id").alias("word_id"), F.concat("flag", "candidate_no").alias("text"), (F.col("part_id") % 50).alias("x"), (F.col("supplier_id") % 40).alias("y"), F.lit(6).alias("h")
    )
    return N.reading_order(rows)


@query("lookup_accuracy", "SELECT count(*) AS cases, count(*) FILTER (c_nationkey % 25 IN (1, 3)) + count(*) FILTER (c_nationkey NOT IN (1, 2, 3, 4)) AS exact FROM customer")
def lookup_accuracy(spark, sf_dir):
    places = spark.sql(PLACE, customer=table(spark, sf_dir, "customer"), nation=table(spark, sf_dir, "nation"))
    found = N.resolve_geo(places, spark.createDataFrame(ALIASES, "key string, priority int, code string")).select("place_id", F.col("code").alias("found"))
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("place_id"), F.expr("CASE c_nationkey WHEN 1 THEN 'AA' WHEN 2 THEN 'BB' WHEN 3 THEN 'DD' WHEN 4 THEN 'EE' END").alias("expected"))
    return N.accuracy(found.join(wanted, "place_id"))
