"""The engine's tables derived from the star schema and text tables, from one SQL text for Spark and for the oracle.

A view's text names tables and other views in braces; Spark binds them to DataFrames, the oracle gets a WITH clause.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DIMENSIONS = ("technical", "text", "product", "context", "composition")

_EVENT = {
    "status": "string", "spec_summary": "string", "candidate_id": "bigint", "parent_candidate_id": "bigint", "from_candidate_id": "bigint", "kind": "string", "slot": "int", "attempt": "int", "model": "string",
    "verdict": "string", "target_dimension": "string", "action": "string", "reason": "string", "outcome": "string", "best_candidate_id": "bigint", "problem": "string",
}


def _events(source: str, *kinds: tuple[str, str, str, dict[str, str]]) -> str:
    """A SELECT of the events (place in the run, type, condition, fields) that each row of source gives, in one pass over it."""

    def case(values: list[str | None]) -> str:
        some = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values) if v is not None)
        return f"CASE n {some} END" if some else "NULL"

    places, types, when = (case(list(x)) for x in ([k[0] for k in kinds], [f"'{k[1]}'" for k in kinds], [k[2] for k in kinds]))
    fields = ", ".join(f"CAST({case([k[3].get(f) for k in kinds])} AS {t}) AS {f}" for f, t in _EVENT.items())
    numbers = ", ".join(f"({i})" for i in range(len(kinds)))
    return f"SELECT run_id, {places} AS place, {types} AS type, {fields} FROM {source} r CROSS JOIN (VALUES {numbers}) k(n) WHERE {when}"


def _numbered(events: str) -> str:
    return f"SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY place) AS seq, type, 1700000000000000 + run_id * 60000000 + place * 1500000 AS at_us, {', '.join(_EVENT)} FROM (\n{events}) l"


def _events_at_once(first: tuple[str, str, list], second: tuple[str, str, list]) -> str:
    """The events of two sources, each with its columns, dealt out by run as the rows that they are, so that the many events aren't."""
    (a, mine, kinds), (b, other, more) = first, second
    none = lambda columns: ", ".join(f"NULL AS {c}" for c in columns.split(", "))
    rows = f"SELECT /*+ REPARTITION(run_id) */ * FROM (SELECT run_id, true AS is_first, {mine}, {none(other)} FROM {a} UNION ALL SELECT run_id, false, {none(mine)}, {other} FROM {b}) b"
    numbers = ", ".join(f"({i})" for i in range(len(kinds) + len(more)))
    each = f"LATERAL VIEW explode(CASE WHEN is_first THEN sequence(0, {len(kinds) - 1}) ELSE sequence({len(kinds)}, {len(kinds) + len(more) - 1}) END) k AS n"
    return _events(f"({rows})", *kinds, *more).replace(f"CROSS JOIN (VALUES {numbers}) k(n)", each)


_PLANNED = "CASE WHEN part_id % 6 = 0 THEN 'clean_plate' ELSE 'repair' END"
_OF_RUNS = [
    ("1", "run.status", "true", dict(status="'planning'")),
    ("2", "plan.done", "run_id % 13 <> 0", dict(spec_summary="batch_label")),
    ("3", "run.status", "true", dict(status="'generating'")),
    ("25", "run.status", "run_id % 3 = 0", dict(status="'evaluating'")),
    ("85", "budget.warning", "run_id % 11 = 0", dict(reason="CASE WHEN run_id % 2 = 0 THEN 'deadline' END")),
    ("90", "run.error", "status = 'failed'", dict(problem="'internal-error'")),
    ("95", "run.finished", "status <> 'generating'", dict(status="CASE WHEN status IN ('failed', 'interrupted') THEN status WHEN status IN ('held', 'rejected') THEN 'needs_review' ELSE 'passed' END", outcome="outcome", best_candidate_id="CASE WHEN run_id % 10 > 2 THEN run_id * 10 + 1 END")),
    ("97", "run.status", "status IN ('approved', 'rejected')", dict(status="status")),
]
_OF_CANDIDATES = [
    ("CASE WHEN candidate_no = 4 THEN 32 ELSE candidate_no * 10 + 1 END", "repair.started", "candidate_no BETWEEN 3 AND 6", dict(from_candidate_id="parent_id", target_dimension="CASE WHEN part_id % 2 = 0 THEN 'text' ELSE 'product' END", action=_PLANNED)),
    ("CASE WHEN run_id % 4 = 0 THEN 75 ELSE 72 END", "fallback.applied", "candidate_no = 7", dict(candidate_id="CASE WHEN run_id % 4 = 0 THEN candidate_id ELSE parent_id END", reason="'text'")),
    ("candidate_no * 10 + 3", "candidate.created", "true", dict(status="CASE WHEN part_id % 31 = 0 THEN 'blocked' ELSE 'pending' END", candidate_id="candidate_id", parent_candidate_id="CASE WHEN supplier_id % 5 = 0 THEN NULL ELSE parent_id END", kind=f"CASE WHEN candidate_no < 3 THEN 'initial' WHEN candidate_no = 7 THEN 'overlay' ELSE {_PLANNED} END", slot="slot", attempt="attempt", model="served_model")),
    ("candidate_no * 10 + 4", "evaluation.done", "part_id % 23 <> 0", dict(candidate_id="candidate_id", verdict="CASE WHEN supplier_id % 17 = 0 THEN 'unverified' WHEN part_id % 5 = 0 THEN 'fail' ELSE 'pass' END")),
]
_LOG = "\nUNION ALL ".join([_events("{v_runs}", *_OF_RUNS), _events("{v_candidates}", *_OF_CANDIDATES)])

VIEWS = {
    "v_runs": """
SELECT o_orderkey AS run_id, o_custkey % 4 AS tenant, o_custkey AS brief_id, CAST(o_orderdate AS timestamp) AS created_at,
  CAST(CAST(o_orderdate AS date) AS string) AS created_day,
  CASE WHEN o_orderkey % 9 = 0 THEN 'golden' ELSE 'user' END AS origin,
  CASE o_orderkey % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'interrupted' WHEN 2 THEN 'generating' WHEN 3 THEN 'held'
    WHEN 4 THEN 'rejected' WHEN 5 THEN 'passed' ELSE 'approved' END AS status,
  CASE WHEN o_orderkey % 10 < 3 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'overlay' ELSE 'native' END AS outcome,
  CASE WHEN o_orderkey % 10 < 3 THEN NULL ELSE o_orderkey % 3 <> 0 END AS first_attempt_pass,
  o_orderkey % 4 AS repair_count, CAST(o_totalprice / 1000000 AS decimal(12,6)) AS cost_usd,
  CASE WHEN o_orderkey % 10 < 3 THEN NULL ELSE 20000 + (o_orderkey * 7919) % 60000 END AS latency_ms,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 120 END AS heartbeat_age,
  'batch' || CAST(o_custkey % 5 AS string) AS batch_label
FROM {orders}""",
    "v_candidates": """
SELECT run_id, l_linenumber AS candidate_no, run_id * 10 + l_linenumber AS candidate_id,
  CAST(floor((l_linenumber - 1) / 2) AS int) AS attempt, (l_linenumber - 1) % 2 AS slot,
  CASE WHEN l_linenumber > 2 THEN run_id * 10 + l_linenumber - 2 END AS parent_id,
  CASE WHEN l_linenumber = 7 THEN 'overlay' ELSE 'native' END AS kind,
  round(1 - l_discount, 2) AS composite, part_id, supplier_id, quantity, price, flag, line_status,
  'model' || CAST(supplier_id % 3 AS string) AS requested_model,
  CASE WHEN supplier_id % 11 = 0 THEN 'model9' ELSE 'model' || CAST(supplier_id % 3 AS string) END AS served_model
FROM (
  SELECT l_orderkey AS run_id, l_linenumber, l_discount, l_partkey AS part_id, l_suppkey AS supplier_id, l_quantity AS quantity,
    l_extendedprice AS price, l_returnflag AS flag, l_linestatus AS line_status,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_returnflag, l_linestatus) AS rn
  FROM {lineitem}
) x WHERE rn = 1""",
    "v_evaluations": """
SELECT candidate_id * 10 + 1 AS evaluation_id, candidate_id, run_id, candidate_no, attempt, slot, composite,
  CASE flag WHEN 'A' THEN 'ev-1' WHEN 'N' THEN 'ev-2' ELSE 'ev-3' END AS version,
  part_id % 23 <> 0 AS technical_pass,
  CASE WHEN part_id % 23 = 0 THEN NULL WHEN supplier_id % 17 = 0 THEN NULL ELSE part_id % 5 <> 0 END AS text_pass,
  CASE WHEN part_id % 23 = 0 THEN NULL ELSE supplier_id % 7 <> 0 END AS product_pass,
  CASE WHEN part_id % 23 = 0 THEN NULL ELSE part_id % 11 <> 0 END AS context_pass,
  CASE WHEN part_id % 23 = 0 OR candidate_no % 2 = 0 THEN NULL ELSE part_id % 3 <> 0 END AS composition_pass
FROM {v_candidates}""",
    "v_checks": """
SELECT candidate_id AS item_id, 'technical' AS dimension, 'blank' AS check_name, 'deterministic' AS method, part_id % 29 <> 0 AS passed FROM {v_candidates}
UNION ALL SELECT candidate_id, 'text', 'ocr', 'deterministic', CASE WHEN part_id % 13 = 0 THEN NULL ELSE part_id % 5 <> 0 END FROM {v_candidates}
UNION ALL SELECT candidate_id, 'text', 'judge', 'vlm', CASE WHEN supplier_id % 19 = 0 THEN NULL ELSE supplier_id % 6 <> 0 END FROM {v_candidates} WHERE candidate_no % 3 <> 0
UNION ALL SELECT candidate_id, 'product', 'shape', 'vlm', supplier_id % 7 <> 0 FROM {v_candidates}
UNION ALL SELECT candidate_id, 'product', 'colour', 'deterministic', part_id % 17 <> 0 FROM {v_candidates} WHERE candidate_no % 2 = 1""",
    "v_items": """
SELECT d.doc_id AS item_id, CASE d.doc_id % 3 WHEN 0 THEN 'v1' WHEN 1 THEN 'v2' ELSE 'v3' END AS version,
  CASE d.doc_id % 5 WHEN 2 THEN 'final' WHEN 3 THEN 'plant' ELSE 'nat' END AS item_set,
  CASE WHEN d.doc_id % 7 < 4 THEN 'calibration' ELSE 'heldout' END AS split,
  d.doc_id % 40 AS brief_id, d.source AS product_id, d.text AS body, d.n_chars AS n_chars,
  CASE WHEN d.doc_id % 5 = 3 THEN d.doc_id - 3 END AS source_id,
  CASE WHEN d.doc_id % 5 = 3 THEN CASE CAST(floor(d.doc_id / 5) AS bigint) % 4 WHEN 0 THEN 'typo' WHEN 1 THEN 'swap' WHEN 2 THEN 'blank' ELSE 'none' END END AS mutation,
  CASE WHEN l.doc_id IS NULL THEN 'none' WHEN d.doc_id % 5 = 3 THEN 'planted' WHEN d.doc_id % 11 = 0 THEN 'assumed' ELSE 'human' END AS label_source,
  l.quality = 1 AS label_technical, l.toxic = 0 AS label_text,
  CASE WHEN l.doc_id IS NULL OR d.doc_id % 13 = 0 THEN NULL ELSE l.quality = 1 OR l.toxic = 1 END AS label_product,
  CASE WHEN l.doc_id IS NULL THEN NULL ELSE d.doc_id % 9 <> 0 END AS label_context,
  CASE WHEN l.doc_id IS NULL OR d.doc_id % 2 = 0 THEN NULL ELSE d.doc_id % 17 <> 0 END AS label_composition,
  true AS assessed_technical, d.n_chars >= 400 AS pred_technical,
  d.n_chars >= 400 AS assessed_text, CASE WHEN d.doc_id % 19 = 0 THEN NULL ELSE d.text NOT LIKE '%!!%' END AS pred_text,
  d.n_chars >= 400 AS assessed_product, d.n_chars % 7 <> 0 AS pred_product,
  d.n_chars >= 400 AS assessed_context, CASE WHEN d.doc_id % 23 = 0 THEN NULL ELSE d.n_chars % 5 <> 0 END AS pred_context,
  d.n_chars >= 400 AND d.doc_id % 3 <> 0 AS assessed_composition, d.n_chars % 3 <> 0 AS pred_composition
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "v_dims": "\nUNION ALL ".join(
        f"SELECT item_id, version, item_set, split, source_id, mutation, label_source, '{d}' AS dimension, label_{d} AS label, assessed_{d} AS assessed, pred_{d} AS predicted FROM {{v_items}}" for d in DIMENSIONS
    ),
    "v_calls": """
SELECT event_id AS call_id, user_id AS run_id, event_type AS kind, CAST(ts AS timestamp) AS created_at, CAST(CAST(ts AS date) AS string) AS created_day,
  k, k % 4 = 0 AS cached, k % 9 = 0 AS fallback_used, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
  k * 37 + event_id % 101 AS latency_ms, value / 1000 AS est_cost_usd, 'model' || CAST(user_id % 4 AS string) AS model
FROM (SELECT *, CAST(replace(replace(props, '{{"k": ', ''), '}}', '') AS bigint) AS k FROM {events}) e""",
    "v_events": """
SELECT conv_id AS run_id, turn + 1 AS seq, CASE WHEN turn = 0 THEN 'run.created' WHEN turn = last THEN 'run.finished' WHEN role = 'assistant' THEN 'candidate.created'
  WHEN turn % 3 = 0 THEN 'repair.planned' ELSE 'candidate.evaluated' END AS type, role, text AS payload, length(text) AS size
FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM {conversations}) c""",
    "v_reads": """
SELECT conv_id * 100 + turn AS item_id, 'a' AS reader, 1 AS read_no, text AS required, text AS read, conv_id % 10 / 10.0 AS x, turn / 10.0 AS y FROM {conversations}
UNION ALL SELECT conv_id * 100 + turn, 'b', 2, text, CASE WHEN turn % 2 = 0 THEN text ELSE replace(text, 'th', 'tb') END, conv_id % 10 / 10.0 + 0.01, turn / 10.0 FROM {conversations}
UNION ALL SELECT conv_id * 100 + turn, 'c', 3, text, CASE WHEN conv_id % 3 = 0 THEN replace(text, 'e', '') WHEN conv_id % 3 = 1 THEN replace(text, 'th', 'tb') ELSE text END,
  conv_id % 10 / 10.0, turn / 10.0 + CASE WHEN turn % 5 = 0 THEN 0.05 ELSE 0.015 END FROM {conversations}""",
    "v_allreads": """
SELECT item_id, reader, read_no, again, required, fault, CASE fault WHEN 'th' THEN replace(required, 'th', 'tb') WHEN 'e' THEN replace(required, 'e', '') WHEN 'junk' THEN '#' ELSE required END AS read
FROM (SELECT conv_id * 100 + turn AS item_id, reader, read_no, again, text AS required, CASE read_no
    WHEN 1 THEN 'none'
    WHEN 2 THEN CASE WHEN turn % 2 = 0 THEN 'none' ELSE 'th' END
    WHEN 3 THEN CASE conv_id % 3 WHEN 0 THEN 'e' WHEN 1 THEN 'th' ELSE 'none' END
    WHEN 4 THEN 'none'
    WHEN 5 THEN CASE WHEN conv_id % 2 = 0 OR turn % 2 = 0 THEN 'none' ELSE 'th' END
    WHEN 6 THEN CASE conv_id % 5 WHEN 0 THEN 'junk' WHEN 1 THEN 'none' WHEN 2 THEN 'th' ELSE 'e' END
    ELSE CASE WHEN conv_id % 7 = 0 THEN 'th' ELSE 'e' END END AS fault
  FROM {conversations} CROSS JOIN (VALUES ('a', 1, false), ('b', 2, false), ('c', 3, false), ('a', 4, true), ('b', 5, true), ('c', 6, true), ('c', 7, true)) k(reader, read_no, again)
  WHERE conv_id % 11 <> 0 OR read_no = 3) r""",
    "v_log": _numbered(_LOG),
    "v_outputs": """
SELECT run_id AS item_id, CASE WHEN run_id % 5 = 4 THEN 'nat' ELSE 'final' END AS item_set, 'product' || CAST(tenant AS string) AS group_id, status, outcome, first_attempt_pass, repair_count, cost_usd, latency_ms,
  CASE run_id % 4 WHEN 1 THEN 'construction' WHEN 2 THEN 'ocr' END AS text_verification, run_id % 8 = 6 AS exclude_native,
  CASE WHEN run_id % 17 = 0 THEN NULL ELSE 512 + run_id % 3 * 256 END AS width, CASE WHEN run_id % 23 = 0 THEN NULL ELSE 768 + run_id % 7 * 64 END AS height, run_id % 19 <> 0 AS evaluated
FROM {v_runs}""",
    "v_outputchecks": """
SELECT run_id AS item_id, CASE candidate_no WHEN 1 THEN 'ocr_cer' WHEN 2 THEN 'hue_drift' WHEN 3 THEN 'vlm_label_subtext_preserved' ELSE 'blank' END AS name,
  CASE WHEN part_id % 13 = 0 THEN NULL ELSE part_id % 5 <> 0 END AS passed, CASE WHEN part_id % 7 = 0 THEN NULL WHEN quantity > 25 THEN 0.0 ELSE CAST(quantity AS double) / 100 END AS value,
  CASE WHEN part_id % 11 = 0 THEN NULL ELSE supplier_id % 6 = 0 END AS note
FROM {v_candidates}""",
    "v_vectors": "SELECT vec_id, label, embedding FROM {embeddings}",
}

#: The rows of a view in one pass over the view below it; as Spark works out each branch of a UNION by itself, with filters moved below the shuffle.
_ONE_PASS = {
    "v_log": _numbered(_events_at_once(("{v_runs}", "status, outcome, batch_label", _OF_RUNS), ("{v_candidates}", "candidate_no, candidate_id, attempt, slot, parent_id, part_id, supplier_id, served_model", _OF_CANDIDATES))),
    "v_checks": """
SELECT item_id, dimension, check_name, method, passed FROM (
  SELECT candidate_id AS item_id, inline(filter(array(
    named_struct('dimension', 'technical', 'check_name', 'blank', 'method', 'deterministic', 'passed', part_id % 29 <> 0, 'there', true),
    named_struct('dimension', 'text', 'check_name', 'ocr', 'method', 'deterministic', 'passed', CASE WHEN part_id % 13 = 0 THEN NULL ELSE part_id % 5 <> 0 END, 'there', true),
    named_struct('dimension', 'text', 'check_name', 'judge', 'method', 'vlm', 'passed', CASE WHEN supplier_id % 19 = 0 THEN NULL ELSE supplier_id % 6 <> 0 END, 'there', candidate_no % 3 <> 0),
    named_struct('dimension', 'product', 'check_name', 'shape', 'method', 'vlm', 'passed', supplier_id % 7 <> 0, 'there', true),
    named_struct('dimension', 'product', 'check_name', 'colour', 'method', 'deterministic', 'passed', part_id % 17 <> 0, 'there', candidate_no % 2 = 1)
  ), c -> c.there)) FROM {v_candidates}
) x""",
}
#: The same with neighbouring runs together, in their order.
_ONE_PASS["v_log_ranged"] = _ONE_PASS["v_log"].replace("REPARTITION(run_id)", "REPARTITION_BY_RANGE(run_id)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver, or a view over them."""
    if name not in VIEWS and name not in _ONE_PASS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = _ONE_PASS.get(name) or VIEWS[name]
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in _names(text)})


def _names(text: str) -> list[str]:
    return sorted(set(re.findall(r"(?<!\{)\{(\w+)\}", text)))


def twin(sql: str) -> str:
    """SQL for the oracle: sql after a WITH clause of the views that it names."""
    order: list[str] = []

    def need(text: str, names: list[str]) -> None:
        for n in names:
            if n in VIEWS and n not in order:
                need(VIEWS[n], _names(VIEWS[n]))
                order.append(n)

    need(sql, [n for n in VIEWS if re.search(rf"\b{n}\b", sql)])
    plain = lambda text: re.sub(r"(?<!\{)\{(\w+)\}", r"\1", text).replace("{{", "{").replace("}}", "}")
    body = sql.strip()
    views = ",\n".join(f"{n} AS ({plain(VIEWS[n]).strip()})" for n in order)
    if not views:
        return body
    return f"WITH {views}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {views}\n{body}"
