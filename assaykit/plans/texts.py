"""Queries of the text functions and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaykit.functions import reading, search
from assaykit.functions import text as X
from assaykit.plans.registry import query
from assaykit.sources.bridge import table, twin

NORMAL = r"trim(regexp_replace(regexp_replace(translate(lower({t}), '" + X.DASHES + r"', '------------'), '[^\p{{L}}\p{{N}}\p{{M}}\p{{S}}\p{{Z}}\s%.,:/-]', '', 'g'), '\s+', ' ', 'g'))"


def normal(t: str) -> str:
    return NORMAL.format(t=t)


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("normalise", f"SELECT doc_id, {normal('text')} AS normal, replace({normal('text')}, ' ', '') AS compact FROM documents")
def normalise(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.normalise(F.col("text")).alias("normal"), X.compact(F.col("text")).alias("compact"))


@query("normalise_exact")
def normalise_exact(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.normalise_exact("text").alias("normal"))


def _form(t: str) -> str:
    """A text as it is compared: by character, with the delimiters that the required text lacks."""
    one = f"translate(replace(lower({t}), 'ß', 'ss'), '{X.DASHES}', '{'-' * len(X.DASHES)}')"
    delimiters = X.DELIMITERS.replace("'", "''")
    kept = rf"NOT regexp_matches(c, '\p{{P}}') OR contains('{X.KEPT}', c) OR (contains('{delimiters}', c) AND NOT contains(required, c))"
    return rf"trim(regexp_replace(array_to_string(list_filter(string_split({one}, ''), lambda c: {kept}), ''), '\s+', ' ', 'g'))"


@query("comparable", twin(f"SELECT item_id, reader, {_form('read')} AS read, {_form('required')} AS required FROM (SELECT item_id, reader, required, replace(read, 'e', '(e)') AS read FROM v_reads) r"))
def comparable(spark, sf_dir):
    rows = table(spark, sf_dir, "v_reads").select("item_id", "reader", "required", F.replace("read", F.lit("e"), F.lit("(e)")).alias("read"))
    return X.comparable(rows).select("item_id", "reader", "forms.read", "forms.required")


@query("fold_key", rf"SELECT doc_id, trim(regexp_replace(lower(translate(text, '{X.MARKED}', '{X.PLAIN}')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS folded FROM documents")
def fold_key(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.fold_key(F.col("text")).alias("folded"))


@query("fold_key_exact")
def fold_key_exact(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.fold_key_exact("text").alias("folded"))


TOKENS = r"""list_distinct(list_transform(list_concat(regexp_extract_all({t}, '(?:^|[^\p{{L}}\p{{N}}])([-+]?\p{{Sc}}?\d[\d.,:/]*%?\p{{Sc}}?)', 1),
  list_filter(regexp_extract_all({t}, '[\p{{L}}\p{{N}}]+'), lambda w: regexp_full_match(w, '\p{{Lu}}{{2,4}}'))), lambda w: lower(rtrim(w, '.,:/'))))"""


@query("critical_tokens", f"SELECT doc_id, array_to_string(list_sort({TOKENS.format(t='text')}), ' ') AS tokens FROM documents")
def critical_tokens(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(X.critical_tokens(F.col("text"))), " ").alias("tokens"))


@query(
    "missing_tokens",
    twin(rf"""SELECT item_id, reader, array_to_string(list_sort(list_filter({TOKENS.format(t="translate(required, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')")}, lambda t:
      NOT regexp_matches(lower(read), CASE WHEN regexp_matches(t, '\d') THEN '(^|[^\p{{N}}.,])' || regexp_escape(t) || '($|[^\p{{N}}])' ELSE '(^|[^\p{{L}}\p{{N}}])' || t || '($|[^\p{{L}}\p{{N}}])' END))), ' ') AS missing FROM v_reads"""),
)
def missing_tokens(spark, sf_dir):
    missing = X.missing_tokens(F.lower("read"), X.critical_tokens(F.translate("required", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")))
    return table(spark, sf_dir, "v_reads").select("item_id", "reader", F.array_join(F.array_sort(missing), " ").alias("missing"))


@query(
    "reader_vote",
    twin("""WITH t AS (SELECT DISTINCT item_id, reader, unnest(string_split(read, ' ')) AS token FROM v_reads), r AS (SELECT item_id, count(DISTINCT reader) AS r FROM t GROUP BY item_id)
    SELECT item_id, token, n FROM (SELECT item_id, token, count(*) AS n FROM t GROUP BY item_id, token) x JOIN r USING (item_id) WHERE n >= least(2, r)"""),
)
def reader_vote(spark, sf_dir):
    reads = table(spark, sf_dir, "v_reads").select("item_id", "reader", F.explode(F.split("read", " ")).alias("token"))
    return X.vote(reads)


@query("approx_find")
def approx_find(spark, sf_dir):
    return search.approx_find(docs(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("required")))


#: The reads of v_reads with what was done to each, from which its errors follow without a distance.
FAULTS = "f AS (SELECT *, CASE WHEN reader = 'b' AND item_id % 100 % 2 = 1 THEN 'th' WHEN reader = 'c' AND (item_id // 100) % 3 = 0 THEN 'e' WHEN reader = 'c' AND (item_id // 100) % 3 = 1 THEN 'th' ELSE 'none' END AS fault FROM v_reads)"
LACKING = rf"""list_filter({TOKENS.format(t="required")}, lambda t: NOT regexp_matches(lower(read), CASE WHEN regexp_matches(t, '\d') THEN '(^|[^\p{{N}}.,])' || regexp_escape(t) || '($|[^\p{{N}}])' ELSE '(^|[^\p{{L}}\p{{N}}])' || t || '($|[^\p{{L}}\p{{N}}])' END))"""
CHANGED = "CASE fault WHEN 'th' THEN list_filter(range(1, length(required)), lambda i: substr(required, i, 2) = 'th') WHEN 'e' THEN list_filter(range(0, length(required)), lambda i: substr(required, i + 1, 1) = 'e') ELSE [] END"


def known_keys(source: str, *keep: str) -> str:
    columns = ", ".join(("item_id", "reader", *keep))
    return f"""SELECT {columns}, 'chg' AS kind, CAST(unnest({CHANGED}) AS int) AS pos, CAST(NULL AS varchar) AS glyph FROM {source} WHERE required <> read
    UNION ALL SELECT {columns}, 'missing', -1, unnest({LACKING}) FROM {source} WHERE required <> read"""


@query("error_keys", twin(f"WITH {FAULTS} {known_keys('f')}"))
def error_keys(spark, sf_dir):
    return X.error_keys(table(spark, sf_dir, "v_reads"))


@query(
    "text_decision",
    twin(f"""WITH {FAULTS}, k AS (SELECT DISTINCT * FROM ({known_keys("f")}) q), r AS (SELECT item_id, count(DISTINCT reader) AS readers FROM v_reads GROUP BY item_id),
    a AS (SELECT x.item_id, count(DISTINCT concat_ws(':', x.kind, x.pos, x.glyph)) AS agreed FROM k x JOIN k y ON x.item_id = y.item_id AND x.kind = y.kind AND x.pos = y.pos AND x.glyph IS NOT DISTINCT FROM y.glyph AND x.reader < y.reader GROUP BY x.item_id),
    e AS (SELECT item_id, count(*) AS errors FROM k GROUP BY item_id)
    SELECT r.item_id, readers, coalesce(agreed, 0) AS agreed, CASE WHEN errors IS NULL THEN 'all_exact' WHEN readers = 1 THEN 'single_reader' WHEN agreed > 0 THEN 'failed' ELSE 'reread' END AS decision
    FROM r LEFT JOIN a ON a.item_id = r.item_id LEFT JOIN e ON e.item_id = r.item_id"""),
)
def text_decision(spark, sf_dir):
    reads = table(spark, sf_dir, "v_reads")
    return X.text_decision(reads, X.error_keys(reads))


SAME = "(x.kind = y.kind AND CASE x.kind WHEN 'chg' THEN x.pos = y.pos ELSE x.glyph = y.glyph OR (least(length(x.glyph), length(y.glyph)) >= 3 AND (contains(x.glyph, y.glyph) OR contains(y.glyph, x.glyph))) END)"


@query(
    "read_decisions",
    twin(f"""WITH k AS ({known_keys("v_allreads", "read_no", "again", "fault")}), firsts AS (SELECT * FROM k WHERE NOT again),
    i AS (SELECT r.item_id, r.readers, EXISTS (SELECT 1 FROM firsts x WHERE x.item_id = r.item_id) AS errors, EXISTS (SELECT 1 FROM firsts x JOIN firsts y ON x.item_id = y.item_id AND x.reader < y.reader AND {SAME} WHERE x.item_id = r.item_id) AS agreed
      FROM (SELECT item_id, count(DISTINCT reader) AS readers FROM v_allreads GROUP BY item_id) r),
    every AS (SELECT x.* FROM firsts x WHERE NOT EXISTS (SELECT 1 FROM v_allreads o WHERE o.item_id = x.item_id AND o.reader = x.reader AND o.again AND o.fault <> 'junk'
      AND NOT EXISTS (SELECT 1 FROM k y WHERE y.item_id = o.item_id AND y.reader = o.reader AND y.read_no = o.read_no AND {SAME}))),
    p AS (SELECT item_id, readers, CASE WHEN agreed THEN 'agreed' WHEN NOT errors THEN 'all_exact' WHEN readers < 2 THEN 'single_reader'
      WHEN EXISTS (SELECT 1 FROM every x JOIN every y ON x.item_id = y.item_id AND x.reader < y.reader AND {SAME} WHERE x.item_id = i.item_id) THEN 'reread_agreed'
      WHEN EXISTS (SELECT 1 FROM every x WHERE x.item_id = i.item_id) THEN 'reread_disagrees' ELSE 'reread_resolved' END AS path FROM i)
    SELECT item_id, readers, CASE WHEN path IN ('all_exact', 'reread_resolved') THEN 'pass' WHEN path = 'reread_disagrees' THEN 'unverified' ELSE 'fail' END AS status, path FROM p"""),
)
def read_decisions(spark, sf_dir):
    return reading.read_decisions(table(spark, sf_dir, "v_allreads").drop("fault"))


@query(
    "diff_ops",
    twin(f"""WITH {FAULTS}, s AS (SELECT *, string_split(required, 'th') AS parts FROM f), o AS (SELECT item_id, reader, CASE WHEN required = '' THEN [] WHEN fault = 'th' THEN list_concat(
        flatten(list_transform(parts[1:len(parts) - 1], lambda p: [{{'op': 'equal', 'x': p || 't', 'y': p || 't'}}, {{'op': 'replace', 'x': 'h', 'y': 'b'}}])), CASE WHEN parts[-1] = '' THEN [] ELSE [{{'op': 'equal', 'x': parts[-1], 'y': parts[-1]}}] END)
      WHEN fault = 'e' THEN list_transform(regexp_extract_all(required, 'e+|[^e]+'), lambda p: CASE WHEN starts_with(p, 'e') THEN {{'op': 'delete', 'x': p, 'y': ''}} ELSE {{'op': 'equal', 'x': p, 'y': p}} END)
      ELSE [{{'op': 'equal', 'x': required, 'y': required}}] END AS ops FROM s)
    SELECT item_id, reader, CAST(i AS int) AS place, op.op AS op, op.x AS expected, op.y AS got FROM (SELECT item_id, reader, unnest(ops) AS op, unnest(range(len(ops))) AS i FROM o) q"""),
)
def diff_ops(spark, sf_dir):
    rows = table(spark, sf_dir, "v_reads").select("item_id", "reader", "required", "read")
    return reading.with_diff(rows, "required", "read").select("item_id", "reader", "place", "op", "expected", "got")


C1, C2 = (f"replace({normal(x)}, ' ', '')" for x in ("a.read", "b.read"))


@query(
    "stray_agreement",
    twin(f"""SELECT item_id, read_no, other_no FROM (SELECT a.item_id, a.read_no, b.read_no AS other_no, {C1} AS c, {C2} AS d FROM v_reads a JOIN v_reads b ON a.item_id = b.item_id AND a.reader < b.reader
      AND abs(a.x - b.x) <= 0.02 AND abs(a.y - b.y) <= 0.02) p
    WHERE c = d OR (least(length(c), length(d)) >= 4 AND (contains(c, d) OR contains(d, c))) OR 1 - levenshtein(c, d) / greatest(length(c), length(d)) >= 0.8"""),
)
def stray_agreement(spark, sf_dir):
    return X.stray_agreement(table(spark, sf_dir, "v_reads").select("item_id", "reader", "read_no", F.col("read").alias("text"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))


@query(
    "composed_lengths",
    r"""SELECT n, count(*) AS lines FROM (SELECT length(nfc_normalize(replace(replace(unnest(string_split(text, chr(10))), 'é', 'e' || chr(769)), 'ü', 'u' || chr(776)))) AS n FROM documents) l GROUP BY n""",
)
def composed_lengths(spark, sf_dir):
    """Lengths of lines whose marks were taken apart and are composed again."""
    apart = F.replace(F.replace("text", F.lit("é"), F.lit("e\u0301")), F.lit("ü"), F.lit("u\u0308"))
    return docs(spark, sf_dir).select(F.explode(F.split(apart, "\n")).alias("line")).groupBy(F.length(X.composed("line")).cast("long").alias("n")).agg(F.count("*").alias("lines"))


@query(
    "validate_text",
    r"""SELECT problem, count(*) AS n FROM (SELECT CASE WHEN length(t) = 0 THEN 'empty' WHEN length(t) > 80 THEN 'too_long' WHEN regexp_matches(t, '\p{Cc}') THEN 'control'
      WHEN regexp_matches(replace(replace(t, chr(8204), ''), chr(8205), ''), '[\p{Cf}\x{180E}\x{E0000}-\x{E007F}]') THEN 'hidden' WHEN regexp_matches(t, '[\x{2028}\x{2029}]') THEN 'hidden_break'
      WHEN contains(lower(t), 'spam') THEN 'policy' END AS problem
    FROM (SELECT regexp_replace(unnest(string_split(text, chr(10))), '^[\s\p{Z}\x1C-\x1F\x{85}]+|[\s\p{Z}\x1C-\x1F\x{85}]+$', '', 'g') AS t FROM documents) l) p GROUP BY problem""",
)
def validate_text(spark, sf_dir):
    lines = docs(spark, sf_dir).select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(X.validate_text(F.col("line"), blocked=F.contains(F.lower("line"), F.lit("spam"))).alias("problem")).agg(F.count("*").alias("n"))


TERMS = ["the", "pour", "schung", "asco", "hatred"]


@query(
    "blocklist",
    rf"""SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(string_split(regexp_replace(translate(lower(text), '013457@$', 'oieastas'), '[^\p{{L}}\p{{M}}]+', ' ', 'g'), ' ')) AS term FROM documents) x
    WHERE term IN ({", ".join(f"'{t}'" for t in TERMS)})""",
)
def blocklist(spark, sf_dir):
    return X.blocklist(docs(spark, sf_dir), "doc_id", "text", TERMS)


@query(
    "injection_signals",
    r"""SELECT conv_id, turn, concat_ws(',',
      CASE WHEN regexp_matches(lower(text), '(ignore|disregard|forget)\s+((all|any)\s+)?(the\s+)?(previous|prior|above|earlier)\s+(instructions|prompt|rules|messages)')
        OR regexp_matches(lower(text), '(ignore|disregard|forget)\s+(all|any|every)\s+((the|your)\s+)?(rules|instructions|guidelines|checks)')
        OR regexp_matches(lower(text), '\b(approve|pass)\s+(this|the)\s+(ad|image)\b') OR regexp_matches(lower(text), 'mark\s+(all|every)\s+(the\s+)?checks?\s+(as\s+)?pass')
        OR regexp_matches(lower(text), 'you\s+are\s+now\s') OR regexp_matches(lower(text), 'new\s+instructions\s*:')
        OR regexp_matches(lower(text), 'reveal\s+(your|the)\s+(system\s+)?prompt') OR regexp_matches(lower(text), 'act\s+as\s+(an?\s+)?(unrestricted|jailbroken|dan)\b') THEN 'role_override' END,
      CASE WHEN regexp_matches(lower(text), '<\s*/?\s*(system|assistant|tool|untrusted[^>]*)\s*>') OR regexp_matches(lower(text), '\[/?(system|inst)\]')
        OR regexp_matches(lower(text), '<\|(im_start|im_end|system|endoftext)\|>') OR regexp_matches(lower(text), '(^|\n)\s*(system|assistant)\s*:') THEN 'fake_marker' END,
      CASE WHEN regexp_matches(text, '[\x{E0000}-\x{E007F}]') THEN 'unicode_tags' END) AS signals FROM conversations""",
)
def injection_signals(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(X.injection_signals(F.col("text")), ",").alias("signals"))


# RE2 has no lookbehind: the character before a phone number is taken along and put back. Its words are of ASCII letters:
# other letters beside a digit get a sign for the while that is one
OTHER = "À-ÖØ-öø-ɏ"
PERSONAL_SQL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[REDACTED:email]"),
    ("card", r"\b(?:[0-9][ -]?){13,19}\b", "[REDACTED:card]"),
    ("aadhaar", r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b", "[REDACTED:aadhaar]"),
    ("pan", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", "[REDACTED:pan]"),
    ("phone", r"(^|[^\w-])\+?[0-9][0-9\s().-]{8,}[0-9]\b", r"\1[REDACTED:phone]"),
]


def _redacted() -> str:
    sql, kinds = "SELECT doc_id, text AS t0 FROM documents", []
    for i, (kind, pattern, mark) in enumerate(PERSONAL_SQL):
        signed = rf"regexp_replace(regexp_replace(t{i}, '([0-9][ -]?)([{OTHER}])', '\1_QQ_\2', 'g'), '([{OTHER}])([0-9])', '\1_QQ_\2', 'g')"
        sql = f"SELECT *, replace(regexp_replace({signed if kind == 'card' else f't{i}'}, '{pattern}', '{mark}', 'g'), '_QQ_', '') AS t{i + 1} FROM ({sql}) s{i}"
        kinds.append(f"CASE WHEN regexp_matches(t{i}, '{pattern}') THEN '{kind}' END")
    return f"SELECT doc_id, t{len(kinds)} AS redacted, concat_ws(',', {', '.join(kinds)}) AS kinds FROM ({sql}) s"


@query("pii_redact", _redacted())
def pii_redact(spark, sf_dir):
    return X.redact(docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", "redacted", F.array_join("kinds", ",").alias("kinds"))


@query(
    "parse_reasons",
    """SELECT doc_id, concat_ws(',', CASE doc_id % 3 WHEN 0 THEN 'context=season' WHEN 1 THEN 'context=label_text' END, 'product=' || CASE doc_id % 2 WHEN 0 THEN 'pasted' ELSE 'scale' END) AS reasons FROM documents""",
)
def parse_reasons(spark, sf_dir):
    note = F.concat(
        F.lit("see reason:product=scale, reason:context="), F.expr("CASE doc_id % 3 WHEN 0 THEN 'season' WHEN 1 THEN 'label_text' ELSE 'bogus' END"), F.lit(" reason:product="), F.expr("CASE doc_id % 2 WHEN 0 THEN 'pasted' ELSE 'nothing' END")
    )
    entries = F.array_sort(F.transform(F.map_entries(X.parse_reasons(note)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return docs(spark, sf_dir).select("doc_id", F.array_join(entries, ",").alias("reasons"))


@query("canonical_hash", """SELECT o_orderkey AS id, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS hash FROM orders""")
def canonical_hash(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), X.canonical_hash("o_orderstatus", "o_orderkey", "o_custkey").alias("hash"))


@query(
    "dedup_ordered",
    """SELECT conv_id, turn, string_agg(w, ' ' ORDER BY p) AS words FROM (SELECT conv_id, turn, min(p) AS p, arg_min(w, p) AS w FROM (
      SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS p FROM conversations) x WHERE length(trim(w)) > 0 GROUP BY conv_id, turn, lower(w)) y GROUP BY conv_id, turn""",
)
def dedup_ordered(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(X.dedup_ordered(F.split("text", " ")), " ").alias("words"))


def _count(name: str) -> str:
    return rf"length(regexp_replace(text, '[^\p{{{name}}}]', '', 'g'))"


@query(
    "detect_script",
    rf"""SELECT doc_id, CASE WHEN regexp_matches(text, '[\p{{Hiragana}}\p{{Katakana}}]') THEN 'Jpan' WHEN regexp_matches(text, '\p{{Hangul}}') THEN 'Kore'
      WHEN {_count("Latin")} > 0 AND {_count("Latin")} >= greatest({", ".join(map(_count, ["Cyrillic", "Arabic", "Devanagari", "Han"]))}) THEN 'Latn' WHEN {_count("Cyrillic")} > 0 THEN 'Cyrl' ELSE 'Zyyy' END AS script FROM documents""",
)
def detect_script(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.detect_script(F.col("text")).alias("script"))


def _typos(tries: int = 4) -> str:
    number = lambda n, part: f"CAST('0x' || substr(md5('7-' || doc_id || '-{n}'), {part}, 7) AS bigint)"
    parts = []
    for n in range(tries):
        at = f"({number(n, 9)} % greatest(length(text) - 1, 1) + 1)"
        head, a, b, rest = f"substr(text, 1, {at} - 1)", f"substr(text, {at}, 1)", f"substr(text, {at} + 1, 1)", f"substr(text, {at} + 2)"
        planted = f"CASE {number(n, 1)} % 3 WHEN 0 THEN {head} || chr(CAST(97 + {number(n, 17)} % 26 AS int)) || {b} || {rest} WHEN 1 THEN {head} || {b} || {rest} ELSE {head} || {b} || {a} || {rest} END"
        parts.append(f"SELECT doc_id, text, {n} AS n, CASE {number(n, 1)} % 3 WHEN 0 THEN 'substitute' WHEN 1 THEN 'delete' ELSE 'transpose' END AS kind, {at} AS place, {planted} AS planted FROM documents")
    changed = f"replace({normal('planted')}, ' ', '') <> replace({normal('text')}, ' ', '')"
    return f"""SELECT d.doc_id, kind, place, planted FROM documents d LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS rn FROM ({" UNION ALL ".join(parts)}) o WHERE {changed}) p WHERE rn = 1) q ON q.doc_id = d.doc_id"""


@query("plant_typos", _typos())
def plant_typos(spark, sf_dir):
    return X.plant_typos(docs(spark, sf_dir).select("doc_id", "text"), "doc_id", "text").select("doc_id", "kind", "place", "planted")
