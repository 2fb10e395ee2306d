"""Text functions as column expressions; the exact Unicode forms and edit scripts are Arrow functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that are written alike.
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe58\ufe63\uff0d\u2e3a\u2e3b"
QUOTES = "\u2018\u2019\u201a\u201b\u2032\u00b4`"
DOUBLE = "\u201c\u201d\u201e\u201f\u2033\u00ab\u00bb\u2039\u203a"
KEPT = "%.,:/+-"
#: Quotes and brackets that can be extra in a read, and scripts whose words have no spaces between them.
DELIMITERS = "'\"()[]{}<>「」『』【】〔〕"
UNSPACED = ("Jpan", "Hans", "Hant", "Hani", "Thai", "Khmr", "Laoo", "Mymr")
#: Latin letters with marks and what they fold to.
MARKED = "àáâãäåèéêëìíîïòóôõöùúûüýÿçñÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÝÇÑ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuyycnAAAAAAEEEEIIIIOOOOOUUUUYCN"
#: What digits and signs stand for in disguised words.
SWAPS = ("013457@$", "oieastas")


#: Texts that Python holds as strings at a time.
SLICE = 64

#: Full-width forms of the printable ASCII characters and of the space, which compatibility folding makes plain.
WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + "\u3000"
NARROW = "".join(chr(0x21 + i) for i in range(94)) + " "


def narrow(col: Column) -> Column:
    """The text with full-width letters, digits and signs made plain."""
    return F.when(F.regexp_like(col, F.lit(r"[\x{3000}\x{FF01}-\x{FF5E}]")), F.translate(col, WIDE, NARROW)).otherwise(col)


def normalise(col: Column) -> Column:
    """Lower case, one kind of dash, no punctuation but KEPT, single spaces. Latin text; normalise_exact for any."""
    one = F.translate(F.lower(col), DASHES, "-" * len(DASHES))
    return F.trim(F.regexp_replace(F.regexp_replace(one, r"[^\p{L}\p{N}\p{M}\p{S}\p{Z}\s%.,:/-]", ""), r"\s+", " "))


def compact(col: Column) -> Column:
    """normalise() without spaces."""
    return F.regexp_replace(normalise(col), " ", "")


def normalise_text(text: str) -> str:
    folded = unicodedata.normalize("NFKC", text).casefold().translate({ord(c): "-" for c in DASHES})
    kept = "".join(c for c in folded if c in KEPT or not unicodedata.category(c).startswith("P"))
    return re.sub(r"\s+", " ", kept).strip()


def fold_text(text: str) -> str:
    marked = unicodedata.normalize("NFKD", text.casefold())
    return re.sub(r"[^\w]+", " ", "".join(c for c in marked if not unicodedata.combining(c))).strip()


_ALIKE = {ord(c): "-" for c in DASHES} | {ord(c): "'" for c in QUOTES} | {ord(c): '"' for c in DOUBLE}


def alike(text: str) -> str:
    """Compatibility forms and case folded, one kind of dash and of each quote; no character dropped."""
    return unicodedata.normalize("NFKC", text).casefold().translate(_ALIKE)


def normalise_keeping(text: str, keep: str = "") -> str:
    """normalise_text() that also keeps the punctuation in keep."""
    return re.sub(r"\s+", " ", alike(text).translate(_kept(keep))).strip()


class _Kept(dict):
    """What becomes of each character, found out once: nothing of punctuation that isn't kept."""

    def __init__(self, keep: str):
        self.keep = frozenset(KEPT + keep)

    def __missing__(self, c: int) -> int | None:
        self[c] = None if unicodedata.category(chr(c)).startswith("P") and chr(c) not in self.keep else c
        return self[c]


_kept = lru_cache(1024)(_Kept)


def once_each(df: DataFrame, columns: list[str], form: Column, out: str) -> DataFrame:
    """df with form, an expression of columns that is dear, worked out once for each distinct row of them and joined back."""
    keys = [f"__{c}" for c in columns]
    distinct = df.select(*columns).distinct()
    known = distinct.select(*[F.col(c).alias(k) for c, k in zip(columns, keys)], form.alias(out))
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(columns, keys)]
    return df.drop(out).join(known, same, "left").drop(*keys)


@F.pandas_udf(T.StructType([T.StructField("read", T.StringType()), T.StructField("required", T.StringType())]))
def _forms(reads: pd.Series, required: pd.Series, scripts: pd.Series) -> pd.DataFrame:
    rows = []
    for read, wanted, script in zip(reads, required, scripts):
        if wanted is None:
            rows.append((None, None))
            continue
        present = set(alike(wanted))
        keep = "".join(c for c in DELIMITERS if c not in present)
        spaces = "" if script in UNSPACED else " "
        rows.append(tuple(None if t is None else normalise_keeping(t, keep).replace(" ", spaces) for t in (read, wanted)))
    return pd.DataFrame(rows, columns=["read", "required"])


def comparable(df: DataFrame, read: str = "read", required: str = "required") -> DataFrame:
    """df with forms.read and forms.required, the texts as they are compared. Quotes and brackets that the required text has
    are dropped on both sides, as reads often miss them; those that it lacks are kept, each an extra character. Scripts
    without spaces between words lose theirs. Null where a text is null; each distinct pair is worked out once."""
    script = F.coalesce(detect_script(F.col(required)), F.lit("Zyyy"))
    return once_each(df, [read, required], _forms(F.col(read), F.col(required), script), "forms")


@F.pandas_udf(T.StringType())
def composed(texts: pd.Series) -> pd.Series:
    """Letters and the marks on them as one character, where there is one (NFC)."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def _mapped(texts: pa.Array, one: Callable[[str], str]) -> pa.Array:
    """one() of each text. Python holds the strings of a few texts at a time, not those of a whole batch on both sides."""
    parts = [pa.array([None if t is None else one(t) for t in texts.slice(at, SLICE).to_pylist()], pa.string()) for at in range(0, len(texts), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(T.StringType())
def normalise_exact(texts: pa.Array) -> pa.Array:
    """With compatibility forms and case folding ("Straße" gives "strasse")."""
    return _mapped(texts, normalise_text)


@F.arrow_udf(T.StringType())
def fold_key_exact(texts: pa.Array) -> pa.Array:
    return _mapped(texts, fold_text)


def fold_key(col: Column) -> Column:
    """Lower case without Latin marks, other signs as spaces."""
    return F.trim(F.regexp_replace(F.lower(F.translate(col, MARKED, PLAIN)), r"[^\p{L}\p{N}]+", " "))


def critical_tokens(col: Column) -> Column:
    """Numbers, prices and percents, then words of 2 to 4 capitals; trailing signs off, lower case, each once. Digits of any
    script count, full-width forms as plain ones."""
    text = F.translate(narrow(col), DASHES, "-" * len(DASHES))
    numbers = F.regexp_extract_all(text, F.lit(r"(?:^|[^\p{L}\p{N}])([-+]?\p{Sc}?\p{Nd}[\p{Nd}.,:/]*%?\p{Sc}?)"), 1)
    capitals = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}])\p{Lu}{2,4}(?![\p{L}\p{N}])"), 0)
    return F.array_distinct(F.transform(F.concat(numbers, capitals), lambda t: F.lower(F.rtrim(t, F.lit(".,:/")))))


def missing_tokens(read: Column, tokens: Column) -> Column:
    """Tokens that a read (lower case) lacks. A number isn't found inside a longer one, though a suffix may follow
    ("4th"); a word isn't found inside a longer word."""

    def found(t: Column) -> Column:
        quoted = F.concat(F.lit(r"\Q"), t, F.lit(r"\E"))
        number = F.concat(F.lit(r"(?<![\p{N}.,])"), quoted, F.lit(r"(?!\p{N})"))
        word = F.concat(F.lit(r"(?<![\p{L}\p{N}])"), quoted, F.lit(r"(?![\p{L}\p{N}])"))
        return F.regexp_like(read, F.when(F.regexp_like(t, F.lit(r"\p{Nd}")), number).otherwise(word))

    return F.filter(tokens, lambda t: ~found(t))


#: The format characters that a text may hold, since some scripts need them.
JOINERS = r"\x{200C}\x{200D}"


def validate_text(col: Column, longest: int = 80, lines: int = 3, blocked: Column | None = None) -> Column:
    """The first rule that a text breaks, or null. White space around it doesn't count; blocked says of each row
    whether the text is on a list (see blocklist). Lengths are of the text as it is; give composed() of it for those with
    marks composed."""
    t = F.regexp_replace(F.replace(col, F.lit("\r\n"), F.lit("\n")), r"^[\s\p{Z}\x1C-\x1F\x85]+|[\s\p{Z}\x1C-\x1F\x85]+$", "")
    return (
        F.when(col.isNull() | (F.length(t) == 0), "empty")
        .when(F.length(t) > longest, "too_long")
        .when(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) >= lines, "too_many_lines")
        .when(F.regexp_like(t, F.lit(r"[\p{Cc}&&[^\n]]")), "control")
        .when(F.regexp_like(t, F.lit(rf"[\p{{Cf}}\x{{180E}}\x{{E0000}}-\x{{E007F}}&&[^{JOINERS}]]")), "hidden")
        .when(F.regexp_like(t, F.lit(r"[\x{2028}\x{2029}]")), "hidden_break")
        .when(F.coalesce(F.lit(False) if blocked is None else blocked, F.lit(False)), "policy")
    )


def blocklist(df: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """(key, term) of each listed word or phrase in a text, also when digits stand for letters. The list is short."""
    plain = F.trim(F.regexp_replace(F.translate(F.lower(narrow(F.col(text))), *SWAPS), r"[^\p{L}\p{M}]+", " "))
    rows = df.select(key, plain.alias("__t"))
    words = rows.select(key, F.explode(F.array_distinct(F.split("__t", " "))).alias("term"))
    listed = df.sparkSession.createDataFrame([(t,) for t in sorted(set(terms))], "term string")
    found = words.join(F.broadcast(listed), "term", "left_semi").select(key, "term")
    phrases = sorted({t for t in terms if " " in t})
    if not phrases:
        return found
    hits = F.array_compact(F.array(*[F.when(F.contains(F.concat(F.lit(" "), "__t", F.lit(" ")), F.lit(f" {p} ")), F.lit(p)) for p in phrases]))
    return found.unionByName(rows.select(key, F.explode(hits).alias("term")))


#: Phrases that try to override instructions, marks that pose as another speaker's, hidden tags.
SIGNALS = {
    "role_override": r"(?i)(ignore|disregard|forget)\s+(all\s+|any\s+)?(the\s+)?(previous|prior|above|earlier)\s+(instructions|prompts?|rules|messages)"
    r"|(ignore|disregard|forget)\s+(all|any|every)\s+(the\s+|your\s+)?(rules|instructions|guidelines|checks)"
    r"|\b(approve|pass)\s+(this|the)\s+(ad|image)\b"
    r"|mark\s+(all|every)\s+(the\s+)?checks?\s+(as\s+)?pass"
    r"|you\s+are\s+now\s+"
    r"|new\s+instructions\s*:"
    r"|reveal\s+(your|the)\s+(system\s+)?prompt"
    r"|act\s+as\s+(an?\s+)?(unrestricted|jailbroken|dan)\b",
    "fake_marker": r"(?im)<\s*/?\s*(system|assistant|tool|untrusted[^>]*)\s*>|\[/?(system|inst)\]|<\|(im_start|im_end|system|endoftext)\|>|^\s*(system|assistant)\s*:",
    "unicode_tags": r"[\x{E0000}-\x{E007F}]",
}


def injection_signals(col: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.regexp_like(col, F.lit(p)), F.lit(n)) for n, p in SIGNALS.items()]))


#: The order matters, each pattern sees what the ones before it left.
PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("card", r"\b(?:\d[ -]?){13,19}\b"),
    ("aadhaar", r"\b\d{4}[ -]?\d{4}[ -]?\d{4}\b"),
    ("pan", r"\b[A-Z]{5}\d{4}[A-Z]\b"),
    ("phone", r"(?<![\w-])\+?\d[\d\s().-]{8,}\d\b"),
]


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with redacted and kinds: the text with a mark for each personal detail, and which kinds were found. Digits, letters
    and spaces are those of any script."""
    df = df.withColumns({"redacted": F.col(text), "kinds": F.array().cast("array<string>")})
    for kind, pattern in ((k, f"(?U){p}") for k, p in PERSONAL):
        found = F.when(F.regexp_like("redacted", F.lit(pattern)), F.array_append("kinds", F.lit(kind))).otherwise(F.col("kinds"))
        df = df.withColumns({"kinds": found, "redacted": F.regexp_replace("redacted", pattern, f"[REDACTED:{kind}]")})
    return df


#: Why a label failed.
REASONS = ("scale", "pasted", "shape", "colour", "label_text", "season", "geography", "people", "other")


def parse_reasons(col: Column, known: tuple[str, ...] = REASONS) -> Column:
    """Map of the pairs reason:<dimension>=<code>; unknown codes are dropped, the last of a dimension stays."""
    pairs = F.regexp_extract_all(col, F.lit(r"reason:\w+=\w+"), 0)
    split = F.transform(pairs, lambda p: F.split(F.substr(p, F.lit(8)), "="))
    kept = F.filter(split, lambda p: p[1].isin(*known))
    put = lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p[0]), F.create_map(p[0], p[1]))
    return F.aggregate(kept, F.create_map().cast("map<string,string>"), put)


def canonical_hash(*names: str) -> Column:
    """SHA-256 of the JSON of columns in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(names))), 256)


def dedup_ordered(col: Column) -> Column:
    """First occurrences of an array's strings, trimmed, whatever their case; empty ones go."""
    clean = F.filter(F.transform(col, lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    # sorted by key and place, each word whose key differs from the one before it; then back in order of place
    placed = F.array_sort(F.transform(clean, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x"))))
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform(placed, lambda e: e["k"]))
    pairs = F.filter(F.arrays_zip(placed.alias("e"), before.alias("b")), lambda z: z["e"].isNotNull() & ~z["e"]["k"].eqNullSafe(z["b"]))
    return F.transform(F.array_sort(F.transform(pairs, lambda z: F.struct(z["e"]["i"].alias("i"), z["e"]["x"].alias("x")))), lambda e: e["x"])


#: Codes of scripts.
SCRIPTS = {
    "Latn": "Latin", "Cyrl": "Cyrillic", "Grek": "Greek", "Arab": "Arabic", "Hebr": "Hebrew", "Deva": "Devanagari", "Beng": "Bengali", "Taml": "Tamil",
    "Thai": "Thai", "Khmr": "Khmer", "Kore": "Hangul", "Hani": "Han", "Ethi": "Ethiopic", "Sinh": "Sinhala",
}


def detect_script(col: Column) -> Column:
    """Jpan with any kana, else the script with most letters (the first seen on ties; Kore for Hangul). Letters of other
    scripts count together as Zyyy, which is also the script of a text without letters."""
    kana = r"[\p{IsHiragana}\p{IsKatakana}]+"
    # what is left of the letters after each script is gone, so that a pattern sees only letters that those before it left
    left = F.array(F.regexp_replace(col, r"\P{L}+", ""))

    def without(name: str) -> Callable[[Column], Column]:
        return lambda s: F.array_append(s, F.regexp_replace(F.element_at(s, -1), rf"\p{{Is{name}}}+", ""))

    for name in SCRIPTS.values():
        left = F.get(F.transform(F.array(left), without(name)), F.lit(0))
    inside = {code: rf"\p{{Is{name}}}" for code, name in SCRIPTS.items()}
    inside["Zyyy"] = rf"[^{''.join(rf'\p{{Is{name}}}' for name in SCRIPTS.values())}\p{{IsHiragana}}\p{{IsKatakana}}]"

    def dominant(s: Column) -> Column:
        def count(k: int, code: str, pattern: str) -> Column:
            n = F.length(F.regexp_replace(s[k], kana, "")) if code == "Zyyy" else F.length(s[k]) - F.length(s[k + 1])
            return F.struct(n.alias("n"), F.when(n > 0, -F.regexp_instr(s[0], F.lit(pattern))).otherwise(0).alias("i"), F.lit(code).alias("code"))

        # with no letters at all the codes decide, of which Zyyy is the last
        most = F.array_max(F.array(*[count(k, code, pattern) for k, (code, pattern) in enumerate(inside.items())]))
        return F.when(F.regexp_like(F.element_at(s, -1), F.lit(kana)), "Jpan").otherwise(most["code"])

    return F.get(F.transform(F.array(left), dominant), F.lit(0))


def vote(reads: DataFrame, k: int = 2) -> DataFrame:
    """Tokens (item_id, token) that at least min(k, number of readers) readers of an item saw. reads: (item_id, reader,
    token), a token counting once for each reader."""
    readers = reads.groupBy("item_id").agg(F.countDistinct("reader").alias("r"))
    seen = reads.groupBy("item_id", "token").agg(F.countDistinct("reader").alias("n"))
    return seen.join(readers, "item_id").where(F.col("n") >= F.least(F.lit(k), F.col("r"))).select("item_id", "token", "n")


def substring_distance(read: str, wanted: str) -> tuple[int, int]:
    """Least edit distance of wanted to any part of read, and the earliest end of such a part.

    Myers' bit vectors: a column of the distance table is two integers, so a character of read costs a few operations
    whatever the length of wanted.
    """
    size = len(wanted)
    if not size:
        return 0, 0
    full, top = (1 << size) - 1, 1 << (size - 1)
    places: dict[str, int] = {}
    for i, c in enumerate(wanted):
        places[c] = places.get(c, 0) | 1 << i
    up, down, here, best, end = full, 0, size, size, 0
    for j, c in enumerate(read, 1):
        same = places.get(c, 0)
        across = (((same & up) + up) ^ up) | same
        more, less = (down | ~(across | up)) & full, up & across
        here += bool(more & top) - bool(less & top)
        if here < best:
            best, end = here, j
        more = more << 1 & full
        both = same | down
        up, down = (less << 1 | ~(both | more)) & full, more & both
    return best, end


def shared_start(a: str, b: str) -> int:
    """How many characters a and b begin with in common; by halving, as slices are compared far faster than characters."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    step = 64
    while a[low : low + step] == b[low : low + step]:
        low += step
    high = min(high, low + step)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle)
    return low


def edits(required: str, read: str) -> list[tuple[str, int, str | None]]:
    """The fewest edits that turn required into read, as (chg, place, None) and (ins, place before, character). Equal
    ends are set aside; of equal scripts the one that keeps or changes characters latest. By Myers' bit vectors, walked back."""
    low = shared_start(required, read)
    tail = shared_start(required[low:][::-1], read[low:][::-1])
    a, b = required[low : len(required) - tail], read[low : len(read) - tail]
    full = (1 << len(a)) - 1
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    # columns of the distance table: where it rises and falls downwards, and from the column before
    columns = [(full, 0, 0, 0)]
    for c in b:
        up, down = columns[-1][:2]
        same = places.get(c, 0)
        across = (((same & up) + up) ^ up) | same
        rise, fall = (down | ~(across | up)) & full, up & across
        more, less, both = (rise << 1 | 1) & full, fall << 1 & full, same | down
        columns.append(((less | ~(both | more)) & full, more & both, rise, fall))
    i, j, out = len(a), len(b), []
    while i or j:
        left = diagonal = 0
        if i and j:
            if a[i - 1] == b[j - 1]:  # the distance is that without the two
                i, j = i - 1, j - 1
                continue
            at = i - 1
            left = (columns[j][3] >> at & 1) - (columns[j][2] >> at & 1)
            diagonal = left + (columns[j - 1][1] >> at & 1) - (columns[j - 1][0] >> at & 1)
        if i and j and diagonal + (a[i - 1] != b[j - 1]) == 0:
            i, j = i - 1, j - 1
            if a[i] != b[j]:
                out.append(("chg", low + i, None))
        elif j and (not i or left == -1):
            j -= 1
            out.append(("ins", low + i, b[j]))
        else:
            i -= 1
            out.append(("chg", low + i, None))
    return out[::-1]


def distance(a: str, b: str) -> int:
    """Edit distance, equal ends set aside; by Myers' bit vectors, as substring_distance()."""
    low = shared_start(a, b)
    tail = shared_start(a[low:][::-1], b[low:][::-1])
    a, b = a[low : len(a) - tail], b[low : len(b) - tail]
    if not a or not b:
        return len(a) + len(b)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    up, down, here = full, 0, len(a)
    for c in b:
        same = places.get(c, 0)
        across = (((same & up) + up) ^ up) | same
        more, less = (down | ~(across | up)) & full, up & across
        here += bool(more & top) - bool(less & top)
        more = (more << 1 | 1) & full
        both = same | down
        up, down = (less << 1 | ~(both | more)) & full, more & both
    return here


def error_keys(df: DataFrame) -> DataFrame:
    """(item_id, reader, kind, pos, glyph) of a read against what was required: chg at a changed or left-out character
    of required, ins before one with the inserted character, by the fewest edits; missing (pos -1) with each critical
    token that the read lacks. df: (item_id, reader, required, read); null texts are empty."""
    both = df.select("item_id", "reader", F.coalesce("required", F.lit("")).alias("required"), F.coalesce("read", F.lit("")).alias("read")).where("required <> read")
    # a script costs far more than its bytes: spread what few files hold over as many tasks as a shuffle has
    both = both.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "item_id", "reader")

    @F.pandas_udf("array<struct<kind:string,pos:int,glyph:string>>")
    def script(required: pd.Series, read: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "pos": p, "glyph": g} for k, p, g in edits(a, b)] for a, b in zip(required, read)])

    lacking = F.transform(missing_tokens(F.lower("read"), critical_tokens(F.col("required"))), lambda t: F.struct(F.lit("missing").alias("kind"), F.lit(-1).alias("pos"), t.alias("glyph")))
    return both.select("item_id", "reader", F.inline(F.concat(script("required", "read"), lacking)))


def text_decision(reads: DataFrame, errors: DataFrame) -> DataFrame:
    """(item_id, readers, agreed, decision): an error counts when two readers show it (inserts also one place apart).

    all_exact: no reader has an error; single_reader: one reader only; failed: an agreed error; else reread.
    """
    readers = reads.groupBy("item_id").agg(F.countDistinct("reader").alias("readers"))
    # one row of each error with the first and the last of its readers: two show it if these differ, so nothing is joined
    e = errors.select("item_id", "reader", "kind", "pos", F.coalesce("glyph", F.lit("")).alias("glyph")).repartition("item_id")
    e = e.groupBy("item_id", "kind", "pos", "glyph").agg(F.min("reader").alias("lo"), F.max("reader").alias("hi"))
    near = F.max("hi").over(Window.partitionBy("item_id", "kind", "glyph").orderBy("pos").rangeBetween(-1, 1))
    e = e.withColumn("two", F.col("lo") < F.when(F.col("kind") == "ins", near).otherwise(F.col("hi")))
    found = e.groupBy("item_id").agg(F.count_if("two").alias("agreed"), F.count("*").alias("errors"))
    rows = readers.join(found, "item_id", "left")
    decision = F.when(F.col("errors").isNull(), "all_exact").when(F.col("readers") == 1, "single_reader").when(F.col("agreed") > 0, "failed").otherwise("reread")
    return rows.select("item_id", "readers", F.coalesce("agreed", F.lit(0)).cast("long").alias("agreed"), decision.alias("decision"))


def grid(at: Column, cell: float) -> Column:
    """The cell of a place. Borders lie half way between the multiples of cell, as places are often rounded to such."""
    return F.floor(at / cell + 0.5)


def stray_agreement(reads: DataFrame, gap: float = 0.02, cell: float = 0.1) -> DataFrame:
    """Pairs of reads of one item by different readers that are near and alike: equal without spaces, one in the other
    (4 characters or more), or a similarity 1 - distance / length of 0.8. reads: (item_id, reader, read_no, text, x, y);
    blocked by grid cells. A read is copied to those cells only that the gap reaches."""
    t = reads.withColumn("c", compact(F.col("text")))
    reach = gap + cell / 1000  # more than rounding takes from a distance
    near_cells = lambda at: F.explode(F.sequence(grid(F.col(at) - reach, cell), grid(F.col(at) + reach, cell)))
    a = t.where("x IS NOT NULL AND y IS NOT NULL").select("item_id", "reader", "read_no", "c", "x", "y", near_cells("x").alias("cx")).select("*", near_cells("y").alias("cy"))
    b = t.select(F.col("item_id").alias("i2"), F.col("reader").alias("r2"), F.col("read_no").alias("n2"), F.col("c").alias("c2"), F.col("x").alias("x2"), F.col("y").alias("y2"), grid(F.col("x"), cell).alias("cx2"), grid(F.col("y"), cell).alias("cy2"))
    near = (F.abs(F.col("x") - F.col("x2")) <= gap) & (F.abs(F.col("y") - F.col("y2")) <= gap)
    met = a.join(b, (F.col("item_id") == F.col("i2")) & (F.col("cx") == F.col("cx2")) & (F.col("cy") == F.col("cy2")) & (F.col("reader") < F.col("r2")) & near)
    longer, shorter = F.greatest(F.length("c"), F.length("c2")), F.least(F.length("c"), F.length("c2"))
    plain = (F.col("c") == F.col("c2")) | ((shorter >= 4) & (F.contains("c", F.col("c2")) | F.contains("c2", F.col("c"))))
    # a distance is at least the difference of the lengths; what need not be measured goes to Python as null
    asked = F.when(F.col("c").isNotNull() & ~plain & (5 * (longer - shorter) <= longer), F.col("c2"))

    @F.pandas_udf("boolean")
    def similar(c: pd.Series, c2: pd.Series) -> pd.Series:
        return pd.Series([y is not None and 1 - distance(x, y) / max(len(x), len(y)) >= 0.8 for x, y in zip(c, c2)], dtype=bool)

    met = met.select("item_id", "read_no", F.col("n2").alias("other_no"), plain.alias("plain"), F.when(asked.isNotNull(), F.col("c")).alias("c"), asked.alias("c2"))
    return met.where(F.col("plain") | similar("c", "c2")).select("item_id", "read_no", "other_no")


def plant_typos(df: DataFrame, key: str, text: str, seed: int = 7, tries: int = 4) -> DataFrame:
    """df with kind, place, planted: one substitution, deletion or transposition of neighbours, chosen by md5 of the
    seed and the key; the first try that changes the compact form. Null if none does."""
    number = lambda n, part: F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), F.col(key), n)), part, 7), 16, 10).cast("long")

    def attempt(n: Column) -> Column:
        kind = number(n, 1) % 3
        return F.struct(kind.alias("kind"), (number(n, 9) % F.greatest(F.length(text) - 1, F.lit(1)) + 1).cast("int").alias("place"), F.chr(97 + number(n, 17) % 26).alias("letter"))

    def planted(o: Column) -> Column:
        t, at = F.col(text), o["place"]
        head, a, b = F.substring(t, F.lit(1), at - 1), F.substring(t, at, F.lit(1)), F.substring(t, at + 1, F.lit(1))
        rest = F.substring(t, at + 2, F.length(text))
        return F.when(o["kind"] == 0, F.concat(head, o["letter"], b, rest)).when(o["kind"] == 1, F.concat(head, b, rest)).otherwise(F.concat(head, b, a, rest))

    def changes(o: Column) -> Column:
        """Whether the compact form changes. It is made character by character, so that the two at the place tell, but for a
        capital sigma, whose small form depends on what stands around it."""
        at = o["place"]
        a, b = F.substring(text, at, F.lit(1)), F.substring(text, at + 1, F.lit(1))
        here = F.when(o["kind"] == 0, compact(a) != compact(o["letter"])).when(o["kind"] == 1, compact(a) != "").otherwise(F.concat(compact(a), compact(b)) != F.concat(compact(b), compact(a)))
        return F.when(F.contains(text, F.lit("\u03a3")), compact(planted(o)) != compact(F.col(text))).otherwise(here)

    options = F.array(*[attempt(F.lit(n)) for n in range(tries)])
    first = df.withColumn("__o", F.get(F.filter(options, changes), F.lit(0)))
    o = F.col("__o")
    name = F.when(o["kind"] == 0, "substitute").when(o["kind"] == 1, "delete").when(o["kind"] == 2, "transpose")
    return first.select(*df.columns, name.alias("kind"), o["place"].alias("place"), planted(o).alias("planted"))
