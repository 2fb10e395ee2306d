"""URL filters: pattern rules that are found through their rarest literal token.

Rules are read from text, one in a line: action, field and pattern, parted by blanks; lines that begin with # and empty
ones are skipped.

* action: allow or block. Among the pattern rules that fit a URL, one that allows is an exception to those that block.
* field: host, path, query or url, what the pattern is looked for in (any part of it, whatever the case of A-Z).
* pattern: `*` stands for any characters, `^` for a place with no letter or digit beyond it, `|` at the start or end for
  the start or end of the field; all else stands for itself.

Besides, site rules name a host with its subdomains and a prefix of the path. They decide first, the longest of them.

Each rule has the literal tokens (runs of letters and digits) that any URL it fits has to contain whole. Tokens are
counted over all URLs; a rule is filed under its rarest one, in a table of buckets by the token's hash. A URL's tokens
fetch the rules filed under them, and only those rules' expressions are run on it. All of that happens within the
URL's row, so that no URL is shuffled.

A list has at most MOST rules; that bound is why the index may go along with the plan as a constant.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 10_000


@dataclass(frozen=True)
class Rule:
    """action: allow or block. name: shown for it. pattern: Java regular expression, tried on `on`: "place" (host and
    path), "host", "path", "query" or "url". tokens: what any URL that fits holds. weight: of site rules, the greatest
    decides."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int
    on: str = "place"
    site: bool = False


def site_rule(action: str, host: str, path: str) -> Rule:
    """A host with its subdomains and a prefix of the path; longer ones weigh more."""
    place = host + path
    whole = place if not place[-1:].isalnum() else re.sub(r"[A-Za-z0-9]+$", "", place)  # a cut word is no token
    quoted = "".join(c if c.isalnum() else "\\" + c for c in place)
    return Rule(place, action, f"^(?:[^/]*\\.)?{quoted}", tuple(re.findall("[a-z0-9]+", whole.lower())), len(place), site=True)


def _java(pattern: str) -> str:
    """The regular expression of a pattern."""
    out = []
    for i, c in enumerate(pattern):
        if c == "*":
            out.append(".*")
        elif c == "^":
            out.append("(?<![a-zA-Z0-9])" if pattern[i + 1 : i + 2].isalnum() else "(?![a-zA-Z0-9])")
        elif c == "|" and i in (0, len(pattern) - 1):
            out.append("\\A" if i == 0 else "\\z")
        else:
            out.append(c if c.isalnum() else "\\" + c)
    return "(?si)" + "".join(out)


def pattern_rule(action: str, on: str, pattern: str) -> Rule:
    """A rule of a line."""
    if action not in ("allow", "block") or on not in ("host", "path", "query", "url"):
        raise ValueError(f"no rule: {action} {on} {pattern}")
    # a token is sure to be whole only where something that is no letter or digit stands on either side of it
    tokens = re.findall(r"(?<![a-z0-9*])(?<!\A)[a-z0-9]+(?![a-z0-9*]|\Z)", pattern.lower())
    return Rule(f"{on} {pattern}", action, _java(pattern), tuple(tokens), 0, on)


def parse_rules(text: str) -> list[Rule]:
    """Rules of a text in the form given above."""
    lines = (line.strip() for line in text.splitlines())
    return [pattern_rule(*line.split(None, 2)) for line in lines if line and not line.startswith("#")]


#: The rules of sites.
SITES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Words of a host that say what a site is for: gambling, medicines, adult content, advertising, unwanted mail.
HOSTS = """
    bet bets betting bingo blackjack casino casinos gamble gambling jackpot lotto lottery poker roulette slots sportsbook
    cialis pharma pharmacy pills steroids tramadol viagra
    adult camgirls escort escorts hentai porn porno sex xxx
    ads adserver adservice adtrack adtracker affiliate affiliates banners clicktrack doubleclick popads popunder tracker tracking
    spam spammer linkfarm warez cracks keygen
""".split()
#: Parts of a path, and names of a query, that lead to accounts, carts, sessions and other views of the same page.
PATHS = "login signin signup register logout cart checkout wishlist wp-login wp-admin trackback cgi-bin".split()
QUERIES = "sid phpsessid jsessionid sessionid replytocom print sort".split()
#: Registries whose sites are left alone, whatever their name says.
TRUSTED = "edu gov".split()


def default_rules() -> list[Rule]:
    """The site rules, and those of the word lists above."""
    lines = [f"block host ^{w}^" for w in HOSTS] + [f"block path /{w}^" for w in PATHS] + [f"block query ^{w}=" for w in QUERIES]
    lines += [f"allow host .{w}|" for w in TRUSTED] + ["block path ;jsessionid="]
    return [site_rule(*s) for s in SITES] + parse_rules("\n".join(lines))


def parts(url: Column) -> dict[str, Column]:
    """host (A-Z lower-cased), path and query; all empty for a null or a URL without `://`."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return {"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), "query": F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)}


def _tokens(url: str = "url") -> Column:
    found = F.regexp_extract_all(F.coalesce(F.col(url), F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda t: F.lower(t)))


def rarest_tokens(urls: DataFrame, rules: list[Rule]) -> list[str]:
    """Of each rule the token that occurs in the fewest urls (the first by name of equals)."""
    spark = urls.sparkSession
    if len(rules) > MOST:
        raise ValueError(f"{len(rules)} rules; at most {MOST} can go along with the plan")
    for r in rules:
        if not r.tokens:
            raise ValueError(f"a rule without a literal token can't be filed: {r.name}")
    wanted = spark.createDataFrame([(t,) for t in sorted({t for r in rules for t in r.tokens})], "token string")
    seen = urls.select(F.explode(_tokens()).alias("token")).join(F.broadcast(wanted), "token", "left_semi")
    counts = {r["token"]: r["n"] for r in seen.groupBy("token").agg(F.count("*").alias("n")).collect()}  # one row a token of the rules
    return [min(r.tokens, key=lambda t: (counts.get(t, 0), t)) for r in rules]


FILED = "array<array<struct<token:string,name:string,allows:boolean,pattern:string,field:string,weight:int,site:boolean>>>"


def rule_index(rules: list[Rule], tokens: list[str]) -> tuple[Column, int]:
    """The buckets of rules, as a constant, and their number."""
    size = 1 << max(4, (2 * len(rules)).bit_length())
    buckets: list[list[dict]] = [[] for _ in range(size)]
    for rule, token in zip(rules, tokens):
        row = {"token": token, "name": rule.name, "allows": rule.action == "allow", "pattern": rule.pattern, "field": rule.on, "weight": rule.weight, "site": rule.site}
        buckets[crc32(token.encode()) % size].append(row)
    return F.from_json(F.lit(json.dumps(buckets)), FILED), size


def judge(urls: DataFrame, rules: list[Rule] | None = None, default: str = "allow") -> DataFrame:
    """One row for each row of urls (page_id, url): page_id, url, host, path, rule, pattern, verdict.

    rule is the site rule that fits and weighs most, else null; it decides. Else pattern is the pattern rule that
    fits (allow before block, then the last by name), and decides; without one the verdict is the default's, as for a
    null or empty URL. Repeated rows stay; other columns don't matter; long URLs are read whole. An empty table gives
    no rows.
    """
    rules = default_rules() if rules is None else rules
    buckets, size = rule_index(rules, rarest_tokens(urls.select("url"), rules))
    rows = urls.select("page_id", "url", *[c.alias(n) for n, c in parts(F.col("url")).items()])

    def subject(r: Column) -> Column:
        field = r["field"]
        return F.when(field == "place", F.concat("host", "path")).when(field == "host", F.col("host")).when(field == "path", F.col("path")).when(field == "query", F.col("query")).otherwise(F.coalesce("url", F.lit("")))

    filed = F.transform(_tokens(), lambda t: F.filter(F.get(buckets, F.pmod(F.crc32(t.cast("binary")), F.lit(size)).cast("int")), lambda r: r["token"] == t))
    fits = F.filter(F.flatten(filed), lambda r: F.regexp_like(subject(r), r["pattern"]))
    order = lambda r: F.struct(r["site"].alias("site"), r["weight"].alias("weight"), r["allows"].alias("allows"), r["name"].alias("name"))
    best = rows.withColumn("best", F.array_max(F.transform(fits, order)))
    action = F.when(F.col("best.allows"), "allow").when(~F.col("best.allows"), "block").otherwise(F.lit(default))
    named = lambda site: F.when(F.col("best.site") == site, F.col("best.name"))
    return best.select("page_id", "url", "host", "path", named(True).alias("rule"), named(False).alias("pattern"), action.alias("verdict"))
