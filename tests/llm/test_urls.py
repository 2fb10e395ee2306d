import random
import re

import pytest

from assaykit.llm import urls

CASES = [
    (None, "", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("http://A.Example.COM/en/x?q=/es/", "a.example.com", "/en/x", "example.com/en/", "block"),
    ("https://www.example.com/en/x", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("https://deep.www.example.com/en/", "deep.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://notexample.com/en/a", "notexample.com", "/en/a", "com/", "allow"),
    ("http://example.com", "example.com", "", None, "allow"),
    ("http://example.com/EN/a", "example.com", "/EN/a", "com/", "allow"),
    ("http://x.net/es/1#f", "x.net", "/es/1", "net/es/", "block"),
    ("http://net/fr/", "net", "/fr/", "net/fr/", "block"),
    ("http://x.net/es", "x.net", "/es", None, "allow"),
    ("http://x.org/login?a", "x.org", "/login", None, "block"),
    ("http://x.org/page?PHPSESSID=1", "x.org", "/page", None, "block"),
    ("http://x.org/loginpage", "x.org", "/loginpage", None, "allow"),
    ("http://x.com/login", "x.com", "/login", "com/", "allow"),
    ("ftp://h?x", "h", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ("http://www.casino-win.org/a", "www.casino-win.org", "/a", None, "block"),
    ("http://casino.edu/a", "casino.edu", "/a", None, "allow"),
    ("http://x.org/a;jsessionid=1?b", "x.org", "/a;jsessionid=1", None, "block"),
    ("http://x.org/about-casino/?q=casino", "x.org", "/about-casino/", None, "allow"),
    ("http://x.org/wp-admin", "x.org", "/wp-admin", None, "block"),
    ("http://h\n.com/x\ny", "h\n.com", "/x\ny", "com/", "allow"),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, c[0], "r") for i, c in enumerate(CASES)] + [(0, None, "r")], "page_id bigint, url string, rule string")
    got = urls.judge(df)
    assert got.count() == len(CASES) + 1
    rows = {r.page_id: (r.url, r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    assert [rows[i] for i in range(len(CASES))] == CASES
    assert urls.judge(df.limit(0)).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    df = spark.createDataFrame([("http://www.example.com/en/a",), ("http://b.example.com/en/c",), ("http://c.com/en",)], "url string")
    rules = urls.default_rules()
    index = {r.name: t for r, t in zip(rules, urls.rarest_tokens(df, rules))}
    assert index["www.example.com/en/"] == "www" and index["example.com/en/"] == "example" and index["com/"] == "com"
    with pytest.raises(ValueError):
        urls.rarest_tokens(df, [urls.Rule("r", "block", ".", (), 1)])
    with pytest.raises(ValueError):
        urls.rarest_tokens(df, rules * 200)


def test_tokens_are_sure():
    cases = {"^casino^": ("casino",), "casino^": (), "/casino": (), "/a*casino^": (), "|www.*.org|": ("www", "org"), "^a.b-c=": ("a", "b", "c"), "*x^": ()}
    assert {p: urls.pattern_rule("block", "url", p).tokens for p in cases} == cases
    for bad in ("deny host ^a^", "block page ^a^"):
        with pytest.raises(ValueError):
            urls.parse_rules(bad)
    assert urls.parse_rules("\n# words\n  block host ^a^  \n")[0].action == "block"


def test_thousands_of_rules_against_running_every_rule(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcde", k=rng.randint(1, 3))) for _ in range(150)]
    word = lambda: rng.choice(words)
    forms = [lambda: f"^{word()}^", lambda: f"/{word()}^*{word()}", lambda: f".{word()}|", lambda: f"|{word()}.", lambda: f"^{word()}={word()}", lambda: f"-{word()}.{word()}^"]
    lines = {f"{rng.choice(['block'] * 60 + ['allow'])} {rng.choice(['host', 'path', 'query', 'url'])} {rng.choice(forms)()}" for _ in range(6000)}
    rules = [r for r in urls.parse_rules("\n".join(sorted(lines))) if r.tokens]
    assert len(rules) > 2000
    sign = lambda: rng.choice(".-/?=&#;_")
    made = [f"http://{word()}{rng.choice('.-')}{word().upper()}.{word()}/" + "".join(word() + sign() for _ in range(rng.randint(0, 6))) for _ in range(400)]
    rows = [(i, u) for i, u in enumerate([*made, None, "", "\u212aab://x/a"])]
    got = {r.page_id: (r.pattern, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id bigint, url string"), rules).collect()}
    blocked, compiled = 0, [re.compile(r.pattern.replace(r"\z", r"\Z"), re.A) for r in rules]
    for i, u in rows:
        rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
        host, path, query = re.fullmatch(r"(?s)([^/?#]*)([^?#]*)(?:\?([^#]*))?.*", rest).groups()
        fields = {"host": host.lower(), "path": path, "query": query or "", "url": u or ""}
        fits = [(r.action == "allow", r.name) for r, c in zip(rules, compiled) if c.search(fields[r.on])]
        best = max(fits, default=None)
        assert got[i] == (best and best[1], "allow" if not best or best[0] else "block"), u
        blocked += got[i][1] == "block"
    assert blocked > 50


def test_no_url_is_shuffled(spark, sf_dir):
    plan = urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "from_json" not in plan


def test_patterns_block_pages(spark):
    got = urls.judge(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"))
    assert got.where("rule IS NULL AND pattern IS NOT NULL AND verdict = 'block'").count() > 0
