from __future__ import annotations

import random
import re

import pytest
from compare import compare
from pyspark.sql import functions as F

from tideline.llm import queries
from tideline.llm import url_filters as uf


def matches(pattern: str, url: str) -> bool:
    """Whether a lower-case URL fits a pattern."""
    body = pattern.removeprefix("|").removeprefix("|")
    end = body.endswith("|")
    body = body[:-1] if end else body
    parts = [".*" if c == "*" else "(?:[^a-z0-9_.%-]|$)" if c == "^" else re.escape(c) for c in body]
    head = "[^:/?#]*://(?:[^/?#]*[.])?" if pattern.startswith("||") else "" if pattern.startswith("|") else ".*?"
    return re.match(head + "".join(parts) + ("\\Z" if end else ""), url, re.S) is not None


def plain(url: str | None) -> tuple:
    u = url or ""
    host = path = ""
    if "://" in u:
        rest = u.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    low = re.sub("[A-Z]", lambda m: m[0].lower(), u)
    hits = {v for p, v in uf.PATTERNS if matches(p, low)}
    verdict, rule = ("block" if hits == {"block"} else "allow"), None
    for h, p, v in sorted(uf.SITE_RULES, key=lambda r: len(r[0] + r[1])):
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            rule, verdict = h + p, v
    return host, path, rule, verdict


URLS = [
    "http://www.Example.com/en/1?x=1", "https://a.example.com/en/", "https://example.com/EN/", "http://com/", "http://x.com", "http://x.net/es/2#y", "http://net/fr/", "http://x.net/fr", "https://fr.example.net/fr/1",
    "http://spam-farm.example.org/en/1", "http://not-spam-farm.example.org/", "http://a.cheap-pills.org/robots.txt", "http://a.cheap-pills.org/robots.txt?x", "http://h.org/casino/", "http://h.org/a/casino/b?affiliate=1",
    "http://h.org/click?a=1&clickid=3", "http://h.org/x?y&affiliate=z", "http://h.org/wp-login.php", "http://h.org/wp-login.phpx", "xx doubleclick yy", "http://h.org/undoubleclicked", "http://h.org/viagra", "http://h.org/viagras",
    "no scheme /casino/", "a://b://c/d", "http://", "://", "", None, "http://user@h.org:80/x", "http://é.org/ü?#", "http://h.org/" + "a/" * 20_000 + "porn/", "HTTP://H.ORG/PORN/", "http://h.org/a\nb",
]


def test_rows(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[0]), (3, URLS[3]), (3, URLS[3])]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS u", "'x' AS host", "2 AS token", "3 AS block")
    got = sorted([tuple(r) for r in uf.filter_urls(df).collect()], key=repr)
    assert got == sorted([(i, *plain(u)) for i, u in rows], key=repr)
    assert uf.filter_urls(df.limit(0)).count() == 0


def test_whole_tokens(spark):
    want = {"||spam-farm.": ["spam", "farm"], "||casino*.": [""], "*doubleclick*": [""], "/click?*&clickid=": ["click", "clickid"], "/wp-login.php|": ["wp", "login", "php"], "abc/def": [""], "|http://x^": ["http", "x"], "/a1%2/b*c/": ["a1%2"]}
    df = spark.createDataFrame([(p,) for p in want], "pattern string")
    assert {r.pattern: r.t for r in df.select("pattern", uf.pattern_tokens(F.col("pattern")).alias("t")).collect()} == want


def test_every_rule_is_found_by_its_token(spark):
    urls = spark.createDataFrame([(u,) for u in URLS if u], "u string").distinct()
    index = uf.rule_index(urls, uf.PATTERNS).collect()
    assert len(index) == len(uf.PATTERNS) == len({r.regex for r in index})
    assert {r.token for r in index if "casino.*" in r.regex} == {""}


def test_thousands_of_rules(spark):
    """Rules of all classes as a table, against every rule on every URL."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc0") for _ in range(rng.randint(2, 4)))
    forms = [lambda: f"||{word()}.", lambda: f"/{word()}/", lambda: f"?{word()}=", lambda: f"/{word()}^", lambda: f"/{word()}.{word()}|", lambda: f"*{word()}{word()}*", lambda: f"/{word()}*&{word()}=", lambda: f"|http://{word()}.", lambda: f"/{word()}+[{word()}]"]
    rules = sorted({(rng.choice(forms)(), rng.choice(["block", "block", "allow"])) for _ in range(3000)})
    urls = [f"http{rng.choice(['', 's'])}://{word()}.{word()}.{rng.choice(['com', 'net', 'org'])}/{word()}/{word()}{rng.choice(['', '.' + word(), '?' + word() + '=1&' + word() + '=2', '+[' + word() + ']'])}" for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame(rules, "pattern string, verdict string")
    got = {r.page_id: r.verdict for r in uf.filter_urls(df, site_rules=[], patterns=table).collect()}
    want = {i: "block" if {v for p, v in rules if matches(p, u)} == {"block"} else "allow" for i, u in enumerate(urls)}
    assert got == want and set(want.values()) == {"allow", "block"}
    again = {r.page_id: r.verdict for r in uf.filter_urls(df, site_rules=[], patterns=rules[:300]).collect()}
    assert again == {i: "block" if {v for p, v in rules[:300] if matches(p, u)} == {"block"} else "allow" for i, u in enumerate(urls)}


def test_hot_urls(spark):
    df = spark.range(3000).selectExpr("id AS page_id", "CASE WHEN id % 3 = 0 THEN 'http://h.org/porn/' WHEN id % 3 = 1 THEN NULL ELSE concat('http://h.org/', id) END AS url")
    got = {r.page_id: r.verdict for r in uf.filter_urls(df).collect()}
    assert len(got) == 3000 and all((v == "block") == (i % 3 == 0) for i, v in got.items())


def test_plan_has_no_python(spark):
    plan = uf.op5_url_filters(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", ["op5_url_filters", "op8_warc", "op9_substring_dedup"])
def test_against_sql(spark, name):
    assert compare(spark, "/root/testdata/sf0.01", queries.queries()[name], queries.oracle_sql()[name]) == ""
