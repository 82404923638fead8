"""URL filters (operator 5, native): pattern rules indexed by their rarest token.

A method rule is written as in ad-block lists: ``*`` stands for anything, ``^``
for a separator or the end, ``|`` for either end of the URL and ``||`` for the
start of a host label. From every rule the whole literal tokens are taken; the
one seen least in all URLs of the corpus becomes its index entry. A URL's tokens
fetch candidate rules by a join, and only those rules run their regular expression.
Rules without a whole token stand under the empty token, which every URL has. The rules
are a list or a table; the index has one row for each rule, and is broadcast if it has
at most ``SENT_RULES`` rows.

Each distinct URL is judged once, and what was found goes back to the rows under
``SALTS`` salts, so that a URL which a third of the rows repeat is no hot task. All of it
is DataFrame code, turning rules to regular expressions included; there is no Python on
the executors.

Defined cases: a null URL is judged as the empty URL (both parts empty, no rule);
repeated rows are judged alike and all returned; an empty table gives no rows;
other columns are ignored; very long URLs are matched whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST_PATH = r"(?s)^.*?://([^/?#]*)([^?#]*)"
NOT_TOKEN = "[^a-z0-9%]+"

#: Fixed by the contract: (host, path, verdict).
SITE_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: The method's own list: (pattern, verdict); an allow rule lifts any block.
PATTERNS = [
    ("||spam-farm.", "block"),
    ("||cheap-pills.", "block"),
    ("||casino*.", "block"),
    ("||adserver.", "block"),
    ("/casino/", "block"),
    ("/porn/", "block"),
    ("/viagra^", "block"),
    ("?affiliate=", "block"),
    ("&affiliate=", "block"),
    ("/click?*&clickid=", "block"),
    ("/wp-login.php|", "block"),
    ("*doubleclick*", "block"),
    ("/robots.txt|", "allow"),
    ("||example.org/en/about^", "allow"),
    ("||free-bets.", "block"),
    ("||win-prize*.", "block"),
    ("#popup|", "block"),
    ("?page=1000", "block"),
    ("*sessionid=", "block"),
    ("|ftp:", "block"),
]

#: Rules up to which the index is broadcast, and salts of the join back.
SENT_RULES, SALTS = 200_000, 32


def pattern_regex(pattern: Column) -> Column:
    """The pattern as a regular expression that Java and RE2 read alike."""
    body = F.regexp_replace(F.regexp_replace(pattern, r"^[|]{1,2}", ""), r"[|]$", "")
    body = F.regexp_replace(body, r"([\[\](){}.+?$|\\#!\"',:;<>@`~])", r"\\$1")
    body = F.replace(F.replace(body, F.lit("*"), F.lit(".*")), F.lit("^"), F.lit("(?:[^a-z0-9_.%-]|$)"))
    head = F.when(F.startswith(pattern, F.lit("||")), "^[^:/?#]*://(?:[^/?#]*[.])?").when(F.startswith(pattern, F.lit("|")), "^").otherwise("")
    tail = F.when((F.length(pattern) > 2) & F.endswith(pattern, F.lit("|")), "$").otherwise("")
    return F.concat(F.lit("(?s)"), head, body, tail)


def pattern_tokens(pattern: Column) -> Column:
    """Literal tokens of which both ends are known not to run on in a URL; the empty
    token where there is none."""
    left = F.when(F.startswith(pattern, F.lit("|")), pattern).otherwise(F.concat(F.lit("*"), pattern))
    both = F.when(F.endswith(pattern, F.lit("|")), left).otherwise(F.concat(left, F.lit("*")))
    found = F.array_distinct(F.regexp_extract_all(both, F.lit(r"(?<![a-z0-9%*])([a-z0-9%]++)(?![*])"), F.lit(1)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))


def literal_rows(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    """A small table from literals, made by the JVM."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in rows])))


def rule_table(spark: SparkSession, patterns: Sequence[tuple[str, str]] | DataFrame) -> DataFrame:
    """(pattern, verdict) of a list or table of rules, each once."""
    if isinstance(patterns, DataFrame):
        return patterns.select("pattern", "verdict").where("pattern <> '' AND verdict IN ('block', 'allow')").distinct()
    return literal_rows(spark, [{"pattern": p, "verdict": v} for p, v in patterns])


def url_parts(url: Column) -> tuple[Column, Column]:
    host = F.translate(F.regexp_extract(url, HOST_PATH, 1), UPPER, LOWER)
    return host, F.regexp_extract(url, HOST_PATH, 2)


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.translate(url, UPPER, LOWER), NOT_TOKEN)))


def rule_index(urls: DataFrame, patterns: Sequence[tuple[str, str]] | DataFrame) -> DataFrame:
    """(token, regex, block, allow): each rule under its token that is rarest in
    ``urls`` (column u). As many rows as rules."""
    rules = rule_table(urls.sparkSession, patterns)
    named = rules.select("pattern", "verdict", F.explode(pattern_tokens(F.col("pattern"))).alias("token"))
    counts = urls.select(F.explode(url_tokens(F.col("u"))).alias("token")).join(named.select("token").distinct(), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ranked = named.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = ranked.groupBy("pattern", "verdict").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    of = lambda v: (F.col("verdict") == v).cast("int").alias(v)
    return rarest.select("token", pattern_regex(F.col("pattern")).alias("regex"), of("block"), of("allow"))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", site_rules: Sequence[tuple[str, str, str]] = SITE_RULES, patterns: Sequence[tuple[str, str]] | DataFrame = PATTERNS) -> DataFrame:
    """Judge every row's URL: ``id_col``, host, path, rule, verdict. ``patterns`` is a list
    or a table (pattern, verdict) of the method's rules."""
    rows = pages.select(F.col(id_col), F.coalesce(F.col(url_col), F.lit("")).alias("u"))
    urls = rows.select("u").distinct()
    index = rule_index(urls, patterns)
    many = patterns.limit(SENT_RULES + 1).count() if isinstance(patterns, DataFrame) else len(patterns)
    seen = urls.select("u", F.explode(url_tokens(F.col("u"))).alias("token"))
    fits = F.expr("regexp_like(translate(u, '%s', '%s'), regex)" % (UPPER, LOWER))
    met = seen.join(F.broadcast(index) if many <= SENT_RULES else index, "token").where(fits)
    judged = met.groupBy("u").agg(F.max("block").alias("block"), F.max("allow").alias("allow"))
    salted = judged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    method = F.when((F.col("block") == 1) & (F.coalesce("allow", F.lit(0)) == 0), "block").otherwise("allow")
    host, path = url_parts(F.col("u"))
    spread = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    out = spread.join(salted, ["u", "salt"], "left").select(id_col, host.alias("host"), path.alias("path"), method.alias("method_verdict"))
    rule, verdict = F.lit(None).cast("string"), F.col("method_verdict")
    for h, p, v in sorted(site_rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        hit = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        rule, verdict = F.when(hit, h + p).otherwise(rule), F.when(hit, v).otherwise(verdict)
    return out.select(id_col, "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


#: The method's list as RE2 reads it, for SQL (fixed values).
SQL_PATTERNS = {
    "block": [
        r"^[^:/?#]*://(?:[^/?#]*[.])?spam-farm[.]", r"^[^:/?#]*://(?:[^/?#]*[.])?cheap-pills[.]", r"^[^:/?#]*://(?:[^/?#]*[.])?casino.*[.]", r"^[^:/?#]*://(?:[^/?#]*[.])?adserver[.]",
        r"/casino/", r"/porn/", r"/viagra(?:[^a-z0-9_.%-]|$)", r"[?]affiliate=", r"&affiliate=", r"/click[?].*&clickid=", r"/wp-login[.]php$", r"doubleclick",
        r"^[^:/?#]*://(?:[^/?#]*[.])?free-bets[.]", r"^[^:/?#]*://(?:[^/?#]*[.])?win-prize.*[.]", r"#popup$", r"[?]page=1000", r"sessionid=", r"^ftp:",
    ],
    "allow": [r"/robots[.]txt$", r"^[^:/?#]*://(?:[^/?#]*[.])?example[.]org/en/about(?:[^a-z0-9_.%-]|$)"],
}


def oracle() -> str:
    """Every pattern against every URL, without an index."""
    say = lambda x: "'" + x.replace("'", "''") + "'"
    low = f"translate(u, '{UPPER}', '{LOWER}')"
    any_of = {v: " OR ".join(f"regexp_matches({low}, {say('(?s)' + p)})" for p in found) for v, found in SQL_PATTERNS.items()}
    cases = {"rule": [], "verdict": []}
    for h, p, v in sorted(SITE_RULES, key=lambda r: -len(r[0] + r[1])):
        hit = f"(host = {say(h)} OR ends_with(host, {say('.' + h)})) AND starts_with(path, {say(p)})"
        cases["rule"].append(f"WHEN {hit} THEN {say(h + p)}")
        cases["verdict"].append(f"WHEN {hit} THEN {say(v)}")
    return f"""
    WITH p AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
    q AS (SELECT page_id,
                 translate(regexp_extract(u, '{HOST_PATH}', 1), '{UPPER}', '{LOWER}') AS host,
                 regexp_extract(u, '{HOST_PATH}', 2) AS path,
                 CASE WHEN ({any_of['block']}) AND NOT ({any_of['allow']}) THEN 'block' ELSE 'allow' END AS own
          FROM p)
    SELECT page_id, host, path, CASE {' '.join(cases['rule'])} END AS rule,
           CASE {' '.join(cases['verdict'])} ELSE own END AS verdict
    FROM q"""
