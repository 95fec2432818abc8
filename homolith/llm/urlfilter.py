"""URL filters: rules indexed by their rarest literal token, in DataFrame operations only."""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

#: Site rules (host, path, verdict); the longest that fits wins.
SITE_RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Pattern rules on the lower-cased URL, advertising and tracking: literal text, * for any stretch, ^ for a separator or the end.
PATTERN_RULES = ("/ads/", ".ads.", "/ads.", ".ads/", "/banner/", "^track^", ".track.", "/track.", "^doubleclick.", ".doubleclick.", "^utm_source=", "/sponsored^")
#: More rules than this are a table that URLs are joined with; fewer are in the plan.
INLINE = 200
#: What separates tokens in a URL; what ^ stands for.
TOKEN_BREAK, SEPARATOR = "[^a-z0-9_]+", "(?:[^a-z0-9_.%-]|$)"


def host_of(url):
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null and for URLs without ://."""
    rest = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url):
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def site_tokens(host: str, path: str) -> list[str]:
    """Tokens that every URL under a site rule has whole: its labels, and the path's parts that a separator ends."""
    ended = re.split(TOKEN_BREAK, path.lower())[:-1]
    return [t for t in [*re.split(TOKEN_BREAK, host.lower()), *ended] if t]


def pattern_tokens(pattern: str) -> list[str]:
    """Tokens that every URL which a pattern matches has whole: those with something that ends a token on both sides."""
    return [t for part in pattern.lower().split("*") for t in re.findall("(?<=[^a-z0-9_])[a-z0-9_]+(?=[^a-z0-9_])", part)]


def pattern_regex(pattern: str) -> str:
    return "(?s)" + "".join(SEPARATOR if c == "^" else ".*" if c == "*" else re.escape(c) for c in pattern.lower())


def token_counts(urls: DataFrame, url: str, wanted: list[str]) -> dict[str, int]:
    """How many URLs have each token of the rules: one row at most for each token of the rules reaches the driver."""
    spark = urls.sparkSession
    found = urls.select(F.explode(F.array_distinct(F.split(F.lower(F.coalesce(F.col(url), F.lit(""))), TOKEN_BREAK))).alias("t"))
    if len(wanted) <= INLINE:
        found = found.filter(F.col("t").isin(wanted))
    else:
        found = found.join(written(spark, spark.createDataFrame([(t,) for t in wanted], "t string"), "rule-tokens")[0], "t", "left_semi")
    return {r["t"]: r["n"] for r in found.groupBy("t").agg(F.count("*").alias("n")).collect()}


def index_of(rules: list[tuple[list[str], tuple]], counts: dict[str, int]) -> tuple[dict[str, list[tuple]], list[tuple]]:
    """Rules by their rarest token; and those that have no token, which every URL runs."""
    by, bare = defaultdict(list), []
    for tokens, rule in rules:
        if tokens:
            by[min(tokens, key=lambda t: (counts.get(t, 0), t))].append(rule)
        else:
            bare.append(rule)
    return by, bare


def best_of(rules, host, path):
    """Of the rules (an array) that fit, the longest one, of equal lengths the smaller text: a struct of n, rule and v."""
    fits = lambda r: ((host == r["h"]) | F.endswith(host, F.concat(F.lit("."), r["h"]))) & F.startswith(path, r["p"])
    return F.array_min(F.transform(F.filter(rules, fits), lambda r: F.struct((-F.length(F.concat(r["h"], r["p"]))).alias("n"), F.concat(r["h"], r["p"]).alias("rule"), r["v"].alias("v"))))


def literal(rows: list[tuple], names: tuple[str, ...]):
    if not rows:
        return F.filter(literal([("",) * len(names)], names), lambda r: F.lit(False))
    return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names, strict=True)]) for row in rows])


def fetched(tokens, index: dict[str, list[tuple]], bare: list[tuple], names: tuple[str, ...]):
    """The rules whose token is among a URL's, and those without one."""
    out = [literal(bare, names)]
    if index:
        table = F.create_map(*[x for t, rows in sorted(index.items()) for x in (F.lit(t), literal(rows, names))])
        out.append(F.flatten(F.transform(F.filter(tokens, lambda t: t.isin(sorted(index))), lambda t: table[t])))
    return F.concat(*out)


def joined(urls: DataFrame, index: dict[str, list[tuple]], names: tuple[str, ...], label: str) -> DataFrame:
    """(u, rules): the rules of a URL's tokens from a table of them. A small table is broadcast, as its size is known once it
    is written; else URLs move by token, and a token that many have is split."""
    spark = urls.sparkSession
    rows = [(t, *row) for t, of in index.items() for row in of]
    table, _ = written(spark, spark.createDataFrame(rows, ", ".join(f"{n} string" for n in ("t", *names))), label)
    found = urls.select("u", F.explode("t").alias("t")).join(table, "t")
    return found.groupBy("u").agg(F.collect_list(F.struct(*names)).alias("rules"))


def url_filter(pages: DataFrame, url: str = "url", site_rules=SITE_RULES, pattern_rules=PATTERN_RULES, default: str = "allow", inline: int = INLINE) -> DataFrame:
    """pages with host, path, rule and verdict (columns of these names are replaced).

    The longest site rule that fits gives rule and verdict (equal lengths: the smaller text). Else rule is null, and the
    verdict is block if a pattern rule matches, or `default`. A rule stands in the index under the rarest of its tokens; a
    URL's tokens fetch the candidates, and only these are compared. Up to `inline` rules are in the plan, which is a map
    over the rows without a shuffle; more are a table that the distinct URLs are joined with. Rules without a whole token
    meet every URL. Null and malformed URLs get the default, repeated rows each their own; an empty table gives an empty one.
    """
    sites = [(site_tokens(h, p), (h.lower(), p, v)) for h, p, v in site_rules]
    patterns = [(pattern_tokens(p), (pattern_regex(p),)) for p in pattern_rules]
    wanted = sorted({t for tokens, _ in [*sites, *patterns] for t in tokens})
    counts = token_counts(pages, url, wanted) if wanted else {}
    site_index, bare_sites = index_of(sites, counts)
    pattern_index, bare_patterns = index_of(patterns, counts)
    site_names, pattern_names = ("h", "p", "v"), ("x",)
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    # Nothing but the URL goes in, so that no column of the pages can be mistaken for one of these.
    low = lambda u: F.lower(u)
    tokens = lambda u: F.array_distinct(F.split(F.lower(u), TOKEN_BREAK))
    struct = "host string, path string, rule string, verdict string"

    def verdict(best, hit):
        return F.coalesce(best["v"], F.when(hit, "block").otherwise(default))

    matches = lambda rules, u: F.exists(rules, lambda r: F.regexp_like(low(u), r["x"]))
    (own,) = fresh(pages.select(*kept), "__url")
    if len(site_rules) + len(pattern_rules) <= inline:
        u = F.coalesce(pages[url], F.lit(""))
        df = pages.select(*[pages[c] for c in kept], F.struct(u.alias("u"), host_of(u).alias("host"), path_of(u).alias("path"), tokens(u).alias("t")).alias(own))
        at = lambda n: F.col(own)[n]
        best = best_of(fetched(at("t"), site_index, bare_sites, site_names), at("host"), at("path"))
        hit = matches(fetched(at("t"), pattern_index, bare_patterns, pattern_names), at("u"))
        (result,) = fresh(df, "__url_result")
        df = df.withColumn(result, F.struct(at("host").alias("host"), at("path").alias("path"), best["rule"].alias("rule"), verdict(best, hit).alias("verdict")))
        return df.select(*kept, *[F.col(result)[n].alias(n) for n in ("host", "path", "rule", "verdict")])
    u = F.col("u")
    urls = pages.select(F.coalesce(F.col(url), F.lit("")).alias("u")).distinct().select("u", host_of(u).alias("host"), path_of(u).alias("path"), tokens(u).alias("t"))
    urls, _ = written(pages.sparkSession, urls, "urls")
    df = urls.join(joined(urls, site_index, site_names, "site-rules").withColumnRenamed("rules", "s"), "u", "left").join(joined(urls, pattern_index, pattern_names, "pattern-rules").withColumnRenamed("rules", "q"), "u", "left")
    none = lambda c, bare, names: F.concat(F.coalesce(F.col(c), literal([], names)), literal(bare, names))
    best = best_of(none("s", bare_sites, site_names), F.col("host"), F.col("path"))
    hit = matches(none("q", bare_patterns, pattern_names), u)
    judged = df.select(u.alias(own), F.struct("host", "path", best["rule"].alias("rule"), verdict(best, hit).alias("verdict")).cast(f"struct<{struct.replace(' string', ': string')}>").alias(own + "_result"))
    out = pages.join(judged, F.coalesce(pages[url], F.lit("")) == judged[own])
    return out.select(*[pages[c] for c in kept], *[judged[own + "_result"][n].alias(n) for n in ("host", "path", "rule", "verdict")])


ORACLE = """
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
h AS (SELECT page_id, lower(url) AS low,
        CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM u),
p AS (SELECT page_id, low, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM h),
r AS (SELECT page_id, low, host, path,
        CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/7%' THEN 'example.com/en/7'
             WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/de/8%' THEN 'example.net/de/8'
             WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/en/%' THEN 'com/en/'
             WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/de/%' THEN 'net/de/'
             WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/es/%' THEN 'org/es/' END AS rule FROM p)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN regexp_matches(low, '[/.]ads[/.]|/banner/|[^a-z0-9_.%-]track([^a-z0-9_.%-]|$)|[/.]track\\.|([^a-z0-9_.%-]|\\.)doubleclick\\.|[^a-z0-9_.%-]utm_source=|/sponsored([^a-z0-9_.%-]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
