"""URL filters with redirect equivalence.

Rules are (action, host, path): a rule fits its host and all subdomains where the URL's path
starts with the rule's, and the longest rule wins.  A URL that no rule fits is judged by what it
is the same page as: canonical links and refresh redirects make edges between URLs, and a block
that rules put on any URL of a connected component - crawled or only pointed at - holds for the
component's other URLs.  An explicit allow has precedence: a URL that a rule allows stays allowed
whatever its component holds, and passes nothing on.  What nothing blocks is allowed.

Null URLs and URLs without "://" have an empty host and path, no rule and no aliases.  Null html
has no links.  Repeated rows are judged alike; an empty table gives an empty result.  Pages of any
length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import components

Rule = tuple[str, str, str]


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(url: Column) -> Column:
    """What tells pages apart: host, path and query, without scheme and fragment; null if there is no host."""
    rest = F.regexp_extract(url, "://[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def match(rows: DataFrame, rules: list[Rule], host: str = "host", path: str = "path") -> DataFrame:
    """rows with the columns rule and action (null where none fits)."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(h, p, a) for a, h, p in rules], "rule_host string, rule_path string, rule_action string")
    urls = rows.select(F.col(host).alias("h"), F.col(path).alias("p")).distinct()
    parts = F.split("h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    fits = urls.withColumn("rule_host", F.explode(suffixes)).join(table, "rule_host").filter(F.col("p").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = fits.groupBy("h", "p").agg(F.min(F.struct((-F.length(rule)).alias("l"), F.col("rule_action").alias("action"), rule.alias("rule"))).alias("b"))
    best = best.select(F.col("h").alias(host), F.col("p").alias(path), F.col("b.rule").alias("rule"), F.col("b.action").alias("action"))
    return rows.join(best, [host, path], "left").select(*rows.columns, "rule", "action")


def _targets(html: Column) -> Column:
    """URLs that a page names as its own: canonical links, then refresh redirects."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)(<(?:link|meta)\b[^>]*>)"), 1)
    named = F.filter(tags, lambda t: t.rlike(r"(?i)\brel\s*=\s*[\x22']?canonical\b") | t.rlike(r"(?i)\bhttp-equiv\s*=\s*[\x22']?refresh\b"))
    href = lambda t: F.when(t.rlike("(?i)^<link"), F.regexp_extract(t, r"(?i)\bhref\s*=\s*[\x22']?([^\x22'\s>]+)", 1)).otherwise(F.regexp_extract(t, r"(?i)\burl\s*=\s*[\x22']?([^\x22'\s>]+)", 1))
    found = F.filter(F.transform(named, href), lambda u: u != "")
    worth = html.rlike("(?i)canonical|http-equiv")
    return F.when(worth, F.transform(found, lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))).otherwise(F.array().cast("array<string>"))


def _resolved(base: Column, target: Column) -> Column:
    """The target as an absolute URL."""
    folder = F.regexp_extract(path_of(base), "^(.*/)", 1)
    return (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(F.lit("http://"), host_of(base), target))
        .otherwise(F.concat(F.lit("http://"), host_of(base), F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): keys of URLs that are one page."""
    url, html = F.col(f"`{url_col}`"), F.col(f"`{html_col}`")
    named = pages.select(url.alias("url"), F.explode(_targets(html)).alias("target")).filter(F.col("url").isNotNull())
    edges = named.select(key_of(F.col("url")).alias("a"), key_of(_resolved(F.col("url"), F.col("target"))).alias("b"))
    return edges.filter("a is not null and b is not null and a <> b").distinct()


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, host, path, rule, verdict for every row."""
    edges = materialise(alias_edges(pages, url_col, html_col), "aliases")
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), key_of(url).alias("key"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = match(rows, rules)
    if edges.isEmpty():
        blocked = None
    else:
        roots = components(edges)
        nodes = match(roots.select("v", "root", host_of(F.concat(F.lit("x://"), "v")).alias("host"), path_of(F.concat(F.lit("x://"), "v")).alias("path")), rules)
        bad = nodes.filter("action = 'block'").select("root").distinct()
        blocked = materialise(roots.join(bad, "root").select(F.col("v").alias("key"), F.lit(True).alias("alias_blocked")), "blocked")
    if blocked is not None:
        judged = judged.join(blocked, "key", "left")
    else:
        judged = judged.withColumn("alias_blocked", F.lit(None).cast("boolean"))
    verdict = F.coalesce("action", F.when(F.col("alias_blocked"), F.lit("block")), F.lit("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))
