"""URL filters with redirect equivalence (native).

A rule (host, path) fits its host and all subdomains where the url's path starts with the rule's
path; the longest rule wins. Urls that redirects or canonical links join are one document under
several names: components over those edges carry a block from any of their pages to all pages that no
rule fits. An explicit allow goes first: a page that an allow rule fits is allowed, and a component
with an allowed page passes no block on.

Links come from the pages themselves (every `<link rel="canonical">` and `<meta http-equiv="refresh">`) and,
if given, from a table of redirects (from_url, to_url). A url's node is its host, path and query:
scheme and fragment don't make another document.

Rules are a list held by the driver, matched by conditions without a shuffle. The graph has only pages
with links; pages are joined to it by node, after a page's html has been dropped.
Defined results: null urls and urls without `://` have empty host and path, fit no rule and have no
links, so they are allowed; repeated rows are judged alike; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components, dealt_join
from ..sources.scratch import written
from .words import whole

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """Host, path and query; empty for what isn't a url."""
    return F.concat(host_of(url), F.regexp_extract(_after_scheme(url), "^[^/?#]*([^#]*)", 1))


def rule_of(rules: list[UrlRule], host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(str(r)), str(r), r.verdict == "allow")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(str(r)).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _targets(html: Column) -> Column:
    """All addresses that the page gives as its canonical ones or forwards to."""
    def values(tag: str, value: str) -> Column:
        tags = F.regexp_extract_all(html, F.lit(tag), F.lit(0))
        return F.transform(tags, lambda t: F.regexp_extract(t, value, 1))

    links = values(r"(?i)<link\s[^<>]*\brel\s*=\s*[\"']?canonical\b[^<>]*>", r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)")
    refreshes = values(r"(?i)<meta\s[^<>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^<>]*>", r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)")
    return F.array_distinct(F.transform(F.concat(links, refreshes), lambda t: F.replace(t, F.lit("&amp;"), F.lit("&"))))


def _resolved(target: Column, url: Column) -> Column:
    """The target as a url, seen from the page's url."""
    at = F.concat(F.lit("x://"), host_of(url))
    return (
        F.when(target.contains("://"), target).when(target.startswith("//"), F.concat(F.lit("x:"), target))
        .when(target.startswith("/"), F.concat(at, target)).when(target == "", None)
        .otherwise(F.concat(at, F.regexp_extract(F.concat(path_of(url), F.lit("")), "^(.*/)?", 0), target))
    )


def judged(pages: DataFrame, rules: list[UrlRule], redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, component (the least node that links join it with; null without links) for every row of pages (page_id, url, html)."""
    url, html = whole("url"), whole("html")
    read = pages.select(
        "page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"), rule_of(rules, host_of(url), path_of(url)).alias("found"),
        F.transform(_targets(html), lambda t: node_of(F.coalesce(_resolved(t, url), F.lit("")))).alias("targets"))
    read = written(read.select("page_id", "host", "path", "node", "found.rule", "found.verdict", "targets"), "pages")
    edges = read.where("node <> ''").select(F.col("node").alias("a"), F.explode("targets").alias("b")).where("b <> ''")
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(whole("from_url")).alias("a"), node_of(whole("to_url")).alias("b")).where("a <> '' and b <> ''"))
    parts = written(components(edges.toDF("from", "to")), "parts")
    marks = read.where("verdict is not null").groupBy("node").agg(F.max((F.col("verdict") == "block").cast("int")).alias("blocks"), F.max((F.col("verdict") == "allow").cast("int")).alias("allows"))
    per_part = parts.join(marks, "node").groupBy("component").agg(F.max("blocks").alias("blocks"), F.max("allows").alias("allows"))
    blocked = written(per_part.where("blocks = 1 and allows = 0").select(F.col("component").alias("blocked")), "blocked")
    # a component may have many nodes: its row goes to several tasks
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    passed = dealt_join(parts, written(sizes.join(blocked, F.col("component") == F.col("blocked"), "left"), "components"), ["component"], "node")
    out = read.join(passed.select("node", "component", F.when(F.col("blocked").isNotNull(), "block").alias("passed")), "node", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "passed", F.lit(default)).alias("verdict"), "component")
