"""URL filters with redirect equivalence.

Rules name a host, with all its subdomains, and a path prefix; the longest
fitting rule decides a URL.  Redirects and canonical links say that two URLs
are one page: over these edges distributed connected components are formed,
and a block decision of any URL in a component reaches its aliases that no
rule decides.  Explicit allow takes precedence: a URL's own rule always
decides it, and a component in which any URL is explicitly allowed blocks
nothing else.  All of it is DataFrame operations.

A node is a URL without its fragment, scheme and host in lower case and dot
segments of its path taken out (RFC 3986).  Every ``link`` tag outside of
comments whose ``rel`` holds the word canonical and every ``meta`` refresh tag
with a target gives an edge; relative targets are resolved against the page's
URL (``base`` tags are not read), ``&amp;`` is read as ``&``.

Defined results.  A null URL, or one without ``://``, has an empty host and
path, fits no rule and is an alias of nothing: allow.  Rules judge URLs as
they are written, so dot segments count there.  Equal URLs are one node.  Rows
that are repeated get the same verdict each.  Extra columns are kept out of
the result; no rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import drop_table, write_table
from shelfspark.operators.components import connected_components

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_COMMENT = r"(?s)<!--.*?(?:-->|\z)"
_TAG = r"(?is)<(?:link|meta)\b[^>]*>"
_REFRESH = r"""(?is)^[\d.\s]*[;,\s]\s*(?:url\s*=\s*)?["']?\s*([^"'\s]+)"""
_QUOTES = "\"' \t\n\x0b\x0c\r"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def node(url: Column) -> Column:
    """The URL as a node; null if it is no absolute URL."""
    whole = F.substring_index(url, "#", 1)
    head = F.regexp_extract(whole, r"(?s)^.*?://[^/?#]*", 0)
    rest = F.substring(whole, F.length(head) + 1, F.length(whole))
    way = F.substring_index(rest, "?", 1)
    parts = F.split(way, "/", -1)
    step = lambda acc, x: F.when(x == "..", F.regexp_replace(acc, r"/[^/]*$", "")).when(x == ".", acc).otherwise(F.concat(acc, F.lit("/"), x))
    clean = F.concat(F.aggregate(F.slice(parts, 2, F.size(parts)), F.lit(""), step), F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit("")))
    rest = F.when(way.startswith("/") & way.contains("/."), F.concat(clean, F.substring(rest, F.length(way) + 1, F.length(rest)))).otherwise(rest)
    return F.when(url.contains("://"), F.concat(F.translate(head, _UPPER, _LOWER), rest))


def _attribute(tag: Column, name: str) -> Column:
    return F.btrim(F.regexp_extract(tag, rf"""(?is)[\s"'/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1), F.lit(_QUOTES))


def _target(tag: Column) -> Column:
    """Where a link or meta tag says the page is; empty or null if it does not."""
    canonical = F.array_contains(F.split(F.lower(_attribute(tag, "rel")), r"\s+"), "canonical")
    refresh = F.lower(_attribute(tag, "http-equiv")) == "refresh"
    return F.when(F.lower(tag).startswith("<link"), F.when(canonical, _attribute(tag, "href"))).when(refresh, F.regexp_extract(_attribute(tag, "content"), _REFRESH, 1))


def _fits(h: Column, p: Column, rule: str) -> Column:
    name, slash, rest = rule.partition("/")
    return ((h == name) | h.endswith("." + name)) & p.startswith(slash + rest)


def matched_rule(h: Column, p: Column, rules: dict[str, str]) -> Column:
    """The longest fitting rule, null if none fits; of equal length the first in the alphabet."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r), r), reverse=True):
        out = F.when(_fits(h, p, rule), F.lit(rule)).otherwise(out)
    return out


def action(rule: Column, rules: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for r, what in rules.items():
        out = F.when(rule == r, F.lit(what)).otherwise(out)
    return out


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b): canonical links and redirects in pages(url, html)."""
    base, to = F.col("url"), F.col("to")
    tags = F.regexp_extract_all(F.regexp_replace("html", _COMMENT, ""), F.lit(_TAG), F.lit(0))
    found = pages.where(F.col("url").contains("://")).select("url", F.explode(F.transform(tags, _target)).alias("to")).where("to != ''")
    found = found.select("url", F.regexp_replace("to", "&amp;", "&").alias("to"))
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/(?:[^?#]*/)?)?)", 1)
    full = (
        F.when(to.startswith("#"), base)
        .when(to.contains("://"), to)
        .when(to.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), to))
        .when(to.startswith("/"), F.concat(root, to))
        .when(to.startswith("?"), F.concat(F.regexp_extract(base, r"(?s)^([^?#]*)", 1), to))
        .when(folder.endswith("/"), F.concat(folder, to))
        .otherwise(F.concat(folder, F.lit("/"), to))
    )
    return found.select(node(base).alias("a"), node(full).alias("b")).where("a is not null and b is not null and a != b")


def filter_urls(pages: DataFrame, rules: dict[str, str], redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of pages(page_id, url, html).

    rules: rule -> allow or block; a handful, they become one expression.
    redirects(a, b): further alias edges between URLs, such as a redirect log.
    """
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(node(F.col("a")).alias("a"), node(F.col("b")).alias("b")))
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), node(F.col("url")).alias("node"))
    rows = rows.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))
    edges = write_table(edges.where("a is not null and b is not null and a != b").distinct(), "aliases")
    named = connected_components(edges)
    drop_table(edges)
    said = named.select("node", "component", matched_rule(host(F.col("node")), path(F.col("node")), rules).alias("rule"))
    said = said.withColumn("act", action(F.col("rule"), rules))
    whole = said.groupBy("component").agg(F.max(F.col("act") == ALLOW).alias("allowed"), F.max(F.col("act") == BLOCK).alias("blocked"))
    spread = whole.where("blocked and not coalesce(allowed, false)").select("component")
    reached = write_table(named.join(spread, "component", "left_semi").select("node", F.lit(BLOCK).alias("alias_verdict")), "reached")
    drop_table(named)
    out = rows.join(reached, "node", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce(action(F.col("rule"), rules), "alias_verdict", F.lit(ALLOW)).alias("verdict"))
