"""URL block and allow rules, carried to aliases over redirect and canonical links by connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import absolute_url
from .common import LOWER, UPPER
from .components import components

RULES = T.StructType([T.StructField("action", T.StringType()), T.StructField("rule", T.StringType())])


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; null and texts without :// have an empty host."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ? # or the end; may be empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def link_edges(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst): from a page's url to the address of its canonical link and of its meta refresh, resolved against the url where they are relative. Fragments are dropped."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    low = F.lower(html)
    may = F.contains(low, F.lit("canonical")) | F.contains(low, F.lit("http-equiv"))
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))
    tagged = pages.filter(may & F.col(url_col).isNotNull()).select(F.col(url_col).alias("src"), F.explode(tags).alias("tag"))
    canonical = F.when(F.col("tag").rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b"), F.regexp_extract("tag", r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    refresh = F.when(F.col("tag").rlike(r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b"), F.regexp_extract("tag", r"(?i)\burl\s*=\s*[\"']?([^\"'\s>;]+)", 1))
    found = tagged.select("src", F.coalesce(canonical, refresh).alias("href")).filter("href <> ''")
    target = F.regexp_replace(F.replace(absolute_url(F.col("src"), F.col("href")), F.lit("&amp;"), F.lit("&")), "#.*$", "")
    return found.select("src", target.alias("dst")).filter("contains(dst, '://') and src <> dst").distinct()


def direct_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls(url) distinct -> (url, host, path, rule, action) by the longest rule that fits; ties of length: allow before block, then the rule's text.

    A rule is host/path: it fits its host and all subdomains where the path starts with the rule's. Each url meets rules by
    its host's suffixes, so the join is on equal keys whatever the number of rules.
    """
    r = rules.filter("rule is not null").select("action", "rule", F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER).alias("suffix"), F.regexp_extract("rule", r"^[^/]*(.*)$", 1).alias("prefix")).distinct()
    u = urls.select("url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    near = u.filter("host <> ''").select("url", "path", F.explode(suffixes).alias("suffix")).join(r, "suffix").filter(F.startswith("path", F.col("prefix")))
    best = near.groupBy("url").agg(F.max_by(F.struct("rule", "action"), F.struct(F.length("rule"), F.when(F.col("action") == "allow", 1).otherwise(0), "rule")).alias("b"))
    return u.join(best, "url", "left").select("url", "host", "path", F.col("b.rule").alias("rule"), F.col("b.action").alias("action"))


def judge_urls(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page row: id, host, path, rule, verdict, via.

    verdict: the own rule's action (via "rule"); else that of the page's aliases (via "alias"): allow if any alias is
    explicitly allowed, block if any is blocked; else default (via "default"). Aliases are the connected components over
    edges(src, dst); an address that is only an edge's end takes part with the rule that fits it. A null url has no rule and no
    alias. Repeated pages get a row each. Empty rules, edges or pages are fine.
    """
    edges = edges.select("src", "dst") if edges is not None else pages.sparkSession.createDataFrame([], "src string, dst string")
    addresses = pages.select(F.col(url_col).alias("url")).unionByName(edges.select(F.explode(F.array("src", "dst")).alias("url"))).filter("url is not null").distinct()
    ruled = direct_rules(addresses, rules)
    groups = components(edges)
    spread = groups.join(ruled.filter("action is not null").select(F.col("url").alias("node"), "action"), "node").groupBy("component").agg(F.max(F.when(F.col("action") == "allow", 2).otherwise(1)).alias("strongest"))
    alias = groups.join(spread, "component").select(F.col("node").alias("url"), F.when(F.col("strongest") == 2, "allow").otherwise("block").alias("alias_action"))
    known = ruled.join(alias, "url", "left")
    out = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("url")).join(known, "url", "left")
    return out.select(
        F.col("_id").alias(id_col), F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule",
        F.coalesce("action", "alias_action", F.lit(default)).alias("verdict"),
        F.when(F.col("action").isNotNull(), "rule").when(F.col("alias_action").isNotNull(), "alias").otherwise("default").alias("via"),
    )
