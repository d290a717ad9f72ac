"""Seed discovery: sitemap walk, feeds, and their union."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlscope import dims
from crawlscope.functions import urls
from crawlscope.operators.common import first_seen, top_k
from crawlscope.session import cut_lineage, place_by

# Child elements keep their own name; the array order is the document order.
_SITEMAP_XML = "url array<struct<loc:string>>, sitemap array<struct<loc:string>>"
_FEED_XML = (
    "channel array<struct<item:array<struct<link:array<string>>>>>, item array<struct<link:array<string>>>, "
    "entry array<struct<link:array<struct<_rel:string,_href:string,_VALUE:string>>>>"
)
_XML_OPTIONS = {"mode": "PERMISSIVE", "ignoreNamespace": "true"}


def _root_tag(body: Column) -> Column:
    """Local name of the document element."""
    start = F.regexp_replace(body, r"(?s)^\s*(?:<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>|\s+)*", "")
    return F.regexp_extract(start, r"^<(?:[\w.-]+:)?([\w.-]+)", 1)


def parse_sitemaps(docs: DataFrame) -> DataFrame:
    """sitemap_docs(site, doc_url, status, body) -> site, doc_url, pages[], children[].

    Documents that fail to parse, are not 200 or lack the sitemap namespace give nothing.
    """
    usable = docs.filter(
        (F.col("status") == 200) & F.col("body").contains(dims.SITEMAP_NAMESPACE)
    ).select(
        "site", "doc_url", _root_tag(F.col("body")).alias("tag"),
        F.from_xml("body", _SITEMAP_XML, _XML_OPTIONS).alias("x"),
    )

    def locs(items: Column) -> Column:
        found = F.transform(items, lambda s: F.trim(s["loc"]))
        return F.coalesce(
            F.filter(found, lambda u: u.isNotNull() & (u != "")), F.array().cast("array<string>")
        )

    nothing = F.array().cast("array<string>")
    return usable.select(
        "site",
        "doc_url",
        F.when(F.col("tag") == "urlset", locs(F.col("x.url"))).otherwise(nothing).alias("pages"),
        F.when(F.col("tag") == "sitemapindex", locs(F.col("x.sitemap"))).otherwise(nothing).alias("children"),
    )


def sitemap_roots(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """sites(site, origin), rules(site, sitemaps) -> site, doc_url, ord: robots lines or the usual two."""
    usual = F.array(*[F.lit(p) for p in dims.DEFAULT_SITEMAPS])
    listed = sites.join(rules.select("site", "sitemaps"), "site", "left")
    named = F.when(F.coalesce(F.size("sitemaps"), F.lit(0)) > 0, F.col("sitemaps")).otherwise(usual)
    return listed.select("site", "origin", F.posexplode(named).alias("ord", "raw")).select(
        "site", urls.resolve(F.col("raw"), F.col("origin")).alias("doc_url"), F.col("ord").cast("bigint").alias("ord")
    )


def walk_sitemaps(
    roots: DataFrame,
    docs: DataFrame,
    max_depth: int | None = None,
    max_urls: int | None = None,
) -> DataFrame:
    """Breadth-first walk of sitemap indexes: site, url, depth, ord ARRAY<BIGINT>, doc_url.

    All sites advance one level per round. The place of a document is the list of positions on
    its way down, so order inside a level needs no numbering. Every document counts once, so the
    walk ends; with ``max_urls``, the first same-host addresses per site are kept. The lists of pages
    are joined once, at the end.
    """
    stored = cut_lineage(parse_sitemaps(docs))
    parsed = place_by(stored.select("site", "doc_url", "children"), "site", "doc_url")
    frontier = roots.select(
        "site", "doc_url", F.array(F.col("ord")).alias("ord"), F.lit(0).alias("depth")
    )
    levels: list[DataFrame] = []
    for depth in count():
        fresh = first_seen(frontier, ["site", "doc_url"], ["ord"])
        if levels:
            known = reduce(DataFrame.unionByName, levels).select("site", "doc_url")
            fresh = fresh.join(known, ["site", "doc_url"], "left_anti")
        # Documents not in the store were not fetched; they still count as seen.
        level = cut_lineage(fresh.join(parsed, ["site", "doc_url"], "left"))
        levels.append(level)
        frontier = level.select(
            "site", "ord", F.posexplode("children").alias("pos", "doc_url"), F.lit(depth + 1).alias("depth")
        ).select("site", "doc_url", F.concat("ord", F.array(F.col("pos").cast("bigint"))).alias("ord"), "depth")
        if depth == max_depth or frontier.isEmpty():
            break
    walked = reduce(DataFrame.unionByName, levels).drop("children").join(stored.select("site", "doc_url", "pages"), ["site", "doc_url"])
    found = walked.select(
        "site", "doc_url", "depth", "ord", F.posexplode("pages").alias("pos", "url")
    ).filter(urls.netloc(F.col("url")) == F.col("site"))
    placed = found.select(
        "site", "url", "depth", F.concat("ord", F.array(F.col("pos").cast("bigint"))).alias("ord"), "doc_url"
    )
    if max_urls is None:
        return placed
    return top_k(placed, ["site"], [F.col("depth"), F.col("ord")], max_urls, rank="_rank").drop("_rank")


def feed_links(docs: DataFrame) -> DataFrame:
    """feed_docs(site, doc_url, status, body) -> site, doc_url, pos, url of the feed entries, with any ``feed_ord``.

    RSS items give their link text. Atom entries give the first link that is plain or
    ``alternate``, otherwise the first link of all. Other hosts drop.
    """
    keep = ["site", "doc_url", *(["feed_ord"] if "feed_ord" in docs.columns else [])]
    parsed = docs.filter((F.col("status") == 200) & (F.col("body") != "")).select(
        *keep, _root_tag(F.col("body")).alias("tag"),
        F.col("body").contains(dims.ATOM_NAMESPACE).alias("atom"),
        F.from_xml("body", _FEED_XML, _XML_OPTIONS).alias("x"),
    )
    items = F.concat(
        F.coalesce(F.flatten(F.transform("x.channel", lambda c: c["item"])), F.array().cast("array<struct<link:array<string>>>")),
        F.coalesce("x.item", F.array().cast("array<struct<link:array<string>>>")),
    )
    rss = F.transform(items, lambda i: F.trim(F.try_element_at(i["link"], F.lit(1))))

    def entry_url(entry: Column) -> Column:
        links = entry["link"]
        plain = F.filter(
            links,
            lambda link: F.lower(F.coalesce(link["_rel"], F.lit(""))).isin("", "alternate")
            & (F.trim(F.coalesce(link["_href"], F.lit(""))) != ""),
        )
        chosen = F.coalesce(F.try_element_at(plain, F.lit(1)), F.try_element_at(links, F.lit(1)))
        return F.trim(chosen["_href"])

    atom = F.when(F.col("atom"), F.transform("x.entry", entry_url))
    picked = F.when(F.col("tag") == "rss", rss).otherwise(atom)
    return (
        parsed.select(*keep, F.posexplode(picked).alias("pos", "url"))
        .filter(urls.netloc(F.col("url")) == F.col("site"))
        .withColumn("pos", F.col("pos").cast("bigint"))
    )


def discover_urls(sitemap: DataFrame, feeds: DataFrame) -> DataFrame:
    """Union of both sources, sitemap first: site, url, source, ord (sortable), copies.

    sitemap is the result of ``walk_sitemaps``; feeds(site, feed_ord, pos, url). A URL that
    repeats, also inside one feed, is kept once.
    """
    both = sitemap.select(
        "site", "url", F.lit("sitemap").alias("source"),
        F.concat(F.array(F.lit(0), F.col("depth")).cast("array<bigint>"), "ord").alias("ord"),
    ).unionByName(
        feeds.select("site", "url", F.lit("rss").alias("source"),
                     F.array(F.lit(1).cast("bigint"), F.col("feed_ord"), F.col("pos")).alias("ord"))
    )
    return both.groupBy("site", "url").agg(
        F.min_by("source", "ord").alias("source"), F.min("ord").alias("ord"), F.count("*").alias("copies"),
        F.count_if(F.col("source") == "sitemap").alias("sitemap_copies"),
    )


def discovery_counts(discovered: DataFrame) -> DataFrame:
    """Counts before the dedupe by source, and of distinct URLs after it."""
    return discovered.groupBy("site").agg(
        F.sum("sitemap_copies").alias("sitemap"),
        F.sum(F.col("copies") - F.col("sitemap_copies")).alias("rss"),
        F.count("*").alias("total_unique"),
    )


def merge_seeds(roots: DataFrame, discovered: DataFrame) -> DataFrame:
    """roots(site, url) and discovered(site, url, ord) -> site, url, ord: same-site seeds at depth 0.

    The root comes first; discovered URLs follow in their order once normalised.
    """
    own = urls.is_web(F.col("url")) & (urls.netloc(F.col("url")) == F.col("site"))
    normed = discovered.filter(own).select("site", urls.normalize(F.col("url")).alias("url"), "ord")
    first = roots.select("site", "url", F.array(F.lit(-1).cast("bigint")).alias("ord"))
    return first.unionByName(normed).groupBy("site", "url").agg(F.min("ord").alias("ord"))
