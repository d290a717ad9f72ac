"""Links, navigation, assets and the link graph out of stored HTML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope import dims
from crawlscope.functions import html as H
from crawlscope.functions import urls
from crawlscope.functions.arrays import distinct_by
from crawlscope.operators.common import place, top_k
from crawlscope.operators.dom import parse_links

# Any element can take the navigation role, which only the parser pass can follow.
MANY_ANCHORS = 300
_NAV_ROLE = r"(?i)\srole\s*=\s*[\"']?navigation"


def extract_links(pages: DataFrame, scopes: Sequence[str] = ("page", "nav")) -> DataFrame:
    """pages(page_id, url, html) -> site, page_id, page_url, scope, link_ord, href, text, parent, in_nav.

    Scope ``page`` holds the first link per page and address, scope ``nav`` the first navigation
    link per page and address. ``href`` is absolute as in a browser, ``parent`` the closest
    container. A page is one row, so its links are deduped there and never shuffled. Ask only
    for the scopes that are used.
    """
    # The fold over the anchors of a page copies what it has found; pages with many take the parser pass too.
    hard = F.col("html").rlike(_NAV_ROLE) | (F.regexp_count("html", F.lit("(?i)<a\\s")) > MANY_ANCHORS)
    native = pages.filter(~hard).select("page_id", "url", H.anchors(F.col("html")).alias("links"))
    found = native.unionByName(parse_links(pages.filter(hard)))
    absolute = F.transform(
        "links",
        lambda a, i: F.struct(
            i.cast("bigint").alias("link_ord"),
            urls.dom_href(a["href"], F.col("url")).alias("href"),
            a["text"].alias("text"),
            a["parent"].alias("parent"),
            a["in_nav"].alias("in_nav"),
        ),
    )
    listed = found.select("page_id", "url", F.filter(absolute, lambda a: a["href"] != "").alias("links"))

    def scoped(scope: str, items):
        first = distinct_by(items, lambda a: a["href"])
        return F.transform(first, lambda a: F.struct(F.lit(scope).alias("scope"), a.alias("a")))

    sources = {"page": F.col("links"), "nav": F.filter("links", lambda a: a["in_nav"])}
    rows = F.concat(*[scoped(scope, sources[scope]) for scope in scopes])
    return listed.select("page_id", "url", F.explode(rows).alias("l")).select(
        urls.netloc(F.col("url")).alias("site"), "page_id", F.col("url").alias("page_url"), "l.scope", "l.a.*"
    )


def page_links(links: DataFrame) -> DataFrame:
    """First link per page and absolute address."""
    return links.filter("scope = 'page'").drop("scope")


def nav_links(links: DataFrame) -> DataFrame:
    """First navigation link per page and absolute address."""
    return links.filter("scope = 'nav'").drop("scope", "in_nav", "parent")


def same_site(links: DataFrame) -> DataFrame:
    """Links that stay on the origin of their page."""
    return page_links(links).filter(urls.same_origin(F.col("href"), F.col("page_url")))


def link_graph(links: DataFrame) -> DataFrame:
    """Edges site, src, dst, parent, page_id, link_ord between canonical URLs.

    Targets on other sites stay; a target may repeat when two addresses share its canonical form.
    """
    web = page_links(links).filter(urls.is_web(F.col("href")))
    return web.select(
        "site",
        urls.normalize(F.col("page_url")).alias("src"),
        urls.normalize(F.col("href")).alias("dst"),
        "parent",
        "page_id",
        "link_ord",
    )


def main_navigation(nav: DataFrame, k: int = dims.TOP_NAV) -> DataFrame:
    """Top ``k`` navigation items per site by the number of pages that link them.

    nav(site, page_id, link_ord, text, href) -> site, rank, text, href, pages, first_page.
    """
    usable = nav.withColumn("text", F.trim("text")).filter("text <> '' AND href <> ''")
    counts = usable.groupBy("site", "text", "href").agg(
        F.count("*").alias("pages"),
        F.min("page_id").alias("first_page"),
        F.min(place(F.col("page_id"), F.col("link_ord"), 2**31)).alias("first"),
    )
    order = [F.desc("pages"), F.col("first"), F.col("href")]
    return top_k(counts, ["site"], order, k).select(
        "site", F.col("rank").cast("bigint").alias("rank"), "text", "href", "pages",
        "first_page",
    )


def extract_assets(pages: DataFrame) -> DataFrame:
    """Script and stylesheet addresses, distinct per page: site, page_id, kind, ord, src."""
    seen = F.regexp_replace("html", r"(?s)<!--.*?-->", "")

    def found(kind: str, tag: str, attr: str, condition):
        hits = F.filter(H.tags(F.col("seen"), tag), condition)
        absolute = F.transform(hits, lambda t: urls.dom_href(H.attribute(t, attr), F.col("url")))
        return F.transform(
            F.array_distinct(absolute),
            lambda src, i: F.struct(F.lit(kind).alias("kind"), i.cast("bigint").alias("ord"), src.alias("src")),
        )

    both = F.concat(
        found("script", "script", "src", lambda t: H.attribute(t, "src") != ""),
        found("style", "link", "href", H.attr_equals("rel", "stylesheet")),
    )
    return (
        pages.select("page_id", "url", seen.alias("seen"))
        .select(urls.netloc(F.col("url")).alias("site"), "page_id", F.explode(both).alias("a"))
        .select("site", "page_id", "a.*")
    )


def site_assets(assets: DataFrame) -> DataFrame:
    """Distinct assets per site with the place they were first seen."""
    return assets.groupBy("site", "kind", "src").agg(
        F.min("page_id").alias("first_page"), F.count("*").alias("pages")
    )


def feed_link_hints(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Feed addresses a page announces, or the usual ones: site, page_id, ord, feed_url.

    With a ``limit``, the first ones count before the same-host filter.
    """
    seen = F.regexp_replace("html", r"(?s)<!--.*?-->", "")
    hits = F.filter(
        H.tags(seen, "link"),
        lambda t: t.rlike(r"(?i)\shref\s*=")
        & (
            F.lower(H.attribute(t, "type")).rlike("rss|atom")
            | F.lower(H.attribute(t, "rel")).contains("feed")
        ),
    )
    announced = F.transform(hits, lambda t: H.attribute(t, "href"))
    usual = F.array(*[F.lit(p) for p in dims.DEFAULT_FEEDS])
    picked = F.when(F.size(announced) == 0, usual).otherwise(announced)
    picked = F.slice(picked, 1, limit) if limit else picked
    return (
        pages.select("page_id", "url", F.posexplode(picked).alias("ord", "raw"))
        .select(
            urls.netloc(F.col("url")).alias("site"),
            "page_id",
            F.col("ord").cast("bigint").alias("ord"),
            urls.resolve(F.col("raw"), urls.origin(F.col("url"))).alias("feed_url"),
        )
        .filter(urls.netloc(F.col("feed_url")) == F.col("site"))
    )
