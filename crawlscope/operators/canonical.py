"""Canonical URLs and duplicate groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope.functions import urls
from crawlscope.operators.common import HOT_GROUP, attach_group, first_seen, top_k


def canonicalize_urls(pages: DataFrame, hot: int = HOT_GROUP) -> DataFrame:
    """pages(page_id, url) -> page_id, url, norm_url, group_size, is_first.

    ``is_first`` marks the first page seen of each canonical URL. Pages without a web URL drop.
    """
    web = pages.filter(urls.is_web(F.col("url")))
    rows = web.select("page_id", "url", urls.normalize(F.col("url")).alias("norm_url"))
    groups = rows.groupBy("norm_url").agg(
        F.count("*").alias("group_size"), F.min("page_id").alias("first_id")
    )
    return attach_group(rows, groups, ["norm_url"], "group_size", ["page_id"], hot=hot).select(
        "page_id", "url", "norm_url", "group_size", (F.col("page_id") == F.col("first_id")).alias("is_first")
    )


def site_pages(pages: DataFrame, raw: bool = False) -> DataFrame:
    """One row per canonical URL: site, url, page_ord (the first page_id), and with ``raw`` that page's own url.

    This is the page list every tree, mirror and crawl job works on. Without the own url it is a plain
    hash aggregation.
    """
    norm = urls.normalize(F.col("url"))
    web = pages.filter(urls.is_web(F.col("url")))
    rows = web.select(norm.alias("url"), F.col("page_id").alias("page_ord"), F.col("url").alias("raw_url"))
    kept = [F.min("page_ord").alias("page_ord")] + [F.min_by("raw_url", "page_ord").alias("raw_url")] * raw
    names = ["url", "page_ord"] + ["raw_url"] * raw
    return rows.groupBy("url").agg(*kept).select(urls.netloc(F.col("url")).alias("site"), *names)


def crawl_urls(crawled: DataFrame, fallback: DataFrame) -> DataFrame:
    """URLs of an earlier crawl in first-seen order; sites without any get their fallback URL.

    crawled(site, url, ord), fallback(site, url) -> site, url, ord (0 for a fallback).
    """
    listed = crawled.filter(F.coalesce(F.col("url"), F.lit("")) != "")
    distinct = first_seen(listed.select("site", "url", "ord"), ["site", "url"], ["ord"])
    missing = fallback.join(distinct.select("site").distinct(), "site", "left_anti")
    return distinct.unionByName(missing.select("site", "url", F.lit(0).cast("bigint").alias("ord")))


def scan_targets(crawled: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Pages of a crawl that the tech and API scans look at, all or the first ones: site, url, rank."""
    ranked = top_k(crawled.select("site", "url", "ord"), ["site"], [F.col("ord")], max_pages)
    return ranked.select("site", "url", F.col("rank").cast("bigint").alias("rank"))
