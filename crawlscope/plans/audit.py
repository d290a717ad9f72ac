"""The audit pipelines: crawl, ux, ia, tech, api and report.

Every function returns lazy DataFrames; jobs start when a table is written. Only the loops of
the crawl plan, the sitemap walk and the site tree run earlier, level by level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope import dims
from crawlscope.functions import urls
from crawlscope.operators import (
    api, canonical, content, discovery, frontier, links, mirror, paths, report, robots, style, tech, tree,
)
from crawlscope.session import cut_lineage


def discover(
    sites: DataFrame,
    robots_files: DataFrame,
    sitemap_docs: DataFrame,
    feed_docs: DataFrame,
    pages: DataFrame | None = None,
    max_feeds: int | None = None,
) -> DataFrame:
    """Seed candidates of all sites; feed_docs(site, feed_ord, doc_url, status, body).

    With ``pages``, the first page of each site chooses the feeds and their order, and ``feed_ord`` is not needed.
    """
    rules = robots.robots_rules(robots_files)
    if pages is not None:
        feed_docs = announced_feeds(pages, feed_docs, max_feeds)
    walked = discovery.walk_sitemaps(discovery.sitemap_roots(sites, rules), sitemap_docs)
    return discovery.discover_urls(walked, discovery.feed_links(feed_docs))


def announced_feeds(pages: DataFrame, feed_docs: DataFrame, limit: int | None = None) -> DataFrame:
    """Stored feeds that the first page of each site announces, in its order: feed_docs with ``feed_ord``."""
    first = pages.groupBy(urls.netloc(F.col("url")).alias("site")).agg(F.min("page_id").alias("page_id"))
    hints = links.feed_link_hints(pages.join(first.select("page_id"), "page_id", "left_semi"), limit)
    named = hints.groupBy("site", F.col("feed_url").alias("doc_url")).agg(F.min("ord").alias("feed_ord"))
    return feed_docs.drop("feed_ord").join(named, ["site", "doc_url"])


def crawl(
    pages: DataFrame,
    roots: DataFrame,
    robots_files: DataFrame,
    discovered: DataFrame | None = None,
    failed: DataFrame | None = None,
    max_pages: int | None = None,
    max_depth: int | None = None,
) -> dict[str, DataFrame]:
    """Crawl of stored pages(page_id, url, html) from roots(site, url).

    Without ``failed`` a planned page that is not in the store counts as failed.
    """
    # The links feed four tables; they are extracted from the HTML once.
    all_links = cut_lineage(links.extract_links(pages))
    graph = links.link_graph(all_links)
    rules = robots.robots_rules(robots_files)
    if discovered is None:
        seeds = roots.select("site", "url", F.array(F.lit(-1).cast("bigint")).alias("ord"))
    else:
        seeds = discovery.merge_seeds(roots, discovered)
    stored = canonical.site_pages(pages)
    # Links count from the copy of a page that is kept, as that is the one visited.
    kept = stored.select(F.col("page_ord").alias("page_id"))
    edges = graph.join(kept, "page_id", "left_semi").select("site", "src", "dst", "link_ord")
    if failed is None:
        targets = edges.select("site", F.col("dst").alias("url")).unionByName(seeds.select("site", "url")).distinct()
        failed = targets.join(stored.select("site", "url"), ["site", "url"], "left_anti")
    plan = frontier.crawl_plan(seeds, edges, rules, failed, max_pages, max_depth)
    visited = plan.filter("status = 'ok'").join(stored, ["site", "url"])
    assets = links.extract_assets(pages.join(visited.select(F.col("page_ord").alias("page_id")), "page_id", "left_semi"))
    return {
        "plan": plan,
        "visited": visited,
        "links": all_links,
        "link_graph": graph,
        "assets": links.site_assets(assets),
        "page_assets": assets,
        "shots": paths.page_sequence(visited.withColumn("page_ord", F.col("visit_ord"))),
    }


def mirror_pages(pages: DataFrame, visited: DataFrame, crawled_at: str) -> DataFrame:
    """Markdown mirror of pages; visited(site, url, page_ord, depth, status, screenshot, screenshot_mobile)."""
    placed = paths.content_paths(visited).withColumnRenamed("page_ord", "page_id")
    # Only the HTML of pages that were asked for is read into records.
    wanted = pages.join(placed.select("page_id"), "page_id", "left_semi")
    joined = placed.join(content.page_records(wanted), "page_id")
    return mirror.content_mirror(joined.withColumn("crawled_at", F.lit(crawled_at)))


def ux_summary(obs: DataFrame) -> dict[str, DataFrame]:
    """Palette and typography of style observations."""
    return {"palette": style.palette(obs), "typography": style.typography(obs)}


def ia_summary(pages: DataFrame, visited: DataFrame, all_links: DataFrame) -> dict[str, DataFrame]:
    """Page inventory, main navigation and the navigation journey."""
    facts = content.page_meta(pages).select(
        F.col("page_id").alias("page_ord"), "title", "description", F.array_join("h1", " | ").alias("h1")
    )
    navigation = links.main_navigation(links.nav_links(all_links))
    return {
        "pages": mirror.page_inventory(visited.join(facts, "page_ord")),
        "main_navigation": navigation,
        "journeys": frontier.navigation_journey(navigation),
    }


def tech_summary(
    pages: DataFrame, log: DataFrame, lighthouse: DataFrame, timings: DataFrame | None = None, vitals: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Frameworks, resources, request totals, headers and scores; log carries a header map. With timings and vitals of
    the pages also the result of each page and its grades."""
    responses = tech.response_log(log)
    top = tech.top_resources(responses)
    by_page = {}
    if timings is not None and vitals is not None:
        results = tech.page_results(pages, responses, timings, vitals)
        graded = results.select(F.col("url").alias("site"), "dom_content_loaded", "load_complete", "lcp", "cls")
        by_page = {"page_results": results, "page_grades": tech.timing_grades(graded).withColumnRenamed("site", "url")}
    return by_page | {
        "totals": tech.request_totals(responses),
        "frameworks": tech.frameworks(tech.detect_frameworks(pages)),
        "top_resources": top,
        "third_party": tech.third_party_heavy(top),
        "third_party_hosts": tech.third_party_inventory(responses),
        "server": tech.infra_signals(tech.main_document(responses)),
        "lighthouse": tech.lighthouse_scores(lighthouse),
    }


def api_summary(log: DataFrame, structures: DataFrame) -> dict[str, DataFrame]:
    """API calls, endpoints, totals, evidence gate and payload fields."""
    calls = api.api_calls(log)
    bodies = log.filter(F.col("type").isin(*dims.API_TYPES)).select("site", "url", "body")
    return {
        "calls": calls,
        "endpoints": api.endpoints(calls),
        "totals": api.api_summary(calls),
        "gate": api.evidence_gate(calls, structures),
        "payload": api.payload_profile(bodies),
    }


def final_report(
    ux: DataFrame, ia: DataFrame, tech_rows: DataFrame, api_rows: DataFrame, navigation: DataFrame
) -> dict[str, DataFrame]:
    """Joined report, metrics, gaps, features, checklist and requests."""
    joined = report.site_report(ux, ia, tech_rows, api_rows)
    sites = joined.select("site")
    features = report.site_features(navigation, sites)
    gaps = report.known_gaps(joined)
    return {
        "report": joined,
        "metrics": report.report_metrics(joined),
        "gaps": gaps,
        "features": features,
        "checklist": report.feature_checklist(features, sites),
        "requests": report.request_list(joined),
        "confidence": report.confidence_rollup(gaps),
    }


def tree_of(pages: DataFrame, roots: DataFrame) -> DataFrame:
    """Site tree with mirror files of pages(site, url, page_ord, depth)."""
    return tree.tree_with_content(tree.site_tree(pages, roots), paths.content_paths(pages))

