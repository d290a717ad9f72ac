
from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from crawlscope import dims  # noqa: E402
from crawlscope.functions import text as X  # noqa: E402
from crawlscope.functions import urls  # noqa: E402
from crawlscope.operators import (  # noqa: E402
    api, canonical, content, discovery, frontier, links, mirror, paths, report, robots, status, style, tech, tree,
)
from crawlscope.operators.common import first_seen  # noqa: E402
from crawlscope.plans import audit  # noqa: E402
from crawlscope.session import cut_lineage, shared_dir  # noqa: E402
from crawlscope.sources import adapters as A  # noqa: E402
from crawlscope.sources import readers, writers  # noqa: E402
from crawlscope.streaming import incremental, keyed  # noqa: E402
from oracles import ORACLES  # noqa: E402

try:
    import corpus_pipeline  # noqa: E402
    from crawlscope.llm.queries import ORACLES as LLM_ORACLES  # noqa: E402
    from crawlscope.llm.queries import QUERIES as LLM_QUERIES  # noqa: E402
except ModuleNotFoundError as error:
    # The training-data operators are an optional part; anything else that is missing is an error.
    if not (error.name or "").startswith(("crawlscope.llm", "corpus_pipeline")):
        raise
    LLM_QUERIES, LLM_ORACLES = {}, {}
else:
    LLM_QUERIES = LLM_QUERIES | {"pipeline": corpus_pipeline.run}

SMOKE_DIR = "/root/testdata/sf0.001"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "pages")


def _host() -> F.Column:
    return urls.netloc(F.col("url"))


# --- URLs and text -----------------------------------------------------------------------
@query
def j0_canonicalize_urls(spark, d):
    return canonical.canonicalize_urls(_pages(spark, d))


@query
def p1_p2_resolve_and_normalize(spark, d):
    """Link targets of each page: resolved as given, as in a browser, and normalised."""
    found = links.page_links(links.extract_links(A.rich_pages(spark, d), ["page"]))
    return found.select(
        "page_id", "link_ord", "href", urls.normalize(F.col("href")).alias("norm"),
        urls.normalize(F.concat(F.lit("../x/./"), F.col("page_id").cast("string"), F.lit("/?b=1&gclid=9&a=2")), F.col("page_url")).alias("relative"),
    )


@query
def p3_f1_same_site_links(spark, d):
    same = links.same_site(links.extract_links(A.rich_pages(spark, d), ["page"]))
    return same.groupBy("site").agg(F.count("*").alias("links"), F.count_distinct("href").alias("targets"))


@query
def p4_slugs(spark, d):
    return _pages(spark, d).select("page_id", urls.slug(F.col("url")).alias("slug"))


@query
def w5_page_sequence(spark, d):
    return paths.page_sequence(canonical.site_pages(_pages(spark, d))).select(
        "site", "url", "page_no", "screenshot", "screenshot_mobile"
    )


@query
def p5_j5_content_paths(spark, d):
    return paths.content_paths(canonical.site_pages(_pages(spark, d))).select("site", "url", "content_path", "is_collision")


@query
def t1_p6_mask_text(spark, d):
    return content.mask_texts(A.table(spark, d, "documents"), ["doc_id"])


@query
def p10_preview(spark, d):
    return A.table(spark, d, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"))


@query
def t2_p9_document_stats(spark, d):
    return content.content_stats(A.table(spark, d, "documents"), ["doc_id"])


@query
def t2_conversation_stats(spark, d):
    return content.content_stats(A.table(spark, d, "conversations"), ["conv_id", "turn"])


@query
def p8_hex_colors(spark, d):
    return A.style_obs(spark, d).groupBy(X.rgb_to_hex(F.col("value")).alias("hex")).agg(F.sum("cnt").alias("cnt"))


@query
def w1_first_seen_links(spark, d):
    """First page of each site that links an address."""
    found = links.page_links(links.extract_links(_pages(spark, d), ["page"])).select("site", "href", "page_id", "link_ord")
    return first_seen(found, ["site", "href"], ["page_id", "link_ord"])


@query
def src1_read_snapshots(spark, d):
    return readers.parse_snapshots(A.snapshot_lines(spark, d)).select("site", "page_ord", "url", "title")


@query
def src2_crawl_urls(spark, d):
    """All pages and as many blank addresses; a site that is not in the list gets its fallback address."""
    rows = _pages(spark, d).selectExpr(f"{A.HOST} AS site", "explode(array(url, '')) AS url", "page_id AS ord")
    fallback = A.sites(spark, d).select(F.explode(F.array("site", F.concat(F.lit("new."), "site"))).alias("site"), F.col("origin").alias("url"))
    return canonical.crawl_urls(rows, fallback)


@query
def l3_scan_targets(spark, d):
    pages = canonical.site_pages(_pages(spark, d)).select("site", "url", F.col("page_ord").alias("ord"))
    return canonical.scan_targets(pages, max_pages=6)


# --- HTML --------------------------------------------------------------------------------
@query
def h1_page_meta(spark, d):
    return content.page_meta(A.rich_pages(spark, d)).select(
        "page_id", "title", "lang", "description", "canonical",
        F.array_join("h1", "|").alias("h1"), F.array_join("h2", "|").alias("h2"),
    )


@query
def h2_links(spark, d):
    return links.page_links(links.extract_links(_pages(spark, d), ["page"])).select("site", "page_id", "link_ord", "href", "text", "parent")


@query
def h2_links_rich(spark, d):
    return links.extract_links(A.rich_pages(spark, d)).select(
        "page_id", "scope", "link_ord", "href", "text", "parent", "in_nav"
    )


@query
def h3_nav_links(spark, d):
    return links.nav_links(links.extract_links(_pages(spark, d), ["nav"])).select("site", "page_id", "link_ord", "href", "text")


@query
def h4_assets(spark, d):
    return links.extract_assets(A.rich_pages(spark, d))


@query
def u3_site_assets(spark, d):
    return links.site_assets(links.extract_assets(A.rich_pages(spark, d)))


@query
def h5_form_fields(spark, d):
    return content.form_fields(content.extract_forms(A.rich_pages(spark, d)))


@query
def a16_field_inventory(spark, d):
    return content.field_inventory(content.form_fields(content.extract_forms(A.rich_pages(spark, d))))


@query
def h6_images(spark, d):
    return content.extract_images(A.rich_pages(spark, d))


@query
def h7_content(spark, d):
    return content.extract_content(_pages(spark, d)).select("page_id", "site", "body_text", "word_count")


@query
def h7_sections(spark, d):
    rows = content.extract_content(A.rich_pages(spark, d)).select(
        "page_id", "word_count", F.posexplode("sections").alias("ord", "s")
    )
    return rows.select(
        "page_id", "word_count", F.col("ord").cast("bigint").alias("ord"), "s.id", "s.heading", "s.text",
        F.size("s.images").cast("bigint").alias("images"),
    )


@query
def h8_structured(spark, d):
    og = F.map_entries("og")
    return content.extract_structured(A.rich_pages(spark, d)).select(
        "page_id", F.size("json_ld").cast("bigint").alias("blocks"),
        F.array_join(F.array_sort(F.transform(og, lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|").alias("og"),
    )


@query
def p11_structured_types(spark, d):
    return content.page_types(content.extract_structured(A.rich_pages(spark, d)))


@query
def h9_declared_styles(spark, d):
    seen = style.count_styles(style.declared_styles(A.rich_pages(spark, d)))
    return seen.groupBy("site", "kind", "value", "family", "size", "weight", "tag").agg(F.sum("cnt").alias("cnt"))


@query
def h9_a1_declared_palette(spark, d):
    return style.palette(style.count_styles(style.declared_styles(A.rich_pages(spark, d))).filter("kind = 'color'"), per_page=dims.PAGE_COLORS)


@query
def h9_computed_colors(spark, d):
    """Colours that the elements of each page end up with, by the cascade of its sheets."""
    seen = style.computed_styles(A.styled_pages(spark, d)).filter("kind = 'color'")
    return seen.select("site", "page_id", "value", "cnt")


@query
def h9_a1_computed_palette(spark, d):
    seen = style.computed_styles(A.styled_pages(spark, d)).filter("kind = 'color'")
    return style.palette(seen, per_page=dims.PAGE_COLORS)


@query
def h10_feed_hints(spark, d):
    return links.feed_link_hints(A.rich_pages(spark, d), limit=dims.MAX_FEEDS)


@query
def a12_seo_audit(spark, d):
    return content.seo_audit(A.rich_pages(spark, d))


@query
def a12_seo_rollup(spark, d):
    return content.seo_rollup(content.seo_audit(_pages(spark, d)))


@query
def a13_markup_checks(spark, d):
    return content.markup_checks(A.rich_pages(spark, d))


@query
def a13_markup_rollup(spark, d):
    return content.markup_rollup(content.markup_checks(_pages(spark, d)))


# --- navigation, graph, tree ----------------------------------------------------------------
@query
def a3_main_navigation(spark, d):
    return links.main_navigation(links.nav_links(links.extract_links(_pages(spark, d), ["nav"])))


@query
def g0_link_graph(spark, d):
    return links.link_graph(links.extract_links(_pages(spark, d), ["page"]))


@query
def g4_navigation_journey(spark, d):
    return frontier.navigation_journey(a3_main_navigation(spark, d))


def _depth_pages(spark, d):
    """Canonical pages with the number of path segments as depth."""
    rows = canonical.site_pages(_pages(spark, d))
    segments = F.when(urls.inner_path(F.col("url")) == "", 0).otherwise(F.size(F.split(urls.inner_path(F.col("url")), "/")))
    return rows.withColumn("depth", segments.cast("bigint"))


def _language_tree(spark, d):
    """The pages plus one page per language folder, so that the tree has two levels."""
    rows = _depth_pages(spark, d).drop("raw_url")
    folders = rows.select("site", F.regexp_extract("url", "^([a-z]+://[^/]+/[a-z]+)/", 1).alias("url"), "page_ord").groupBy(
        "site", "url"
    ).agg(F.min("page_ord").alias("page_ord"))
    pages = rows.unionByName(folders.withColumn("depth", F.lit(1).cast("bigint")))
    # Every second site by name length has its root at the first language folder.
    roots = folders.groupBy("site").agg(F.min("url").alias("first")).select(
        "site",
        F.when(F.length("site") % 2 == 0, F.concat(urls.origin(F.col("first")), F.lit("/"))).otherwise(F.col("first")).alias("root_url"),
    )
    return pages, roots


@query
def j4_site_parents(spark, d):
    pages, roots = _language_tree(spark, d)
    return tree.site_parents(pages, roots).select("site", "url", "path", "root_url", "parent_url")


@query
def g3_j6_site_tree(spark, d):
    pages, roots = _language_tree(spark, d)
    return audit.tree_of(pages, roots).select("site", "url", "parent_url", "child_ord", "in_tree", "content_path")


@query
def w6_page_inventory(spark, d):
    facts = content.page_meta(_pages(spark, d)).select(
        F.col("page_id").alias("page_ord"), "title", "description", F.array_join("h1", "|").alias("h1")
    )
    return mirror.page_inventory(_depth_pages(spark, d).join(facts, "page_ord"))


# --- robots, discovery, crawl plan --------------------------------------------------------
@query
def src5_w3_robots_rules(spark, d):
    return robots.rule_rows(robots.robots_rules(A.robots(spark, d)))


@query
def f2_j1_robots_filter(spark, d):
    marked = robots.mark_blocked(canonical.site_pages(_pages(spark, d)), robots.robots_rules(A.robots(spark, d)))
    return marked.select("site", "url", "blocked")


@query
def j1_robots_blocked(spark, d):
    pages = canonical.site_pages(_pages(spark, d)).select("site", "url")
    return frontier.robots_split(pages, robots.robots_rules(A.robots(spark, d)))[1]


@query
def u4_sitemap_roots(spark, d):
    return discovery.sitemap_roots(A.sites(spark, d), robots.robots_rules(A.robots(spark, d)))


def _walked(spark, d):
    roots = discovery.sitemap_roots(A.sites(spark, d), robots.robots_rules(A.robots(spark, d)))
    return discovery.walk_sitemaps(roots, A.sitemap_docs(spark, d), dims.MAX_SITEMAP_DEPTH, dims.MAX_SITEMAP_URLS)


@query
def src3_g2_sitemap_walk(spark, d):
    return _walked(spark, d).select("site", "url", F.col("depth").cast("bigint").alias("depth"), F.array_join("ord", ".").alias("place"))


@query
def src3_walk_unbounded(spark, d):
    """The sitemap walk without limits of depth and addresses."""
    roots = discovery.sitemap_roots(A.sites(spark, d), robots.robots_rules(A.robots(spark, d)))
    walked = discovery.walk_sitemaps(roots, A.sitemap_docs(spark, d))
    return walked.select("site", "url", F.col("depth").cast("bigint").alias("depth"), F.array_join("ord", ".").alias("place"))


@query
def src4_feed_links(spark, d):
    return discovery.feed_links(A.feed_docs(spark, d)).drop("feed_ord")


def _discovered(spark, d):
    return audit.discover(A.sites(spark, d), A.robots(spark, d), A.sitemap_docs(spark, d), A.feed_docs(spark, d))


@query
def u1_discover_urls(spark, d):
    return _discovered(spark, d).select("site", "url", "source", "copies")


@query
def a6_discovery_counts(spark, d):
    return discovery.discovery_counts(_discovered(spark, d))


def _roots(spark, d):
    return A.crawled_pages(spark, d).filter("rn = 1").select("site", "url")


@query
def u2_j2_merge_seeds(spark, d):
    return discovery.merge_seeds(_roots(spark, d), _discovered(spark, d)).select(
        "site", "url", (F.element_at("ord", 1) == -1).alias("is_root")
    )


def _plan(spark, d, max_pages, max_depth):
    pages = cut_lineage(A.crawled_pages(spark, d))
    roots = pages.filter("rn = 1").select("site", "url", F.array(F.lit(-1).cast("bigint")).alias("ord"))
    # Pages with a file ending stand for the ones that could not be fetched.
    failed = pages.filter("url LIKE '%.html'").select("site", "url")
    return frontier.crawl_plan(
        roots, A.heap_edges(pages), robots.robots_rules(A.robots(spark, d)), failed, max_pages, max_depth
    )


@query
def g1_crawl_plan(spark, d):
    return _plan(spark, d, 8, 5)


@query
def g1_crawl_plan_unbounded(spark, d):
    """Every page that links reach, without limits of pages and depth."""
    return _plan(spark, d, None, None)


@query
def g1_plan_summary(spark, d):
    return frontier.plan_summary(_plan(spark, d, 12, 3), 12)


@query
def g4_journey_steps(spark, d):
    return frontier.journey_steps(_plan(spark, d, 50, 5), {"french": "^/fr/", "german": "^/de/", "spanish": "^/es/"})


@query
def g4_journey_paths(spark, d):
    """Shortest click paths on the whole plan; what the first page links stands for the navigation."""
    pages = cut_lineage(A.crawled_pages(spark, d))
    plan, edges = _plan(spark, d, None, None), cut_lineage(A.heap_edges(pages))
    home = pages.filter("rn = 1").select("site", F.col("url").alias("src"))
    navigation = edges.join(home, ["site", "src"]).select("site", F.col("dst").alias("url"))
    found = frontier.journey_paths(plan, edges, {"french": "^/fr/", "german": "^/de/", "spanish": "^/es/", "late": "[5-9]$"}, navigation)
    return found.withColumn("path", F.array_join("path", " "))


# --- style ---------------------------------------------------------------------------------
@query
def a1_palette(spark, d):
    return style.palette(A.style_obs(spark, d), per_page=dims.PAGE_COLORS)


@query
def a1_palette_uncut(spark, d):
    """All colours of each site, summed over all colours of its pages."""
    return style.palette(A.style_obs(spark, d), k=None)


@query
def a2_typography(spark, d):
    return style.typography(A.style_obs(spark, d), per_page=dims.PAGE_FONTS)


@query
def l5_page_colors(spark, d):
    return style.page_colors(A.style_obs(spark, d), dims.PAGE_COLORS).select("site", "page_id", "value", "cnt", F.col("page_rank").cast("bigint").alias("page_rank"))


@query
def a5_component_counts(spark, d):
    pages = A.rich_pages(spark, d)
    shots = paths.page_sequence(canonical.site_pages(_pages(spark, d)))
    return style.component_counts(pages, links.extract_links(pages, ["nav"]), shots)


# --- tech ----------------------------------------------------------------------------------
@query
def src7_response_log(spark, d):
    log = tech.response_log(A.header_log(spark, d))
    return log.select("site", "seq", "url", "size", F.array_join(F.array_sort(F.map_keys("headers")), ",").alias("kept"))


@query
def j8_fingerprint_match(spark, d):
    return tech.detect_frameworks(A.rich_pages(spark, d))


@query
def a8_frameworks(spark, d):
    return tech.frameworks(tech.detect_frameworks(A.rich_pages(spark, d)))


@query
def a8_page_results(spark, d):
    """Status, frameworks, times and vitals of each page."""
    timings = A.select(_pages(spark, d), A.PAGE_TIMES)
    return tech.page_results(A.rich_pages(spark, d), A.page_log(spark, d, A.PAGE_LOG), timings, A.page_log(spark, d, A.PAGE_VITALS))


@query
def l1_top_resources(spark, d):
    return tech.top_resources(A.fetch_log(spark, d))


@query
def f5_third_party_heavy(spark, d):
    return tech.third_party_heavy(tech.top_resources(A.fetch_log(spark, d)))


@query
def a17_third_party_inventory(spark, d):
    # The hosts of the derived log have no telling names; the query names their purposes.
    return tech.third_party_inventory(A.fetch_log(spark, d), [("Analytics", "^cdn0$"), ("Fonts", "^cdn1$"), *dims.HOST_PURPOSES])


@query
def w4_main_document(spark, d):
    return tech.main_document(A.fetch_log(spark, d)).select("site", "seq", "url", "status", "size")


@query
def p7_a18_infra_signals(spark, d):
    return tech.infra_signals(tech.main_document(tech.response_log(A.header_log(spark, d))))


@query
def a9_web_vitals(spark, d):
    return tech.web_vitals(A.vitals(spark, d))


@query
def a10_timing_grades(spark, d):
    return tech.timing_grades(A.timings(spark, d)).groupBy("metric", "grade").agg(F.count("*").alias("visits"), F.max("value").alias("worst"))


@query
def a10_timing_rollup(spark, d):
    visits = A.select(A.table(spark, d, "events"), {**A.TIMINGS, "site": A.FETCH_LOG["site"]})
    return tech.timing_rollup(visits, "lcp")


@query
def src8_lighthouse_scores(spark, d):
    return tech.lighthouse_scores(A.lighthouse(spark, d))


@query
def w7_politeness(spark, d):
    return tech.politeness(A.fetch_log(spark, d), min_gap_ms=600_000)


@query
def w8_attempt_groups(spark, d):
    return tech.attempt_groups(A.attempts(spark, d))


# --- api -----------------------------------------------------------------------------------
@query
def f3_f4_api_calls(spark, d):
    return api.api_calls(A.fetch_log(spark, d))


@query
def a7_endpoints(spark, d):
    return api.endpoints(api.api_calls(A.fetch_log(spark, d)))


@query
def a7_api_summary(spark, d):
    return api.api_summary(api.api_calls(A.fetch_log(spark, d)))


def _structures(spark, d):
    """Kinds of response structure: call type and content type."""
    log = A.fetch_log(spark, d).filter("type IN ('fetch', 'xhr')")
    return log.select("site", F.concat("type", "content_type").alias("kind"))


def _gate(spark, d):
    return api.evidence_gate(api.api_calls(A.fetch_log(spark, d)), _structures(spark, d))


@query
def a11_evidence_gate(spark, d):
    return _gate(spark, d)


@query
def a10_raw_quantiles(spark, d):
    return tech.timing_rollup(A.table(spark, d, "events").selectExpr(f"{A.FETCH_LOG['site']} AS site", "value"), "value")


@query
def a4_distinct_sketches(spark, d):
    """Distinct URLs and calls per site from united daily sketches, next to the exact counts."""
    log = A.fetch_log(spark, d)
    seen = log.select("site", F.to_date("ts").alias("day"), F.explode(F.array(
        F.struct(F.lit("url").alias("kind"), F.col("url").alias("value")), F.struct(F.lit("call").alias("kind"), F.col("seq").cast("string").alias("value"))
    )).alias("v")).select("site", "day", "v.*")
    exact = seen.distinct().groupBy("site", "kind", "value").agg(F.count("*")).groupBy("site", "kind").agg(F.count("*").alias("exact"))
    both = exact.join(mirror.united_counts(mirror.daily_sketches(seen)), ["site", "kind"])
    return both.select("site", "kind", "exact", (F.abs(F.col("distinct") - F.col("exact")) <= 0.02 * F.col("exact")).alias("within_two_percent"))


@query
def a15_payload_profile(spark, d):
    bodies = A.fetch_log(spark, d).selectExpr("site", "url", "body")
    return api.payload_profile(bodies)


@query
def a15_payload_fields(spark, d):
    """Fields at every depth of bodies whose shape changes from event to event."""
    return api.payload_fields(A.nested_log(spark, d).select("site", "url", "body"))


@query
def a15_payload_schema(spark, d):
    return api.payload_schema(A.fetch_log(spark, d).select("site", "url", "body"))


@query
def snk1_write_derived(spark, d):
    """Main navigation written as a derived table and read back."""
    rows = a3_main_navigation(spark, d)
    out = f"{shared_dir(spark)}/derived-{uuid.uuid4().hex}"
    writers.write_derived(rows, out)
    return spark.read.parquet(out).select(*rows.columns)


# --- mirror and export -----------------------------------------------------------------------
def _visited(spark, d):
    """The page list of the crawl; the given pages have neither depth nor status and count as read roots."""
    return paths.page_sequence(canonical.site_pages(_pages(spark, d))).withColumn("depth", F.lit(0)).withColumn(
        "status", F.lit(200)
    )


@query
def snk2_p12_content_mirror(spark, d):
    return audit.mirror_pages(A.rich_pages(spark, d), _visited(spark, d), "2024-01-01T00:00:00")


def _flat_export(pages, listed):
    found = cut_lineage(links.extract_links(pages))
    obs = style.count_styles(style.declared_styles(pages)).filter("kind = 'color'")
    colors = style.palette(obs, k=dims.EXPORT_COLORS)
    out = mirror.flat_export(
        listed, links.nav_links(found), links.site_assets(links.extract_assets(pages)), colors, links.link_graph(found)
    )
    return out.select("site", "part", F.array_join("ord", ".").alias("place"), "value")


@query
def snk3_flat_export(spark, d):
    pages = A.rich_pages(spark, d)
    return _flat_export(pages, content.page_meta(pages).select("site", F.col("page_id").alias("page_ord"), "url", "title"))


@query
def snk3_flat_export_whole(spark, d):
    """The flat export with all six fields of each page of the crawl."""
    pages = A.rich_pages(spark, d)
    titles = content.page_meta(pages).select(F.col("page_id").alias("page_ord"), "title")
    return _flat_export(pages, _visited(spark, d).join(titles, "page_ord"))


@query
def snk3_home_heads(spark, d):
    return mirror.home_heads(_pages(spark, d))


@query
def a4_crawl_summary(spark, d):
    plan = _plan(spark, d, 12, 3)
    pages = A.rich_pages(spark, d)
    assets = links.extract_assets(pages)
    found = canonical.site_pages(_pages(spark, d), raw=True)
    made = found.select("site", "url", (~F.col("raw_url").endswith("#top")).alias("ok"))
    return mirror.crawl_summary(plan, assets, found, made)


# --- status and report -------------------------------------------------------------------------
def _flat_status(rows: DataFrame) -> DataFrame:
    return rows.select(
        "site", "stage", "status", F.date_format("completed_at", "yyyy-MM-dd").alias("completed_at"), "notes",
        F.array_join("artifacts", ",").alias("artifacts"),
    )


@query
def s1_stage_status(spark, d):
    return _flat_status(status.stage_status(A.stage_log(spark, d)))


@query
def s2_downstream_reset(spark, d):
    return _flat_status(status.status_after_reset(A.stage_log(spark, d)))


@query
def s3_gate_check(spark, d):
    return status.gate_check(status.stage_status(A.stage_log(spark, d)))


def _summaries(spark, d):
    obs = A.style_obs(spark, d)
    ux = obs.groupBy("site").agg(F.count_distinct("page_id").alias("page_count"))
    nav = a3_main_navigation(spark, d)
    pages = canonical.site_pages(_pages(spark, d)).groupBy("site").agg(F.count("*").alias("page_count"))
    ia = pages.join(nav.groupBy("site").agg(F.count("*").alias("nav_items")), "site", "left")
    stack = tech.frameworks(tech.detect_frameworks(A.rich_pages(spark, d))).groupBy("site").agg(F.count("*").alias("frameworks"))
    calls = api.api_summary(api.api_calls(A.fetch_log(spark, d)))
    return ux, ia, stack, calls


def _report(spark, d):
    return report.site_report(*_summaries(spark, d))


@query
def j7_site_report(spark, d):
    return _report(spark, d)


@query
def r1_report_metrics(spark, d):
    return report.report_metrics(_report(spark, d))


@query
def a14_known_gaps(spark, d):
    return report.known_gaps(_report(spark, d))


def _feature_rows(spark, d):
    """Navigation texts plus a name out of the host, so that some keywords occur."""
    nav = a3_main_navigation(spark, d).select("site", "text")
    named = A.sites(spark, d).selectExpr(
        "site",
        "CASE length(site) % 5 WHEN 0 THEN 'Contact us' WHEN 1 THEN 'About our Services' WHEN 2 THEN 'SHOP / Product' ELSE 'news' END AS text",
    )
    return report.site_features(nav.unionByName(named), A.sites(spark, d))


@query
def j9_site_features(spark, d):
    return _feature_rows(spark, d)


@query
def r3_feature_checklist(spark, d):
    return report.feature_checklist(_feature_rows(spark, d), A.sites(spark, d))


@query
def l2_r2_report_sections(spark, d):
    obs = A.style_obs(spark, d)
    pages = A.rich_pages(spark, d)
    ends = api.endpoints(api.api_calls(A.fetch_log(spark, d)))
    stack = tech.frameworks(tech.detect_frameworks(pages))
    nav = a3_main_navigation(spark, d)
    sites = obs.select("site").union(A.sites(spark, d).select("site")).union(ends.select("site")).distinct()
    return report.report_sections(
        style.palette(obs, per_page=dims.PAGE_COLORS), style.typography(obs, per_page=dims.PAGE_FONTS), nav, stack, ends, sites)


@query
def r4_request_list(spark, d):
    return audit.final_report(*_summaries(spark, d), a3_main_navigation(spark, d))["requests"]


@query
def r5_confidence_rollup(spark, d):
    gaps = report.known_gaps(_report(spark, d)).select("site", "state")
    found = tech.detect_frameworks(A.rich_pages(spark, d)).select("site", F.col("confidence").alias("state"))
    return report.confidence_rollup(gaps.unionByName(found))


@query
def a11_capped_findings(spark, d):
    gaps = report.known_gaps(_report(spark, d))
    return report.cap_confidence(gaps, _gate(spark, d))


# --- streams ---------------------------------------------------------------------------------
@query
def s4_stream_request_rates(spark, d):
    log = A.select(incremental.read_stream(spark, d, "events"), A.FETCH_LOG)
    rates = incremental.drain(
        incremental.request_rates(log.withColumn("ts", F.col("ts").cast("timestamp")), "60 days", width="1 hour"), ["site", "start"]
    )
    return rates.select("site", F.unix_seconds("start").alias("start"), "requests", "bytes")


@query
def s4_stream_fresh_urls(spark, d):
    log = A.select(incremental.read_stream(spark, d, "events"), A.FETCH_LOG)
    fresh = incremental.fresh_urls(log.withColumn("ts", F.col("ts").cast("timestamp")), "60 days")
    return incremental.drain(fresh).select("site", "norm_url")


@query
def s4_stream_duplicate_groups(spark, d):
    """Groups of canonical URLs as keyed state over the stream of pages, joined back to all pages."""
    keyed.with_state_store(spark)
    pages = incremental.read_stream(spark, d, "pages").select("page_id", "url")
    groups = incremental.drain(keyed.running_groups(pages), ["norm_url"])
    return keyed.members(keyed.page_rows(spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url")), groups)


@query
def s4_stream_politeness(spark, d):
    """Gaps of the request stream by stretches of a day."""
    keyed.with_state_store(spark)
    log = A.select(incremental.read_stream(spark, d, "events"), A.FETCH_LOG).select("site", F.col("ts").cast("timestamp").alias("ts"))
    stretches = incremental.drain(keyed.running_gaps(log, "60 days", 600_000, "1 day"), ["site", "bucket", "kind"])
    return keyed.gap_report(stretches, 600_000)


@query
def s4_stream_stage_status(spark, d):
    log = A.select(incremental.read_stream(spark, d, "orders"), A.STAGE_LOG)
    return incremental.drain(incremental.latest_stages(log), ["site", "stage"])


def entry(spark: SparkSession) -> DataFrame:
    """Main navigation per site out of stored HTML, on the smoke data."""
    return a3_main_navigation(spark, SMOKE_DIR)


def queries() -> dict[str, Query]:
    return _QUERIES | LLM_QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES | LLM_ORACLES
