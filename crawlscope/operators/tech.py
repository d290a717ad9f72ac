"""Frameworks, resources, headers, timing and grades."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlscope import dims
from crawlscope.functions import html as H
from crawlscope.functions import urls
from crawlscope.operators.common import first_seen, numbered_by_range, top_k
from crawlscope.session import cut_lineage


def safe_headers(headers: Column) -> Column:
    """Header map without the sensitive ones, whatever their case."""
    hidden = F.array(*[F.lit(h) for h in dims.SENSITIVE_HEADERS])
    return F.map_filter(headers, lambda name, _: ~F.array_contains(hidden, F.lower(name)))


def response_log(log: DataFrame) -> DataFrame:
    """Raw responses -> safe headers, size from content-length if unknown."""
    kept = safe_headers(F.col("headers"))
    length = F.try_element_at(
        F.map_values(F.map_filter("headers", lambda k, _: F.lower(k) == "content-length")), F.lit(1)
    )
    declared = F.when(length.rlike(r"^\d+$"), length.try_cast("bigint"))
    return log.withColumn("size", F.coalesce("size", declared, F.lit(0))).withColumn("headers", kept)


# Opening tags without these texts cannot match a rule on ids, classes or tags.
_MARKED = r"__next|__NEXT_DATA__|wp-|data-reactroot"


def _places(html: Column) -> dict[str, Column]:
    """Where fingerprints are looked for: extracted tags and scripts, never the page's prose."""
    seen = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    scripts = H.tags(seen, "script")
    opening = F.regexp_extract_all(H.visible(html), F.lit(rf"(?i)<[a-z][a-z0-9]*\b{H.TAG_BODY}>"), F.lit(0))
    # Most pages hold none of the texts at all, so their tags need not be listed.
    marked = F.when(html.rlike(_MARKED), F.filter(F.concat(opening, scripts), lambda t: t.rlike(_MARKED))).otherwise(
        F.array().cast("array<string>")
    )

    def values(tags: Column, name: str) -> Column:
        return F.array_join(F.transform(tags, lambda t: H.attribute(t, name)), "\n")

    return {
        "script": F.array_join(F.regexp_extract_all(seen, F.lit(r"(?is)<script\b[^>]*>(.*?)</script\s*>"), F.lit(1)), "\n"),
        "script_src": values(scripts, "src"),
        "generator": values(F.filter(H.tags(seen, "meta"), H.attr_equals("name", "generator")), "content"),
        "stylesheet": values(F.filter(H.tags(seen, "link"), H.attr_equals("rel", "stylesheet")), "href"),
        "id": values(marked, "id"),
        "class": values(marked, "class"),
        "tag": F.array_join(marked, "\n"),
    }


def detect_frameworks(pages: DataFrame, rules: list[tuple] = dims.FINGERPRINTS) -> DataFrame:
    """Rules that match in a page: site, page_id, rule_ord, name, confidence, evidence, version.

    Rules are literals in one projection, so each pattern is compiled once and no join happens.
    """
    places = _places(F.col("html"))

    def hit(ord_: int, rule: tuple) -> Column:
        name, looked_for, confidence, evidence, version = rule
        found = F.regexp_extract(F.col(f"in_{version[0]}"), version[1], 1) if version else F.lit("")
        return F.when(
            reduce(or_, [F.col(f"in_{place}").rlike(pattern) for place, pattern in looked_for]),
            F.struct(
                F.lit(ord_).cast("bigint").alias("rule_ord"), F.lit(name).alias("name"),
                F.lit(confidence).alias("confidence"), F.lit(evidence).alias("evidence"), found.alias("version"),
            ),
        )

    hits = F.array_compact(F.array(*[hit(i, r) for i, r in enumerate(rules)]))
    rows = pages.select(urls.netloc(F.col("url")).alias("site"), "page_id", *[c.alias(f"in_{p}") for p, c in places.items()])
    return rows.select("site", "page_id", F.explode(hits).alias("d")).select("site", "page_id", "d.*")


def frameworks(detections: DataFrame) -> DataFrame:
    """Distinct detections per site at the place of the first one: adds pages and first_page."""
    return detections.groupBy("site", "name", "version", "confidence", "evidence").agg(
        F.count("*").alias("pages"), F.min(F.struct("page_id", "rule_ord")).alias("first")
    ).select("site", "name", "version", "confidence", "evidence", "pages",
             F.col("first.page_id").alias("first_page"), F.col("first.rule_ord").alias("rule_ord"))


def top_resources(log: DataFrame, k: int = dims.TOP_RESOURCES) -> DataFrame:
    """Largest responses per site, earlier first on ties."""
    slim = log.select("site", "seq", "url", "type", "size")
    return top_k(slim, ["site"], [F.desc("size"), F.col("seq")], k).withColumn("rank", F.col("rank").cast("bigint"))


def third_party_heavy(top: DataFrame) -> DataFrame:
    """Scripts, styles, images and fonts of other origins among the largest responses."""
    return top.filter(
        (urls.netloc(F.col("url")) != F.col("site")) & F.col("type").isin(*dims.HEAVY_ASSET_TYPES)
    )


def third_party_inventory(log: DataFrame, purposes: list[tuple] = dims.HOST_PURPOSES) -> DataFrame:
    """Requests and bytes per site and foreign host, with the purpose the host name suggests."""
    host = urls.netloc(F.col("url"))
    foreign = log.select("site", host.alias("host"), "size").filter(F.col("host") != F.col("site"))
    sums = foreign.groupBy("site", "host").agg(F.count("*").alias("requests"), F.sum("size").alias("bytes"))
    purpose = F.lit("Other")
    for name, pattern in reversed(purposes):
        purpose = F.when(F.col("host").rlike(pattern), F.lit(name)).otherwise(purpose)
    return sums.withColumn("purpose", purpose)


def page_results(pages: DataFrame, log: DataFrame, timings: DataFrame, vitals: DataFrame) -> DataFrame:
    """What the tech scan tells of each page: site, page_id, url, status, frameworks, dom_content_loaded, load_complete,
    lcp, cls, requests.

    pages(page_id, url, html), log(site, page_url, seq, url, type, status), timings(site, page_url, dom_content_loaded,
    load_complete), vitals(site, page_url, seq, start, shift, recent_input). ``status`` is that of the first
    document loaded for the page, ``frameworks`` lists names and versions in the order of the rules. What
    was not recorded is null; pages without responses have 0 requests. Tables meet by site and address of the page.
    """
    found = detect_frameworks(pages)
    named = F.concat("name", F.when(F.col("version") != "", F.concat(F.lit(" "), "version")).otherwise(F.lit("")))
    listed = F.array_sort(F.collect_set(F.struct("rule_ord", named.alias("name"))))  # one entry for each rule at most
    frameworks_ = found.groupBy("page_id").agg(F.array_join(F.transform(listed, lambda f: f["name"]), ", ").alias("frameworks"))
    responses = log.groupBy("site", F.col("page_url").alias("url")).agg(
        F.min_by("status", F.when(F.col("type") == "document", F.col("seq"))).alias("status"), F.count("*").alias("requests")
    )
    times = timings.groupBy("site", F.col("page_url").alias("url")).agg(
        F.max("dom_content_loaded").alias("dom_content_loaded"), F.max("load_complete").alias("load_complete")
    )
    shown = web_vitals(vitals, "site", "page_url").withColumnRenamed("page_url", "url")
    rows = pages.select(urls.netloc(F.col("url")).alias("site"), "page_id", "url").join(frameworks_, "page_id", "left")
    for part in (responses, times, shown):
        rows = rows.join(part, ["site", "url"], "left")
    return rows.select(
        "site", "page_id", "url", "status", F.coalesce("frameworks", F.lit("")).alias("frameworks"), "dom_content_loaded", "load_complete",
        "lcp", "cls", F.coalesce("requests", F.lit(0)).alias("requests"),
    )


def request_totals(log: DataFrame) -> DataFrame:
    """site, requests, bytes of all responses."""
    return log.groupBy("site").agg(F.count("*").alias("requests"), F.sum("size").alias("bytes"))


def main_document(log: DataFrame) -> DataFrame:
    """First document response on the site's own origin; an aggregate, not a sort."""
    docs = log.filter((F.col("type") == "document") & (urls.netloc(F.col("url")) == F.col("site")))
    return first_seen(docs, ["site"], ["seq"])


def infra_signals(documents: DataFrame) -> DataFrame:
    """Server, CDN and compression out of the main document's headers(MAP)."""
    lowered = F.map_from_entries(
        F.transform(
            F.map_entries("headers"), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))
        )
    )

    def header(name: str) -> Column:
        return F.try_element_at(F.col("h"), F.lit(name))

    return documents.withColumn("h", lowered).select(
        "site",
        header("server").alias("server"),
        F.coalesce(header("x-cdn"), header("via")).alias("cdn"),
        F.coalesce(header("content-encoding"), F.lit("none")).alias("compression"),
        F.startswith(F.col("url"), F.lit("https://")).alias("https"),
    )


def web_vitals(entries: DataFrame, *keys: str) -> DataFrame:
    """entries(site, seq, start, shift, recent_input) -> site, lcp, cls, or one row for each value of ``keys``.

    LCP is the start of the last entry that has one, CLS the sum of shifts without recent input.
    """
    return entries.groupBy(*(keys or ("site",))).agg(
        F.round(F.max_by("start", F.when(F.col("start").isNotNull(), F.col("seq")))).cast("bigint").alias("lcp"),
        # Decimals, so that the sum does not depend on the order of the tasks.
        F.round(
            F.coalesce(
                F.sum(F.when(~F.col("recent_input"), F.col("shift").cast("decimal(26,16)"))),
                F.lit(0).cast("decimal(36,16)"),
            ),
            3,
        )
        .cast("double")
        .alias("cls"),
    )


def timing_grades(timings: DataFrame, limits: list[tuple] = dims.TIMING_LIMITS) -> DataFrame:
    """timings(site, <metric>...) -> site, metric, value, grade against its limit.

    Below the limit is good, the rest is poor.
    """
    names = [name for name, _ in limits if name in timings.columns]
    rows = timings.select("site", *[F.col(n).cast("double").alias(n) for n in names]).unpivot(
        "site", names, "metric", "value"
    )
    limit = reduce(
        lambda acc, pair: F.when(F.col("metric") == pair[0], F.lit(pair[1])).otherwise(acc), limits, F.lit(None).cast("double")
    )
    return rows.filter("value IS NOT NULL").withColumn(
        "grade",
        F.when(F.col("value") < limit, F.lit("good")).otherwise(F.lit("poor")),
    )


def timing_rollup(timings: DataFrame, metric: str) -> DataFrame:
    """Mean, median and upper quartile of one metric per site, exact.

    Equal values fold into one row with a count first. Running totals are taken inside range parts of
    (site, value), so a site of any number of different values spans many tasks.
    """
    counts = timings.filter(F.col(metric).isNotNull()).groupBy("site", F.col(metric).alias("v")).agg(F.count("*").alias("c"))
    upto = numbered_by_range(counts, ["site"], ["v"], "upto", weight="c")
    ranked = upto.join(upto.groupBy("site").agg(F.sum("c").alias("n")), "site")

    def quantile(share: float) -> Column:
        return F.min(F.when(F.col("upto") >= F.col("n") * share, F.col("v")))

    return ranked.groupBy("site").agg(
        F.max("n").alias("n"), F.round(F.sum(F.col("v") * F.col("c")) / F.max("n"), 3).alias("mean"),
        quantile(0.5).alias("p50"), quantile(0.75).alias("p75"),
    )


def lighthouse_scores(reports: DataFrame) -> DataFrame:
    """lighthouse(site, body JSON) -> site, category, score 0..100 to one decimal; absent ones drop."""
    names = dims.LIGHTHOUSE_CATEGORIES
    scores = [
        F.round(F.get_json_object("body", f"$.categories['{n}'].score").try_cast("double") * 100, 1).alias(n) for n in names
    ]
    rows = reports.select("site", *scores).unpivot("site", [F.col(f"`{n}`") for n in names], "category", "score")
    return rows.filter("score IS NOT NULL").withColumn(
        "grade",
        F.when(F.col("score") >= dims.SCORE_GOOD, F.lit("good"))
        .when(F.col("score") >= dims.SCORE_FAIR, F.lit("fair"))
        .otherwise(F.lit("poor")),
    )


def politeness(log: DataFrame, min_gap_ms: int = 1000) -> DataFrame:
    """Gaps between consecutive requests of a site: site, requests, violations, min_gap_ms.

    log(site, seq, ts). Gaps are taken inside range parts of (site, time); the gap between two parts
    of a site comes from their last and first times, so a busy site, or its one busy hour, spans many
    tasks. A checkpoint pins the part numbers.
    """
    min_gap = min_gap_ms * 1000
    rows = log.select("site", "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(rows.repartitionByRange(parts, "site", "us", "seq").withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("site", "part").orderBy("us", "seq")
    gaps = placed.withColumn("gap", F.col("us") - F.lag("us").over(inside))
    by_part = gaps.groupBy("site", "part").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("gap") < min_gap).alias("bad"),
        F.min("gap").alias("low"),
        F.min("us").alias("first"),
        F.max("us").alias("last"),
    )
    edge = F.col("first") - F.lag("last").over(Window.partitionBy("site").orderBy("part"))
    return by_part.withColumn("edge", edge).groupBy("site").agg(
        F.sum("n").alias("requests"),
        (F.sum("bad") + F.count_if(F.col("edge") < min_gap)).alias("violations"),
        F.floor(F.least(F.min("low"), F.min("edge")) / 1000).alias("min_gap_ms"),
    )


def attempt_groups(attempts: DataFrame, retry: int = 2) -> DataFrame:
    """attempts(site, url, seq, ok, error) -> site, url, attempts, ok, last_error, over_limit."""
    return attempts.groupBy("site", "url").agg(
        F.count("*").alias("attempts"),
        F.bool_or("ok").alias("ok"),
        F.when(~F.bool_or("ok"), F.max_by("error", "seq")).alias("last_error"),
        (F.count("*") > retry + 1).alias("over_limit"),
    )
