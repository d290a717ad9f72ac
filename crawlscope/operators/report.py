"""Site report: joined summaries, gaps, features, slices, requests, confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlscope import dims
from crawlscope.functions import urls
from crawlscope.operators.common import top_k


def site_report(ux: DataFrame, ia: DataFrame, tech: DataFrame, api: DataFrame) -> DataFrame:
    """Outer join of four one-row-per-site summaries.

    ux(site, page_count), ia(site, page_count, nav_items), tech(site, frameworks),
    api(site, same_origin_calls) -> site, has_ux, has_ia, has_tech, has_api and their values.
    """
    parts = [
        ux.select("site", F.col("page_count").alias("ux_pages"), F.lit(True).alias("has_ux")),
        ia.select("site", F.col("page_count").alias("ia_pages"), "nav_items", F.lit(True).alias("has_ia")),
        tech.select("site", "frameworks", F.lit(True).alias("has_tech")),
        api.select("site", "same_origin_calls", F.lit(True).alias("has_api")),
    ]
    joined = reduce(lambda a, b: a.join(b, "site", "full_outer"), parts)
    return joined.na.fill(False, ["has_ux", "has_ia", "has_tech", "has_api"])


def report_metrics(report: DataFrame) -> DataFrame:
    """Page count (IA, else UX, else 0), navigation items, frameworks, same-origin calls."""
    zero = F.lit(0).cast("bigint")
    return report.select(
        "site",
        F.coalesce("ia_pages", "ux_pages", zero).alias("pages"),
        F.coalesce("nav_items", zero).alias("nav_items"),
        F.coalesce("frameworks", zero).alias("frameworks"),
        F.coalesce("same_origin_calls", zero).alias("same_origin_calls"),
    )


def known_gaps(report: DataFrame) -> DataFrame:
    """One row per missing summary: site, item, state, reason, action; API evidence counts as missing without own calls."""

    def row(item: str, state: str, reason: str, action: str) -> Column:
        return F.struct(*[F.lit(v).alias(n) for n, v in (("item", item), ("state", state), ("reason", reason), ("action", action))])

    def gap(item: str, state: str, reason: str, action: str, condition: Column) -> Column:
        return F.when(condition, row(item, state, reason, action))

    no_calls = F.coalesce("same_origin_calls", F.lit(0)) == 0
    gaps = F.array_compact(
        F.array(
            gap("ux_summary", "Unknown", "ux_scan_not_run", "run_ux_scan", ~F.col("has_ux")),
            gap("ia_summary", "Unknown", "ia_scan_not_run", "run_ia_scan", ~F.col("has_ia")),
            gap("tech_summary", "Unknown", "tech_scan_not_run", "run_tech_scan", ~F.col("has_tech")),
            gap("api_evidence", "Hypothesis", "too_few_own_calls_seen", "collect_more_journeys_or_data_by_hand", no_calls),
        )
    )
    none = F.array(row("none", "Confirmed", "", ""))
    return report.select("site", F.explode(F.when(F.size(gaps) == 0, none).otherwise(gaps)).alias("g")).select(
        "site", "g.*"
    )


def site_features(navigation: DataFrame, sites: DataFrame) -> DataFrame:
    """Features named by the navigation text: site, feature, feature_ord.

    navigation(site, text); a keyword is a substring of the lower-cased text. A site with any
    feature also gets the home feature first; a site without gets the three usual ones.
    """
    lowered = F.lower("text")
    labels: dict[str, list[tuple[int, str]]] = {}
    for i, (word, label) in enumerate(dims.FEATURE_KEYWORDS, start=1):
        labels.setdefault(label, []).append((i, word))

    def first_hit(words: list[tuple[int, str]]) -> Column:
        hits = [F.when(lowered.contains(word), F.lit(i).cast("bigint")) for i, word in words]
        return F.min(F.array_min(F.array(*hits)))

    # One row per site and one column per label: a single fold of the navigation texts.
    wide = navigation.groupBy("site").agg(*[first_hit(words).alias(label) for label, words in labels.items()])

    def entry(label: str, ord_: Column) -> Column:
        return F.struct(F.lit(label).alias("feature"), ord_.cast("bigint").alias("ord"))

    found = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), entry(n, F.col(n))) for n in labels]))
    usual = F.array(*[entry(f, F.lit(i)) for i, f in enumerate(dims.DEFAULT_FEATURES)])
    with_home = F.concat(F.array(entry(dims.HOME_FEATURE, F.lit(0))), found)
    listed = sites.select("site").join(wide, "site", "left")
    return listed.select("site", F.explode(F.when(F.size(found) == 0, usual).otherwise(with_home)).alias("f")).select(
        "site", "f.feature", F.col("f.ord").alias("feature_ord")
    )


def feature_checklist(features: DataFrame, sites: DataFrame) -> DataFrame:
    """The standard features with a found flag, then any extra ones: site, feature, found, standard."""
    standard = sites.select("site", F.explode(F.array(*[F.lit(f) for f in dims.STANDARD_FEATURES])).alias("feature"))
    flagged = standard.withColumn("standard", F.lit(True)).join(
        features.select("site", "feature", F.lit(True).alias("found")), ["site", "feature"], "full_outer"
    )
    return flagged.na.fill(False, ["standard", "found"])


def report_sections(
    palette: DataFrame, typography: DataFrame, navigation: DataFrame, frameworks: DataFrame,
    endpoints: DataFrame, sites: DataFrame,
) -> DataFrame:
    """Top lines per section and site: site, section, rank, line; an empty section gets one line."""
    cut = dims.REPORT_SLICES

    def ranked(section: str, df: DataFrame, line: Column) -> DataFrame:
        return df.filter(F.col("rank") <= cut[section]).select(
            "site", F.lit(section).alias("section"), F.col("rank").cast("bigint").alias("rank"), line.alias("line")
        )

    first = top_k(frameworks, ["site"], [F.col("first_page"), F.col("rule_ord"), F.col("version")], cut["frameworks"])
    called = top_k(endpoints, ["site"], [F.col("first_seq")], cut["api"])
    endpoint_path = urls.path(F.col("url"))
    lines = [
        ranked("palette", palette, F.concat_ws("", "role", F.lit(": "), "hex", F.lit(" ("), "value", F.lit(", count "), "cnt", F.lit(")"))),
        ranked("typography", typography, F.concat_ws(" / ", "family", "size", "weight")),
        ranked("navigation", navigation, F.concat_ws("", "text", F.lit(" ("), "href", F.lit(")"))),
        ranked("frameworks", first, F.concat_ws("", "name", F.lit(" ("), "confidence", F.lit(")"))),
        ranked("api", called, F.when(endpoint_path == "", F.col("url")).otherwise(endpoint_path)),
    ]
    filled = reduce(DataFrame.unionByName, lines)
    # An outer join on the small grid, so that the sections are computed once.
    grid = sites.select("site", F.explode(F.array(*[F.lit(s) for s in cut])).alias("section"))
    return grid.join(filled, ["site", "section"], "left").select(
        "site",
        "section",
        F.coalesce("rank", F.lit(1).cast("bigint")).alias("rank"),
        F.coalesce("line", F.lit("needs_more_data")).alias("line"),
    )


def request_list(report: DataFrame) -> DataFrame:
    """Requests for the client: a caution first when there is no own API call: site, ord, request."""
    fixed = F.array(*[F.lit(r) for r in dims.REQUESTS])
    caution = F.concat(F.array(F.lit(dims.API_CAUTION_REQUEST)), fixed)
    no_calls = F.coalesce("same_origin_calls", F.lit(0)) == 0
    return report.select("site", F.posexplode(F.when(no_calls, caution).otherwise(fixed)).alias("ord", "request")).withColumn(
        "ord", F.col("ord").cast("bigint")
    )


def confidence_rollup(findings: DataFrame) -> DataFrame:
    """Findings per confidence class and site, and whether any needs a follow-up.

    findings(site, state). The class list is closed, so no pass over the data looks for values.
    """
    wide = findings.groupBy("site").agg(
        *[F.count_if(F.col("state") == c).alias(c.lower()) for c in dims.CONFIDENCE]
    )
    return wide.withColumn("follow_up", (F.col("hypothesis") + F.col("unknown")) > 0)


def cap_confidence(findings: DataFrame, gates: DataFrame) -> DataFrame:
    """Lower each finding's class to what the site's evidence gate allows; a site without calls has no evidence."""
    classes = F.array(*[F.lit(c) for c in dims.CONFIDENCE])
    joined = findings.join(gates.select("site", "confidence_cap"), "site", "left")
    rank = F.greatest(
        F.array_position(classes, F.col("state")), F.array_position(classes, F.coalesce("confidence_cap", F.lit("Hypothesis")))
    )
    return joined.withColumn("state", F.element_at(classes, rank.cast("int"))).drop("confidence_cap")
