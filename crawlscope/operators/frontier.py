"""Breadth-first crawl plan over stored links, and journeys on top of it."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope import dims
from crawlscope.functions import urls
from crawlscope.operators.common import first_seen, numbered_by_range, top_k
from crawlscope.operators.robots import mark_blocked
from crawlscope.session import cut_lineage, place_by


def robots_split(pages: DataFrame, rules: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Allowed and blocked pages."""
    marked = mark_blocked(pages, rules, strict=strict)
    return marked.filter("NOT blocked").drop("blocked"), marked.filter("blocked").drop("blocked")


def crawl_plan(
    seeds: DataFrame,
    edges: DataFrame,
    rules: DataFrame,
    failed: DataFrame | None = None,
    max_pages: int | None = None,
    max_depth: int | None = None,
) -> DataFrame:
    """Which pages a polite first-in-first-out crawl visits, and in what order.

    seeds(site, url, ord), edges(site, src, dst, link_ord), rules(site, prefixes),
    failed(site, url) -> site, url, depth, visit_ord, status (ok, blocked, failed).

    A page is queued once, at the depth of the first page linking it plus one. Blocked seeds
    and failed pages use up budget and lead nowhere. Sites advance level by level together.
    Without limits all reachable pages are visited. With ``max_pages``, only the first of a level
    can fit the budget, so each level is cut to them before it is ordered; what is cut could never
    be visited later. Robots rules are looked up for the links of opened pages only.
    """
    if max_pages is not None and max_pages < 1 or max_depth is not None and max_depth < 0:
        raise ValueError("max_pages must be at least 1 and max_depth at least 0")
    # Repeated links fold first: many copies of one page then count as one.
    own = edges.filter(urls.netloc(F.col("dst")) == F.col("site")).groupBy("site", "src", "dst").agg(
        F.min("link_ord").alias("link_ord")
    )
    usable = place_by(own, "site", "src") if max_depth != 0 else None

    if failed is not None:
        # Looked up on every level, so it is computed and placed once.
        failed = place_by(failed.select("site", "url").distinct(), "site", "url").withColumn("_failed", F.lit("failed"))
    queue = mark_blocked(seeds, rules, few=True).select(
        "site", "url", "ord", F.when(F.col("blocked"), F.lit("blocked")).alias("status")
    )
    levels: list[DataFrame] = []
    for depth in count():
        if max_pages is None:  # a site may own a third of the level
            cut = numbered_by_range(queue, ["site"], ["ord", "url"], "_rank")
        else:
            cut = top_k(queue, ["site"], [F.col("ord"), F.col("url")], max_pages, rank="_rank")
        if levels:
            used = reduce(DataFrame.unionByName, levels).groupBy("site").agg(F.max("visit_ord").alias("_used"))
            cut = cut.join(used, "site", "left")
        else:
            cut = cut.withColumn("_used", F.lit(0).cast("bigint"))
        level = cut.select(
            "site", "url", F.lit(depth).cast("bigint").alias("depth"),
            (F.coalesce("_used", F.lit(0)) + F.col("_rank")).cast("bigint").alias("visit_ord"), "status",
        )
        level = level if max_pages is None else level.filter(F.col("visit_ord") <= max_pages)
        if failed is not None:
            level = level.join(failed, ["site", "url"], "left").withColumn(
                "status", F.coalesce("status", "_failed")
            ).drop("_failed")
        level = cut_lineage(level.withColumn("status", F.coalesce("status", F.lit("ok"))))
        levels.append(level)
        if depth == max_depth or level.isEmpty():
            break
        # At most max_pages open pages per site; the links stay where they were put above.
        opened = level.filter("status = 'ok'").select("site", F.col("url").alias("src"), "visit_ord")
        targets = usable.join(opened, ["site", "src"]).select(
            "site", F.col("dst").alias("url"), F.array("visit_ord", "link_ord").alias("ord")
        )
        queue = first_seen(targets, ["site", "url"], ["ord"])
        known = reduce(DataFrame.unionByName, levels).select("site", "url")
        queue = queue.join(known, ["site", "url"], "left_anti")
        # Only links of the opened pages are checked, so a site has few of them.
        queue = mark_blocked(queue, rules, few=True).filter("NOT blocked").select(
            "site", "url", "ord", F.lit(None).cast("string").alias("status")
        )
    return reduce(DataFrame.unionByName, levels)


def plan_summary(plan: DataFrame, max_pages: int) -> DataFrame:
    """Pages visited, blocked and failed per site, and whether the budget was used up."""
    return plan.groupBy("site").agg(
        F.count_if(F.col("status") == "ok").alias("visited"),
        F.count_if(F.col("status") == "blocked").alias("blocked"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.max("depth").alias("max_depth"),
        (F.count("*") >= max_pages).alias("budget_used"),
    )


def journey_steps(plan: DataFrame, goals: dict[str, str]) -> DataFrame:
    """Shortest path to a goal page per site and goal: site, goal, steps, grade.

    ``goals`` maps a name to a pattern over the URL path. Steps count the pages on the path,
    the root included; unreachable goals have no steps and grade poor.
    """
    ok = plan.filter("status = 'ok'")
    per_site = ok.groupBy("site").agg(
        *[
            F.min(F.when(urls.path(F.col("url")).rlike(pattern), F.col("depth") + 1)).alias(name)
            for name, pattern in goals.items()
        ]
    )
    rows = per_site.unpivot("site", list(goals), "goal", "steps")
    return rows.withColumn(
        "grade",
        F.when(F.col("steps") <= dims.JOURNEY_GOOD, F.lit("good"))
        .when(F.col("steps") <= dims.JOURNEY_FAIR, F.lit("fair"))
        .otherwise(F.lit("poor")),
    )


def predecessors(plan: DataFrame, edges: DataFrame) -> DataFrame:
    """site, url, depth, before: the page that a breadth-first crawl came from, the first opened one a level above;
    null for seeds. plan from ``crawl_plan``, edges(site, src, dst, link_ord)."""
    opened = plan.filter("status = 'ok'")
    sources = opened.select("site", F.col("url").alias("src"), "visit_ord", (F.col("depth") + 1).alias("depth"))
    targets = opened.select("site", F.col("url").alias("dst"), "depth")
    steps = edges.select("site", "src", "dst", "link_ord").join(sources, ["site", "src"]).join(targets, ["site", "dst", "depth"])
    first = steps.groupBy("site", F.col("dst").alias("url")).agg(F.min_by("src", F.struct("visit_ord", "link_ord")).alias("before"))
    return opened.select("site", "url", "depth").join(first, ["site", "url"], "left")


def journey_paths(plan: DataFrame, edges: DataFrame, goals: dict[str, str], navigation: DataFrame | None = None) -> DataFrame:
    """The shortest path itself: site, goal, goal_url, path ARRAY<STRING> from the root to the goal, steps, in_navigation,
    grade.

    The goal page is the first one visited among those whose URL path matches. A goal that is not reached has no
    path and grade poor; one that navigation(site, url) does not name is at best fair. Paths come by
    pointer doubling: round k joins every page to its ancestor 2^k levels above, and every place of a path jumps by
    the bits of its distance, so a path of a thousand pages takes ten rounds.
    """
    before = cut_lineage(predecessors(plan, edges))
    cases = [F.when(urls.path(F.col("url")).rlike(p), F.lit(name)) for name, p in goals.items()]
    matching = plan.filter("status = 'ok'").select("site", "url", "depth", "visit_ord", F.explode(F.array_compact(F.array(*cases))).alias("goal"))
    chosen = cut_lineage(first_seen(matching, ["site", "goal"], ["visit_ord"]).select("site", "goal", F.col("url").alias("goal_url"), "depth"))
    # One row for each place of a path, that many levels above the goal.
    places = chosen.select("site", "goal", "depth", F.col("goal_url").alias("url"), F.explode(F.sequence(F.lit(0), F.col("depth").cast("int"))).alias("up"))
    jumps = before.select("site", "url", F.col("before").alias("above")).filter("above IS NOT NULL")
    longest, bit = chosen.agg(F.max("depth")).first()[0] or 0, 0
    while longest >> bit:
        here = F.col("up").bitwiseAND(1 << bit) > 0
        places = cut_lineage(
            places.join(jumps, ["site", "url"], "left")
            .withColumn("url", F.when(here, F.col("above")).otherwise(F.col("url")))
            .drop("above")
        )
        bit += 1
        if longest >> bit:
            further = jumps.select("site", F.col("url").alias("above"), F.col("above").alias("_far"))
            jumps = cut_lineage(jumps.join(further, ["site", "above"]).select("site", "url", F.col("_far").alias("above")))
    ordered = F.array_sort(F.collect_list(F.struct((F.col("depth") - F.col("up")).alias("place"), "url")))
    paths = places.groupBy("site", "goal").agg(F.transform(ordered, lambda p: p["url"]).alias("path"))
    rows = plan.select("site").distinct().select("site", F.explode(F.array(*[F.lit(g) for g in goals])).alias("goal"))
    rows = rows.join(chosen, ["site", "goal"], "left").join(paths, ["site", "goal"], "left")
    if navigation is None:
        rows = rows.withColumn("in_navigation", F.lit(None).cast("boolean"))
    else:
        named = navigation.select("site", F.col("url").alias("goal_url")).distinct().withColumn("_named", F.lit(True))
        rows = rows.join(named, ["site", "goal_url"], "left").withColumn("in_navigation", F.col("_named").isNotNull())
    steps = F.col("depth") + 1
    good = (steps <= dims.JOURNEY_GOOD) & F.coalesce("in_navigation", F.lit(True))
    grade = F.when(good, F.lit("good")).when(steps <= dims.JOURNEY_FAIR, F.lit("fair")).otherwise(F.lit("poor"))
    return rows.select("site", "goal", "goal_url", "path", steps.alias("steps"), "in_navigation", grade.alias("grade"))


def navigation_journey(navigation: DataFrame) -> DataFrame:
    """Shortcut on the main navigation: steps = 1..3 by its first items, good from 3 items on."""
    items = F.count("*")
    return navigation.groupBy("site").agg(
        F.least(F.greatest(items, F.lit(1)), F.lit(3)).cast("bigint").alias("steps"),
        F.when(items >= 3, F.lit("good")).otherwise(F.lit("fair")).alias("grade"),
    )
