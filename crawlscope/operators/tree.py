"""Site tree: parents by path, reachability from the root, child order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope.functions import urls
from crawlscope.operators.common import HOT_GROUP, attach_group, numbered_by_range
from crawlscope.session import cut_lineage


def _parent_path(path):
    """``/a/b`` -> ``/a``; ``/a`` and ``/`` -> ``/``."""
    up = F.regexp_replace(path, r"/[^/]*$", "")
    return F.when(up == "", F.lit("/")).otherwise(up)


def site_parents(pages: DataFrame, roots: DataFrame, hot: int = HOT_GROUP) -> DataFrame:
    """pages(site, url, page_ord, ...), roots(site, root_url) -> pages plus path, root_url, parent_url.

    The parent is the page at the immediate parent path: the first one without a query, else the
    first; without any it is the root. The root itself has no parent.
    """
    # Five branches read the page list, so it is stored once.
    rows = cut_lineage(
        pages.withColumn("path", urls.site_path(F.col("url"))).withColumn("parent_path", _parent_path(F.col("path")))
    )
    owners = rows.groupBy("site", "path").agg(
        F.min_by("url", F.struct(urls.query(F.col("url")) != "", F.col("page_ord"))).alias("owner_url")
    )
    # Children counts tell which parent paths are hot; each is then split over several tasks.
    children = rows.groupBy("site", "parent_path").agg(F.count("*").alias("_children"))
    lookup = children.join(
        owners.withColumnRenamed("path", "parent_path"), ["site", "parent_path"], "left"
    )
    sites = rows.groupBy("site").agg(F.count("*").alias("_pages")).join(roots, "site")
    found = attach_group(rows, lookup, ["site", "parent_path"], "_children", ["url"], hot=hot)
    rooted = attach_group(found, sites, ["site"], "_pages", ["url"], hot=hot)
    return rooted.withColumn(
        "parent_url",
        F.when(F.col("url") != F.col("root_url"), F.coalesce("owner_url", "root_url")),
    ).drop("parent_path", "owner_url", "_children", "_pages")


def reachable(nodes: DataFrame) -> DataFrame:
    """Stored nodes(site, url, parent_url, root_url) -> site, url, in_tree.

    Pointer doubling: every unresolved node looks at its pointer's pointer, so a chain of n
    levels takes log2(n) joins. A node is in the tree when its pointer reaches the root, and out
    when it runs into a page that is its own parent.
    """
    root, ptr = F.col("root_url"), F.col("ptr")
    start = nodes.select("site", "url", "root_url", F.coalesce("parent_url", "url").alias("ptr"))
    start = start.withColumn("done", (ptr == root) | (ptr == F.col("url")))
    # ``nodes`` is stored already, so the first state is a mere projection of it.
    parts = [start.filter("done")]
    active = start.filter("NOT done")
    known = start
    while not active.isEmpty():
        hops = known.select("site", F.col("url").alias("ptr"), F.col("ptr").alias("next"), F.col("done").alias("end"))
        demand = active.groupBy("site", "ptr").agg(F.count("*").alias("_n"))
        hops = demand.join(hops, ["site", "ptr"], "left")
        moved = cut_lineage(
            attach_group(active.drop("done"), hops, ["site", "ptr"], "_n", ["url"]).select(
                "site",
                "url",
                "root_url",
                F.coalesce("next", "ptr").alias("ptr"),
                F.coalesce("end", F.lit(True)).alias("done"),
            )
        )
        parts.append(moved.filter("done"))
        active = moved.filter("NOT done")
        # Pointers of finished nodes keep their value; only the moved ones change.
        known = parts[0]
        for part in parts[1:]:
            known = known.unionByName(part)
        known = known.unionByName(active)
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.select("site", "url", (ptr == root).alias("in_tree"))


def site_tree(pages: DataFrame, roots: DataFrame, hot: int = HOT_GROUP) -> DataFrame:
    """pages(site, url, page_ord, depth, ...) -> adjacency rows with in_tree and child_ord.

    ``child_ord`` numbers the children of one parent by (depth, url). Pages that cannot be
    reached from the root stay in the table with ``in_tree`` false. A root that is no page gets
    a row of its own.
    """
    missing = roots.join(
        pages.select("site", F.col("url").alias("root_url")), ["site", "root_url"], "left_anti"
    ).select(
        "site",
        F.col("root_url").alias("url"),
        F.lit(-1).cast("bigint").alias("page_ord"),
        F.lit(0).cast("bigint").alias("depth"),
    )
    nodes = cut_lineage(site_parents(pages.unionByName(missing, allowMissingColumns=True), roots, hot))
    reach = reachable(nodes)
    ordered = numbered_by_range(
        nodes.withColumn("_parent", F.coalesce("parent_url", F.lit(""))), ["site", "_parent"], ["depth", "url"], "child_ord"
    )
    return ordered.drop("_parent").join(reach, ["site", "url"])


def tree_with_content(tree: DataFrame, paths: DataFrame) -> DataFrame:
    """Attach the mirror file to each node: paths(site, url, content_path)."""
    return tree.join(paths.select("site", "url", "content_path"), ["site", "url"], "left")
