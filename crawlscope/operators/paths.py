"""Mirror file paths and page numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope import dims
from crawlscope.functions import urls
from crawlscope.operators.common import HOT_GROUP, attach_group, numbered
from crawlscope.session import cut_lineage


def _folders(rows: DataFrame) -> DataFrame:
    """Distinct (site, inner) of all proper path prefixes, each the folder of some page."""
    parts = F.split("inner", "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    )
    deep = rows.filter(F.col("inner").contains("/"))
    return deep.select("site", F.explode(prefixes).alias("inner")).distinct()


def content_paths(pages: DataFrame, hot: int = HOT_GROUP) -> DataFrame:
    """pages(site, url, ...) -> the same plus content_path and is_collision.

    A query-less page that is the folder of another page becomes ``<path>/_index.md``. The root
    path always maps to ``_index.md``, whatever its query, so several pages may share that file.
    """
    root = dims.CONTENT_ROOT
    inner = urls.inner_path(F.col("url"))
    # Read by four branches below, so the page list is stored once; so are the placed rows.
    rows = cut_lineage(pages.withColumn("inner", inner).withColumn("_has_query", urls.query(F.col("url")) != ""))
    # One row per path: many query variants may share a path, so the rows are joined by size.
    folders = _folders(rows).withColumn("_is_folder", F.lit(True))
    per_path = rows.groupBy("site", "inner").agg(F.count("*").alias("_same")).join(folders, ["site", "inner"], "left")
    marked = attach_group(rows, per_path, ["site", "inner"], "_same", ["url"], hot=hot)
    folder_file = F.regexp_replace(F.concat(F.lit(root + "/"), F.col("inner"), F.lit("/_index.md")), "/+", "/")
    with_file = marked.withColumn(
        "content_path",
        F.when(F.col("inner") == "", F.lit(f"{root}/_index.md"))
        .when(F.col("_is_folder") & ~F.col("_has_query"), folder_file)
        .otherwise(urls.leaf_content_path(F.col("url"))),
    )
    placed = cut_lineage(with_file.drop("inner", "_has_query", "_is_folder", "_same"))
    users = placed.groupBy("site", "content_path").agg(F.count("*").alias("_users"))
    return (
        attach_group(placed, users, ["site", "content_path"], "_users", ["url"], hot=hot)
        .withColumn("is_collision", F.col("_users") > 1)
        .drop("_users")
    )


def page_sequence(pages: DataFrame) -> DataFrame:
    """1-based page number per site and the screenshot names of both viewports."""
    rows = numbered(pages, ["site"], "page_ord", "page_no")
    stem = F.concat(
        F.lit(dims.SCREENSHOT_ROOT + "/"),
        F.format_string("%03d", F.col("page_no")),
        F.lit("-"),
        urls.slug(F.col("url")),
    )
    return rows.withColumn("screenshot", F.concat(stem, F.lit("-pc.png"))).withColumn(
        "screenshot_mobile", F.concat(stem, F.lit("-mobile.png"))
    )
