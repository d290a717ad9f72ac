"""Palette, typography and component counts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from crawlscope import dims
from crawlscope.functions import cascade, elements
from crawlscope.functions import html as H
from crawlscope.functions import text as X
from crawlscope.functions import urls
from crawlscope.operators.common import place, top_k

# Ship the helpers with the task: executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(cascade)
cloudpickle.register_pickle_by_value(elements)
schema_of = DataType.fromDDL
_STYLE_BLOCK = r"(?is)<style\b[^>]*>(.*?)</style\s*>"
_COLOR = (
    r"(?i)(?:^|[;{\s])(?:color|background-color|border-color)\s*:\s*"
    r"(#[0-9a-f]{3,8}\b|(?:rgb|hsl)a?\([^)]*\)|[a-z]++(?!\())"
)
# A rule body, or the value of a style attribute.
_RULES = r"(?s)([^{}]*)\{([^{}]*)\}"


def declared_styles(pages: DataFrame) -> DataFrame:
    """Colours and fonts declared in style blocks and attributes.

    site, page_id, kind (color, font), value, family, size, weight, tag, ord: one row per
    declaration; computed style needs a browser, so declarations stand in for it.
    """
    seen = F.regexp_replace("html", r"(?s)<!--.*?-->", "")
    sheets = F.regexp_extract_all(seen, F.lit(_STYLE_BLOCK), F.lit(1))
    rules = F.flatten(
        F.transform(
            sheets,
            lambda s: F.transform(
                F.regexp_extract_all(s, F.lit(_RULES), F.lit(0)),
                lambda r: F.struct(
                    F.trim(F.substring_index(r, "{", 1)).alias("selector"),
                    F.regexp_extract(r, r"(?s)\{([^{}]*)\}", 1).alias("body"),
                ),
            ),
        )
    )
    tagged = F.transform(
        F.regexp_extract_all(H.visible(F.col("html")), F.lit(rf"(?i)<[a-z][a-z0-9]*\b{H.TAG_BODY}>"), F.lit(0)),
        lambda t: F.struct(
            F.regexp_extract(t, r"^<([A-Za-z0-9]+)", 1).alias("selector"), H.attribute(t, "style").alias("body")
        ),
    )
    inline = F.filter(tagged, lambda s: s["body"] != "")
    blocks = pages.select(
        urls.netloc(F.col("url")).alias("site"), "page_id",
        F.posexplode(F.concat(rules, inline)).alias("rule_ord", "rule"),
    ).select("site", "page_id", "rule_ord", "rule.*")
    colors = (
        blocks.select(
            "site", "page_id", "rule_ord", F.posexplode(F.regexp_extract_all("body", F.lit(_COLOR), F.lit(1))).alias("pos", "value")
        )
        .withColumn("value", F.lower("value"))
        .filter(~F.regexp_replace("value", r"\s", "").isin("transparent", "rgba(0,0,0,0)", "inherit", "initial", "unset"))
    )

    def declared(name: str) -> Column:
        return F.trim(F.regexp_extract("body", rf"(?i)(?:^|[;\s]){name}\s*:\s*([^;]+)", 1))

    fonts = blocks.select(
        "site", "page_id", "rule_ord",
        declared("font-family").alias("family"), declared("font-size").alias("size"),
        declared("font-weight").alias("weight"), F.upper("selector").alias("tag"),
    ).filter("family <> '' OR size <> '' OR weight <> ''")
    order = F.struct(F.col("rule_ord").cast("bigint").alias("rule"), F.col("pos").cast("bigint").alias("pos"))
    return colors.select(
        "site", "page_id", F.lit("color").alias("kind"), "value", order.alias("ord")
    ).unionByName(
        fonts.withColumn("pos", F.lit(0)).select(
            "site", "page_id", F.lit("font").alias("kind"), "family", "size", "weight", "tag", order.alias("ord")
        ),
        allowMissingColumns=True,
    )


def count_styles(declared: DataFrame) -> DataFrame:
    """Declarations -> observations with counts per page, the input of palette and typography."""
    return declared.groupBy("site", "page_id", "kind", "value", "family", "size", "weight").agg(
        F.min_by("tag", "ord").alias("tag"), F.count("*").alias("cnt"), F.min("ord").alias("ord")
    )


def computed_styles(
    pages: DataFrame, base: str = dims.BASE_STYLES, width: int = dims.VIEWPORT_WIDTH, most: int | None = None, most_fonts: int | None = None
) -> DataFrame:
    """Colours and fonts by what elements end up with, the input of palette and typography: site, page_id, kind (color,
    font), value, family, size, weight, tag (of the first element), cnt (elements), ord (by the first one).

    An element counts for its text, background and border colour, one of a text tag for its font. The page's sheets
    cascade over ``base`` at a window of ``width`` pixels; ``most`` elements and ``most_fonts`` text elements from the
    top are looked at, or all. One parser pass over each page, nothing moves.
    """
    page_styles, pieces = cascade.page_styles, elements.pieces
    seen = "array<struct<kind: string, value: string, family: string, size: string, weight: string, tag: string, cnt: bigint, ord: bigint>>"
    kind = to_arrow_type(schema_of(seen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = [page_styles(html, base, width, most, most_fonts) for html in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, kind)], ["site", "page_id", "seen"])

    rows = pages.select(urls.netloc(F.col("url")).alias("site"), F.col("page_id").cast("bigint").alias("page_id"), "html")
    found = rows.mapInArrow(run, f"site string, page_id bigint, seen {seen}")
    return found.select("site", "page_id", F.explode("seen").alias("s")).select("site", "page_id", "s.*")


def page_colors(obs: DataFrame, k: int | None = None) -> DataFrame:
    """Colours per page by count, first seen first on ties, all or the top k: obs(site, page_id, value, cnt, ord)."""
    per_page = obs.groupBy("site", "page_id", "value").agg(F.sum("cnt").alias("cnt"), F.min("ord").alias("ord"))
    return top_k(per_page, ["site", "page_id"], [F.desc("cnt"), F.col("ord")], k, rank="page_rank")


def palette(obs: DataFrame, k: int | None = dims.TOP_COLORS, per_page: int | None = None) -> DataFrame:
    """Top colours per site: site, rank, role, value, hex, cnt. Sums go over all colours of a page, or over its
    top ``per_page``."""
    sums = page_colors(obs, per_page).groupBy("site", "value").agg(
        F.sum("cnt").alias("cnt"), F.min(place(F.col("page_id"), F.col("page_rank"), 2**31)).alias("first")
    )
    ranked = top_k(sums, ["site"], [F.desc("cnt"), F.col("first")], k)
    roles = F.array(*[F.lit(r) for r in dims.PALETTE_ROLES])
    return ranked.select(
        "site",
        F.col("rank").cast("bigint").alias("rank"),
        F.coalesce(F.try_element_at(roles, F.col("rank")), F.concat(F.lit("Color "), F.col("rank"))).alias("role"),
        "value",
        X.rgb_to_hex(F.col("value")).alias("hex"),
        "cnt",
    )


def page_fonts(obs: DataFrame, k: int | None = None) -> DataFrame:
    """Fonts per page, all or the top k; the sample tag is that of the first element."""
    per_page = obs.groupBy("site", "page_id", "family", "size", "weight").agg(
        F.sum(F.coalesce("cnt", F.lit(1))).alias("cnt"), F.min("ord").alias("ord"), F.min_by("tag", "ord").alias("tag")
    )
    return top_k(per_page, ["site", "page_id"], [F.desc("cnt"), F.col("ord")], k, rank="page_rank")


def typography(obs: DataFrame, k: int | None = dims.TOP_FONTS, per_page: int | None = None) -> DataFrame:
    """Top fonts per site over all fonts of its pages or their top ``per_page``: site, rank, family, size, weight, sample_tag (of the last page), cnt."""
    place = F.struct("page_id", "page_rank")
    sums = page_fonts(obs, per_page).groupBy("site", "family", "size", "weight").agg(
        F.sum("cnt").alias("cnt"), F.min(place).alias("first"), F.max_by("tag", place).alias("sample_tag")
    )
    ranked = top_k(sums, ["site"], [F.desc("cnt"), F.col("first")], k)
    return ranked.select(
        "site", F.col("rank").cast("bigint").alias("rank"), "family", "size", "weight", "sample_tag", "cnt"
    )


def component_counts(pages: DataFrame, links: DataFrame, shots: DataFrame) -> DataFrame:
    """Pages with forms, pages with navigation, first four screenshots per site.

    pages(page_id, url, html), links from ``extract_links``, shots(site, page_ord, screenshot).
    """
    forms = pages.select(
        urls.netloc(F.col("url")).alias("site"),
        H.visible(F.col("html")).rlike(r"(?i)<form\b").alias("has_form"),
    ).groupBy("site").agg(F.count("*").alias("pages"), F.count_if("has_form").alias("form_pages"))
    # One row per page first, so that the distinct count does not have to keep page lists.
    with_nav = links.filter("scope = 'nav'").groupBy("site", "page_id").agg(F.count("*").alias("n"))
    nav = with_nav.groupBy("site").agg(F.count("*").alias("nav_pages"))
    first = top_k(shots.filter("screenshot IS NOT NULL"), ["site"], [F.col("page_ord")], 4)
    samples = first.groupBy("site").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "screenshot"))), lambda s: s["screenshot"]), ";"
        ).alias("samples")
    )
    return forms.join(nav, "site", "left").join(samples, "site", "left").select(
        "site", "pages", "form_pages", F.coalesce("nav_pages", F.lit(0)).alias("nav_pages"),
        F.coalesce("samples", F.lit("")).alias("samples"),
    )
