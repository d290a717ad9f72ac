"""Content mirror: one Markdown text per page, and the flat site export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlscope import dims
from crawlscope.functions import text as X
from crawlscope.functions import urls
from crawlscope.functions.arrays import bind
from crawlscope.operators.common import first_seen


def _mask(name: str) -> Column:
    return X.mask_pii(F.coalesce(name, F.lit("")))


def _frontmatter() -> Column:
    def line(key: str, value: Column) -> Column:
        return F.concat(F.lit(f"{key}: "), value)

    def quoted(value: Column) -> Column:
        return X.json_string(X.mask_pii(value))

    def listed(items: Column, marks: str) -> Column:
        return F.concat(F.lit(marks[0]), F.array_join(items, ", "), F.lit(marks[1]))

    og = F.transform(
        F.map_entries(F.coalesce("og", F.create_map().cast("map<string,string>"))),
        lambda e: F.concat(X.json_string(e["key"]), F.lit(": "), quoted(F.coalesce(e["value"], F.lit("")))),
    )
    types = F.transform(F.coalesce("types", F.array().cast("array<string>")), X.json_string)
    words = F.coalesce("word_count", F.lit(0).cast("bigint"))
    return F.concat_ws(
        "\n",
        F.lit("---"),
        line("url", quoted(F.col("url"))),
        line("title", quoted(F.col("title"))),
        line("depth", F.col("depth").cast("string")),
        line("status", F.coalesce(F.col("status").cast("string"), F.lit('"unknown"'))),
        line("canonical", quoted(F.when(F.coalesce("canonical", F.lit("")) == "", F.col("url")).otherwise(F.col("canonical")))),
        line("lang", quoted(F.coalesce("lang", F.lit("")))),
        line("og", listed(og, "{}")),
        line("structured_data", listed(types, "[]")),
        line("screenshot", quoted(F.coalesce("screenshot", F.lit("")))),
        line("screenshot_mobile", quoted(F.coalesce("screenshot_mobile", F.lit("")))),
        line("crawled_at", quoted(F.coalesce("crawled_at", F.lit("")))),
        line("word_count", words.cast("string")),
        line("reading_time", X.reading_minutes(words).cast("string")),
        F.lit("---"),
    )


def _body() -> Column:
    def section(s: Column) -> Column:
        def lines(heading: Column, text: Column) -> Column:
            return F.when(heading != "", X.strip(F.concat(F.lit("## "), heading, F.lit("\n"), text))).when(
                text != "", text
            )

        def clean(name: str) -> Column:
            return X.strip(X.mask_pii(F.coalesce(s[name], F.lit(""))))

        return bind(clean("heading"), lambda heading: bind(clean("text"), lambda text: lines(heading, text)))

    sections = F.array_compact(F.transform("sections", section))
    main = F.when(F.size(sections) > 0, F.array_join(sections, "\n\n")).otherwise(X.strip(_mask("body_text")))

    def image_row(i: Column) -> Column:
        return F.concat(
            F.lit("| "), X.mask_pii(F.coalesce(i["src"], F.lit(""))), F.lit(" | "), X.mask_pii(F.coalesce(i["alt"], F.lit(""))),
            F.lit(" | "), F.coalesce(i["width"].cast("string"), F.lit("")), F.lit(" | "),
            F.coalesce(i["height"].cast("string"), F.lit("")), F.lit(" |"),
        )

    shown = F.transform(F.slice("images", 1, dims.MIRROR_IMAGES), image_row)
    table = F.concat(
        F.lit(f"## {dims.MIRROR_IMAGES_HEADING}\n| src | alt | width | height |\n|-----|-----|-------|--------|\n"), F.array_join(shown, "\n")
    )
    parts = F.array(
        F.concat(F.lit("# "), _mask("title")),
        F.nullif(main, F.lit("")),
        F.when(F.size("images") > 0, table),
    )
    return F.array_join(F.array_compact(parts), "\n\n")


def render_markdown() -> Column:
    """Markdown of a page: frontmatter of fixed keys, title, sections or text, image table.

    Needs url, title, depth, status, canonical, lang, og, types, screenshot, screenshot_mobile,
    crawled_at, word_count, body_text, sections and images. Everything from the page is masked,
    the og values too.
    """
    return F.concat(_frontmatter(), F.lit("\n\n"), _body(), F.lit("\n"))


def content_mirror(content: DataFrame) -> DataFrame:
    """site, url, content_path, markdown: a table to be written by partition, never file by file."""
    return content.select("site", "url", "content_path", render_markdown().alias("markdown"))


def flat_export(
    pages: DataFrame, nav: DataFrame, assets: DataFrame, palette_rows: DataFrame, graph: DataFrame
) -> DataFrame:
    """Long form of the flat site export: site, part, ord, value.

    Parts: page, nav, script, style, color, edge. Lists stay rows, so a huge site is never
    folded into one cell. pages(site, page_ord, url, title): each further field of a page that
    ``pages`` carries (depth, status, screenshot, screenshot_mobile) is a part of its own, page_<field>.
    """

    def part(name: str, df: DataFrame, ord_: Column, value: Column) -> DataFrame:
        return df.select("site", F.lit(name).alias("part"), ord_.alias("ord"), value.alias("value"))

    def place(*names: str) -> Column:
        return F.array(*[F.col(n).cast("bigint") for n in names])

    first_nav = nav.groupBy("site", "href").agg(
        F.min(F.array("page_id", "link_ord")).alias("ord"), F.min_by("text", F.array("page_id", "link_ord")).alias("text")
    )
    out = part("page", pages, place("page_ord"), F.concat_ws(" ", "url", "title"))
    for name in ("depth", "status", "screenshot", "screenshot_mobile"):
        if name in pages.columns:
            out = out.unionByName(part(f"page_{name}", pages, place("page_ord"), F.col(name).cast("string")))
    out = out.unionByName(part("nav", first_nav, F.col("ord"), F.concat_ws(" ", "href", "text")))
    out = out.unionByName(
        assets.select("site", F.col("kind").alias("part"), place("first_page").alias("ord"), F.col("src").alias("value"))
    )
    out = out.unionByName(part("color", palette_rows, place("rank"), F.col("value")))
    return out.unionByName(part("edge", graph, place("page_id", "link_ord"), F.concat_ws(" ", "src", "dst", "parent")))


def home_heads(pages: DataFrame) -> DataFrame:
    """Inside of the head element of each site's first page: site, page_ord, head."""
    head = F.regexp_extract("html", r"(?is)<head\b[^>]*>(.*?)</head\s*>", 1)
    slim = pages.select(urls.netloc(F.col("url")).alias("site"), F.col("page_id").alias("page_ord"), head.alias("head"))
    # Each task keeps one head per site before anything is shuffled.
    return first_seen(slim, ["site"], ["page_ord"])


def crawl_summary(
    plan: DataFrame, assets: DataFrame, discovered: DataFrame, mirror: DataFrame
) -> DataFrame:
    """Counts per site: visited, scripts, styles, screenshots, blocked, discovered, mirrored, errors.

    plan(site, url, status), assets(site, kind, src), discovered(site, url), mirror(site, url, ok).
    Distinct pairs are folded before they are counted per site.
    """
    visits = plan.groupBy("site").agg(
        F.count_if(F.col("status") == "ok").alias("visited_pages"),
        (F.count_if(F.col("status") == "ok") * 2).alias("screenshots"),
        F.count_if(F.col("status") == "blocked").alias("robots_blocked"),
        F.count_if(F.col("status") == "failed").alias("failed_pages"),
    )
    files = assets.select("site", "kind", "src").distinct().groupBy("site").agg(
        F.count_if(F.col("kind") == "script").alias("unique_scripts"), F.count_if(F.col("kind") == "style").alias("unique_styles")
    )
    found = discovered.select("site", "url").distinct().groupBy("site").agg(F.count("*").alias("discovered_urls"))
    mirrored = mirror.groupBy("site").agg(
        F.count_if("ok").alias("content_mirrored"), F.count_if(~F.col("ok")).alias("content_errors")
    )
    joined = visits.join(files, "site", "left").join(found, "site", "left").join(mirrored, "site", "left")
    return joined.na.fill(0)


def daily_sketches(seen: DataFrame, bits: int = 14) -> DataFrame:
    """seen(site, day, kind, value) -> site, day, kind, sketch: a HyperLogLog sketch of the distinct values.

    Sketches have a bounded size, 2^bits cells at most, and can be stored and united later, where exact counts would
    have to read all values again.
    """
    return seen.groupBy("site", "day", "kind").agg(F.hll_sketch_agg("value", bits).alias("sketch"))


def united_counts(sketches: DataFrame, *keys: str) -> DataFrame:
    """Estimated distinct values of the united sketches: keys (site and kind by default), distinct."""
    keys = keys or ("site", "kind")
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))


def page_inventory(pages: DataFrame) -> DataFrame:
    """site, depth, url, title, description, h1 sorted by site, depth and URL."""
    return pages.select("site", "depth", "url", "title", "description", "h1").orderBy("site", "depth", "url")

