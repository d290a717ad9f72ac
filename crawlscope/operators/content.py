"""Page metadata, main content, structured data, images, SEO and markup checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlscope import dims
from crawlscope.functions import html as H
from crawlscope.functions import text as X
from crawlscope.functions import urls
from crawlscope.functions.arrays import bind, distinct_by
from crawlscope.operators.dom import parse_content, parse_forms

# Lists within lists that JSON-LD blocks are searched through.
LIST_LEVELS = 5  # flattened on every block; deeper lists only where they occur
MAX_NESTING = 1000  # of the JSON parser
_JSON_LD = r"(?is)<script\b[^>]*\stype\s*=\s*[\"']?application/ld\+json[^>]*>(.*?)</script\s*>"
# Pages whose content root or sections need the parser: nested or repeated roots, or sections.
_NEEDS_PARSER = (
    r"(?is)<(?:section\b|(?:main|article)\b.*<(?:main|article)\b)"
    r"|\s(?:role\s*=\s*[\"']?main|id\s*=\s*[\"']?(?:content|main)[\"'\s>]"
    r"|class\s*=\s*(?:content[\s>]|\"(?:[^\"]*\s)?content[\s\"]|'(?:[^']*\s)?content[\s']))"
)


def _meta_content(html: Column, *conditions) -> Column:
    return F.coalesce(H.attribute(H.first_tag(html, "meta", *conditions), "content"), F.lit(""))


def _with_visible(pages: DataFrame) -> DataFrame:
    """Pages plus ``h``, the HTML without scripts, styles and comments."""
    return pages.withColumn("h", H.visible(F.col("html")))


def _meta_columns() -> list[Column]:
    h = F.col("h")
    canonical = F.coalesce(H.attribute(H.first_tag(h, "link", H.attr_equals("rel", "canonical")), "href"), F.lit(""))
    return [
        H.first_text(h, "title").alias("title"),
        F.coalesce(H.attribute(H.first_tag(h, "html"), "lang"), F.lit("")).alias("lang"),
        _meta_content(h, H.attr_equals("name", "description")).alias("description"),
        bind(canonical, lambda c: F.when(c == "", c).otherwise(urls.dom_href(c, F.col("url")))).alias("canonical"),
        H.all_texts(h, "h1").alias("h1"),
        H.all_texts(h, "h2").alias("h2"),
    ]


def page_meta(pages: DataFrame) -> DataFrame:
    """pages -> page_id, site, url, title, lang, description, canonical, h1[], h2[]."""
    return _with_visible(pages).select("page_id", urls.netloc(F.col("url")).alias("site"), "url", *_meta_columns())


def _add_content(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Kept columns plus body_text and sections.

    Pages with a plain single root stay in the JVM; the others take the parser pass.
    """
    pages = pages.withColumn("html", F.coalesce("html", F.lit("")))
    # Tested on the raw text: a mere mention in a script only costs a needless parse.
    hard = F.col("html").rlike(_NEEDS_PARSER)
    parsed = parse_content(pages.filter(hard), keep)
    native = pages.filter(~hard).select(
        *keep,
        H.inner_text(H.main_block(F.col("html"))).alias("body_text"),
        F.array().cast(parsed.schema["sections"].dataType).alias("sections"),
    )
    return native.unionByName(parsed)


def extract_content(pages: DataFrame) -> DataFrame:
    """Text of the content root: page_id, site, url, body_text, word_count, sections."""
    return _add_content(pages, ["page_id", "url"]).select(
        "page_id",
        urls.netloc(F.col("url")).alias("site"),
        "url",
        "body_text",
        X.word_count(F.col("body_text")).alias("word_count"),
        "sections",
    )


def page_records(pages: DataFrame) -> DataFrame:
    """Everything the mirror needs of a page, in one pass over its HTML and without a join.

    page_id, title, lang, canonical, og, types, images, body_text, sections, word_count.
    """
    facts = _with_visible(pages).select(
        "page_id",
        "url",
        "html",
        *_meta_columns(),
        og_map(F.col("h")).alias("og"),
        F.flatten(F.transform(json_ld(F.col("html")), structured_types)).alias("types"),
        _images(F.col("h")).alias("images"),
    )
    keep = ["page_id", "title", "lang", "canonical", "og", "types", "images"]
    return _add_content(facts, keep).withColumn("word_count", X.word_count(F.col("body_text")))


def _images(h: Column) -> Column:
    """First image of each address, in order: ARRAY<STRUCT<ord, src, alt, width, height, loading>>."""

    def optional(tag: Column, name: str) -> Column:
        return F.nullif(H.attribute(tag, name), F.lit(""))

    found = F.transform(
        H.tags(h, "img"),
        lambda t, i: F.struct(
            i.cast("bigint").alias("ord"),
            bind(
                H.attribute(t, "src"), lambda src: F.when(src != "", urls.dom_href(src, F.col("url")))
            ).alias("src"),
            optional(t, "alt").alias("alt"),
            optional(t, "width").try_cast("bigint").alias("width"),
            optional(t, "height").try_cast("bigint").alias("height"),
            optional(t, "loading").alias("loading"),
        ),
    )
    return distinct_by(F.filter(found, lambda i: i["src"].isNotNull()), lambda i: i["src"])


def extract_images(pages: DataFrame) -> DataFrame:
    """Images per page, distinct by address: site, page_id, ord, src, alt, width, height, loading.

    The distinct runs inside the page row, so nothing is shuffled.
    """
    return (
        _with_visible(pages)
        .select(urls.netloc(F.col("url")).alias("site"), "page_id", F.explode(_images(F.col("h"))).alias("i"))
        .select("site", "page_id", "i.*")
    )


def og_map(html: Column) -> Column:
    """MAP of og: properties in order of their first mention; the last value of a name wins."""
    metas = F.filter(
        H.tags(html, "meta"),
        lambda t: F.lower(H.attribute(t, "property")).startswith("og:") | F.lower(H.attribute(t, "name")).startswith("og:"),
    )
    pairs = F.transform(
        metas,
        lambda t: F.struct(
            F.coalesce(
                F.nullif(H.attribute(t, "property"), F.lit("")), H.attribute(t, "name")
            ).alias("key"),
            H.attribute(t, "content").alias("value"),
        ),
    )
    def last_wins(ps: Column) -> Column:
        keys = F.array_distinct(F.transform(ps, lambda p: p["key"]))
        values = F.transform(keys, lambda k: F.element_at(F.filter(ps, lambda p: p["key"] == k), -1)["value"])
        return F.map_from_arrays(keys, values)

    return bind(pairs, last_wins)


def json_ld(html: Column) -> Column:
    """ARRAY<STRING> of the JSON-LD blocks that parse to something; the others drop."""
    blocks = F.regexp_extract_all(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), F.lit(_JSON_LD), F.lit(1))
    return F.filter(
        F.transform(blocks, F.trim),
        lambda b: ~F.coalesce(F.to_json(F.try_parse_json(b)), F.lit("null")).isin("null", "false", "0", '""'),
    )


def extract_structured(pages: DataFrame) -> DataFrame:
    """page_id, site, url, json_ld ARRAY<STRING>, og MAP<STRING,STRING>."""
    return pages.select(
        "page_id",
        urls.netloc(F.col("url")).alias("site"),
        "url",
        json_ld(F.col("html")).alias("json_ld"),
        og_map(H.visible(F.col("html"))).alias("og"),
    )


def structured_types(block: Column) -> Column:
    """Types named by one JSON-LD block: nested lists flatten, masked, ``Unknown`` if absent."""

    def of_item(item: Column) -> Column:
        kind = F.get_json_object(item, "$['@type']")
        many = F.from_json(kind, "array<string>")
        is_object = F.ltrim(item).startswith("{")
        named = F.when(kind.isNull(), F.array(F.lit("Unknown"))).when(
            F.ltrim(kind).startswith("["), many
        ).otherwise(F.array(kind))
        return F.when(is_object, named).otherwise(F.array(F.lit("Unknown")))

    def flat(item: Column) -> Column:
        return F.when(F.ltrim(item).startswith("["), F.from_json(item, "array<string>")).otherwise(F.array(item))

    def step(items: Column) -> Column:
        return F.flatten(F.transform(items, flat))

    def deeper(items: Column) -> Column:
        # Lists nest at most as deep as the block has brackets; the parser itself ends at MAX_NESTING.
        levels = F.least(F.length(F.regexp_replace(block, r"[^\[]", "")), F.lit(MAX_NESTING))
        rest = F.aggregate(F.array_repeat(F.lit(0), levels), items, lambda now, _: step(now))
        return F.when(F.exists(items, lambda i: F.ltrim(i).startswith("[")), rest).otherwise(items)

    items = F.array(block)
    for _ in range(LIST_LEVELS):
        items = step(items)
    return bind(items, lambda i: F.transform(F.flatten(F.transform(deeper(i), of_item)), X.mask_pii))


def page_types(structured: DataFrame) -> DataFrame:
    """Rows page_id, ord, type of all JSON-LD blocks of a page."""
    types = F.flatten(F.transform("json_ld", structured_types))
    return structured.select("page_id", F.posexplode(types).alias("ord", "type")).withColumn(
        "ord", F.col("ord").cast("bigint")
    )


def extract_forms(pages: DataFrame) -> DataFrame:
    """page_id, site, url, forms ARRAY<STRUCT<action, method, fields>>; only pages with a form are parsed."""
    with_form = pages.filter(F.col("html").rlike(r"(?i)<form\b"))
    return parse_forms(with_form).select(
        "page_id",
        urls.netloc(F.col("url")).alias("site"),
        "url",
        F.transform(
            "forms",
            lambda f: F.struct(
                urls.dom_href(f["action"], F.col("url")).alias("action"),
                f["method"].alias("method"),
                f["fields"].alias("fields"),
            ),
        ).alias("forms"),
    )


def form_fields(forms: DataFrame) -> DataFrame:
    """One row per form field: page_id, site, form_ord, action, method, field_ord, name, type, …"""
    per_form = forms.select("page_id", "site", F.posexplode("forms").alias("form_ord", "form"))
    return per_form.select(
        "page_id",
        "site",
        F.col("form_ord").cast("bigint").alias("form_ord"),
        "form.action",
        "form.method",
        F.posexplode("form.fields").alias("field_ord", "field"),
    ).select(
        "page_id", "site", "form_ord", "action", "method", F.col("field_ord").cast("bigint").alias("field_ord"),
        "field.*",
    )


def field_inventory(fields: DataFrame) -> DataFrame:
    """Fields per site and type: how many, required, labelled and on how many pages."""
    return fields.groupBy("site", "type").agg(
        F.count("*").alias("fields"),
        F.count_if("required").alias("required"),
        F.count_if("labelled").alias("labelled"),
        F.count_distinct("page_id").alias("pages"),
    )


def seo_audit(pages: DataFrame) -> DataFrame:
    """One row per page with a flag per SEO rule and the number of issues."""
    seen = pages.select("page_id", "url", H.visible(F.col("html")).alias("h"))
    h = F.col("h")
    facts = seen.select(
        "page_id",
        urls.netloc(F.col("url")).alias("site"),
        H.first_text(h, "title").alias("title"),
        H.first_text(h, "h1").alias("h1"),
        _meta_content(h, H.attr_equals("name", "description")).alias("description"),
        og_map(h).alias("og"),
        H.first_tag(h, "link", H.attr_equals("rel", "canonical")).isNotNull().alias("canonical"),
    )

    def no_og(name: str) -> Column:
        return F.coalesce(F.try_element_at("og", F.lit(name)), F.lit("")) == ""

    flags = {
        "title_missing": F.col("title") == "",
        "description_missing": F.col("description") == "",
        "h1_missing": F.col("h1") == "",
        "h1_differs": (F.col("h1") != "") & (F.col("h1") != F.col("title")),
        "og_title_missing": no_og("og:title"),
        "og_image_missing": no_og("og:image"),
        "og_description_missing": no_og("og:description"),
        "canonical_missing": ~F.col("canonical"),
    }
    flagged = facts.select("page_id", "site", *[c.alias(name) for name, c in flags.items()])
    total = sum(F.col(name).cast("bigint") for name in flags)
    return flagged.withColumn("issues", total)


def seo_rollup(audit: DataFrame) -> DataFrame:
    """Pages per site that break each rule."""
    flags = [c for c in audit.columns if c not in ("page_id", "site", "issues")]
    return audit.groupBy("site").agg(
        F.count("*").alias("pages"),
        F.count_if(F.col("issues") == 0).alias("clean_pages"),
        *[F.count_if(c).alias(c) for c in flags],
    )


def markup_checks(pages: DataFrame) -> DataFrame:
    """Per page: semantic elements, alt texts (none/present/partial/missing) and form labels."""
    seen = pages.select("page_id", "url", H.visible(F.col("html")).alias("h"))
    h = F.col("h")
    images = H.tags(h, "img")
    images_n = F.size(images)
    alts = F.size(F.filter(images, lambda t: H.attribute(t, "alt") != ""))
    semantic = {
        f"has_{tag}": h.rlike(rf"(?i)<{tag}\b") for tag in ("header", "nav", "main", "footer")
    }
    return seen.select(
        "page_id",
        urls.netloc(F.col("url")).alias("site"),
        *[c.alias(name) for name, c in semantic.items()],
        images_n.cast("bigint").alias("images"),
        alts.cast("bigint").alias("images_with_alt"),
        F.when(images_n == 0, F.lit("none"))
        .when(alts == images_n, F.lit("present"))
        .when(alts == 0, F.lit("missing"))
        .otherwise(F.lit("partial"))
        .alias("alt_state"),
        h.rlike(r"(?i)<form\b").alias("has_form"),
        h.rlike(r"(?i)<label\b").alias("has_label"),
    )


def markup_rollup(checks: DataFrame) -> DataFrame:
    return checks.groupBy("site").agg(
        F.count("*").alias("pages"),
        *[F.count_if(f"has_{t}").alias(f"{t}_pages") for t in ("header", "nav", "main", "footer")],
        F.sum("images").alias("images"),
        F.sum("images_with_alt").alias("images_with_alt"),
        F.count_if(F.col("has_form") & ~F.col("has_label")).alias("unlabelled_form_pages"),
    )


def content_stats(texts: DataFrame, key: list[str]) -> DataFrame:
    """Words and reading minutes per text: keys, words, minutes."""
    words = X.word_count(F.col("text"))
    return texts.select(*key, words.alias("words"), X.reading_minutes(words).alias("minutes"))


def mask_texts(texts: DataFrame, key: list[str]) -> DataFrame:
    """Masked text and hits by kind, each counted on what the earlier rewrites left behind."""
    rules = dims.PII_RULES
    # One column per step, so that every pattern runs once for its count and once for its rewrite.
    staged = texts.select(*key, F.col("text").alias("_t0"))
    for i, rule in enumerate(rules):
        staged = staged.withColumn(f"_t{i + 1}", X.mask_step(F.col(f"_t{i}"), rule))
    hits = [X.hit_count(F.col(f"_t{i}"), rule).alias(f"{rule[0]}_hits") for i, rule in enumerate(rules)]
    return staged.select(*key, F.col(f"_t{len(rules)}").alias("masked"), *hits)
