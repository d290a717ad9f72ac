"""The parser pass for markup that expressions cannot follow: one ``mapInArrow`` over pages.

A small helper lists the elements of interest of each page with the parser of the standard
library. Selectors, closest containers, sections and forms are expressions over that list.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from crawlscope import dims
from crawlscope.functions import elements, urls
from crawlscope.functions.text import squeeze

# Ship the helper with the task: executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(elements)

NODE = T.StructType(
    [
        T.StructField("idx", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("up", T.ArrayType(T.IntegerType())),
        T.StructField("text", T.StringType()),
    ]
)
def parse_nodes(pages: DataFrame, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """Add ``nodes`` to the kept columns of pages(html, ...). Kept columns pass through as they are."""
    keep = list(keep)
    nodes_type = T.ArrayType(NODE)
    schema = T.StructType([pages.schema[name] for name in keep] + [T.StructField("nodes", nodes_type)])
    arrow_type = to_arrow_type(nodes_type)
    of_page, pieces = elements.of_page, elements.pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The list of elements is many times the size of the page, so a batch is taken in pieces.
        for batch in pieces(batches):
            nodes = pa.array([of_page(html) for html in batch.column("html").to_pylist()], type=arrow_type)
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in keep), nodes], [*keep, "nodes"])

    return pages.select(*keep, "html").mapInArrow(run, schema)


def plain_text(node_text: Column) -> Column:
    """Text content: block edges vanish, white space squeezed."""
    return squeeze(F.replace(node_text, F.lit("\n"), F.lit("")))


def rendered_text(node_text: Column) -> Column:
    """Rendered text: one line per block."""
    squeezed = F.regexp_replace(node_text, r"[ \t\r\f ]+", " ")
    return F.btrim(F.regexp_replace(squeezed, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def _attr(node: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(node["attrs"], F.lit(name)), F.lit(""))


def _at(idx: Column) -> Column:
    return F.element_at(F.col("nodes"), idx + 1)


def _ancestors(node: Column, *tags: str) -> Column:
    return F.filter(node["up"], lambda i: _at(i)["tag"].isin(*tags))


def _inside(idx: Column, *tags: str) -> Column:
    return F.filter(
        F.col("nodes"), lambda n: n["tag"].isin(*tags) & F.array_contains(n["up"], idx)
    )


def _image(node: Column) -> Column:
    def blank_to_null(name: str) -> Column:
        return F.nullif(_attr(node, name), F.lit(""))

    return F.struct(
        F.when(_attr(node, "src") != "", urls.dom_href(_attr(node, "src"), F.col("url"))).otherwise(F.lit("")).alias("src"),
        blank_to_null("alt").alias("alt"),
        blank_to_null("width").try_cast("bigint").alias("width"),
        blank_to_null("height").try_cast("bigint").alias("height"),
        blank_to_null("loading").alias("loading"),
    )


def _links() -> Column:
    hits = F.filter("nodes", lambda n: (n["tag"] == "a") & F.map_contains_key(n["attrs"], "href"))

    def link(node: Column) -> Column:
        closest = F.try_element_at(
            _ancestors(node, "nav", "header", "footer", "main", "aside", "section"), F.lit(-1)
        )
        in_nav = F.exists(
            node["up"],
            lambda i: _at(i)["tag"].isin("nav", "header") | (_attr(_at(i), "role") == "navigation"),
        )
        return F.struct(
            _attr(node, "href").alias("href"),
            plain_text(node["text"]).alias("text"),
            F.coalesce(F.upper(_at(closest)["tag"]), F.lit("BODY")).alias("parent"),
            in_nav.alias("in_nav"),
        )

    return F.transform(hits, link)


def _root_idx() -> Column:
    """First main, article, role=main, .content, #content or #main; otherwise the body."""
    def is_root(node: Column) -> Column:
        return (
            node["tag"].isin("main", "article")
            | (_attr(node, "role") == "main")
            | F.array_contains(F.split(_attr(node, "class"), r"\s+"), "content")
            | _attr(node, "id").isin("content", "main")
        )

    return F.coalesce(F.try_element_at(F.filter("nodes", is_root), F.lit(1))["idx"], F.lit(0))


def _sections() -> Column:
    def is_section(node: Column) -> Column:
        return (
            node["tag"].isin("section", "article")
            & F.array_contains(node["up"], F.col("root_idx"))
            & (F.size(_ancestors(node, "nav", "header", "footer")) == 0)
        )

    def section(node: Column) -> Column:
        heading = F.try_element_at(_inside(node["idx"], "h1", "h2", "h3", "h4"), F.lit(1))
        return F.struct(
            F.nullif(_attr(node, "id"), F.lit("")).alias("id"),
            F.nullif(plain_text(heading["text"]), F.lit("")).alias("heading"),
            rendered_text(node["text"]).alias("text"),
            F.transform(_inside(node["idx"], "img"), _image).alias("images"),
        )

    return F.transform(F.filter("nodes", is_section), section)


def _forms() -> Column:
    def field(node: Column) -> Column:
        field_id = _attr(node, "id")
        own = F.lower(_attr(node, "type"))
        kind = (
            F.when(
                node["tag"] == "select",
                F.when(F.map_contains_key(node["attrs"], "multiple"), F.lit("select-multiple")).otherwise(F.lit("select-one")),
            )
            .when(node["tag"] == "textarea", F.lit("textarea"))
            .when(own.isin(*dims.INPUT_TYPES), own)
            .otherwise(F.lit("text"))
        )
        labelled = (F.size(_ancestors(node, "label")) > 0) | F.exists(
            "nodes", lambda n: (n["tag"] == "label") & (field_id != "") & (_attr(n, "for") == field_id)
        )
        return F.struct(
            F.coalesce(F.nullif(_attr(node, "name"), F.lit("")), field_id).alias("name"),
            kind.alias("type"),
            F.map_contains_key(node["attrs"], "required").alias("required"),
            _attr(node, "placeholder").alias("placeholder"),
            labelled.alias("labelled"),
        )

    def form(node: Column) -> Column:
        method = F.upper(_attr(node, "method"))
        return F.struct(
            _attr(node, "action").alias("action"),
            F.when(method.isin("GET", "POST", "DIALOG"), method).otherwise(F.lit("GET")).alias("method"),
            F.transform(_inside(node["idx"], "input", "select", "textarea"), field).alias("fields"),
        )

    return F.transform(F.filter("nodes", lambda n: n["tag"] == "form"), form)


def parse_links(pages: DataFrame) -> DataFrame:
    return parse_nodes(pages).select("page_id", "url", _links().alias("links"))


def parse_forms(pages: DataFrame) -> DataFrame:
    return parse_nodes(pages).select("page_id", "url", _forms().alias("forms"))


def parse_content(pages: DataFrame, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """Kept columns plus body_text and sections of the content root."""
    # The address of the page makes those of its images absolute.
    rooted = parse_nodes(pages, list(dict.fromkeys([*keep, "url"]))).withColumn("root_idx", _root_idx())
    return rooted.select(
        *keep,
        rendered_text(_at(F.col("root_idx"))["text"]).alias("body_text"),
        _sections().alias("sections"),
    )
