"""HTML column expressions that stay in the JVM.

They are exact for markup without nested containers of one kind; the jobs route the other
pages to the parser pass in ``operators.dom``.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from html.entities import html5
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlscope.functions.arrays import bind
from crawlscope.functions.text import squeeze

# Inside of a tag, with ">" allowed between quotes; possessive, so it never backtracks.
TAG_BODY = r"(?:\"[^\"]*+\"|'[^']*+'|[^'\">]++)*+"
# Alternatives share their first character, so that most positions fail at once.
_HIDDEN = (
    r"(?is)<(?:!--.*?(?:-->|\z)|(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\z))"
)
_BLOCK_TAGS = (
    r"(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form"
    rf"|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|tbody|td|th|thead|tr|ul)\b{TAG_BODY}>"
)
_ANY_TAG = rf"<(?:/?[A-Za-z!]{TAG_BODY}>|[^>]*>)"
_CONTAINERS = "nav|header|footer|main|aside|section"
# The usual entities; &amp; comes last, so that an escaped entity is decoded once.
_ENTITIES = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&nbsp;", "\u00a0"),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
]
_OTHER_ENTITY = r"&(?!(?:lt|gt|quot|#39|apos|nbsp|copy|middot|amp);)(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"
# All named entities, from the table of the standard library that the parser pass uses too.
_NAMED = json.dumps({name[:-1]: value for name, value in html5.items() if name.endswith(";")})


# Numbers 128 to 159 mean the characters of the old Windows code page.
_LEGACY = "".join(bytes([n]).decode("cp1252", "replace") for n in range(0x80, 0xA0))


def visible(html: Column) -> Column:
    """HTML without scripts, styles and comments."""
    return F.regexp_replace(html, _HIDDEN, "")


def _decode_any(raw: Column) -> Column:
    """Decode named and numeric entities of any kind; unknown ones stay."""
    pieces = F.regexp_extract_all(
        raw, F.lit(r"(?s)&#\d{1,7};|&#[xX][0-9a-fA-F]{1,6};|&[A-Za-z][A-Za-z0-9]*;|&|[^&]+"), F.lit(0)
    )
    named = F.from_json(F.lit(_NAMED), "map<string,string>")

    def char(number: Column) -> Column:
        def of(n: Column) -> Column:
            valid = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
            return (
                F.when(n.between(0x80, 0x9F), F.substring(F.lit(_LEGACY), (n - 0x7F).cast("int"), F.lit(1)))
                .when(valid, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
                .otherwise(F.lit("\ufffd"))
            )

        return bind(number, of)

    def piece(p: Column) -> Column:
        code = F.regexp_extract(p, r"^&#[xX]?([0-9a-fA-F]+);$", 1)
        return (
            F.when(p.rlike(r"^&#\d"), char(code.try_cast("bigint")))
            .when(p.rlike(r"^&#[xX]"), char(F.conv(code, 16, 10).try_cast("bigint")))
            .when(p.rlike(r"^&[A-Za-z]"), F.coalesce(F.try_element_at(named, F.btrim(p, F.lit("&;"))), p))
            .otherwise(p)
        )

    return F.array_join(F.transform(pieces, piece), "")


def decode_entities(text: Column) -> Column:
    def decode(raw: Column) -> Column:
        usual = raw
        for entity, char in _ENTITIES:
            usual = F.replace(usual, F.lit(entity), F.lit(char))
        return (
            F.when(~raw.contains("&"), raw)
            .when(raw.rlike(_OTHER_ENTITY), _decode_any(raw))
            .otherwise(usual)
        )

    return bind(text, decode)


def text_of(fragment: Column) -> Column:
    """Text content: tags dropped, entities decoded, white space squeezed."""
    return squeeze(decode_entities(F.regexp_replace(fragment, _ANY_TAG, "")))


def inner_text(fragment: Column) -> Column:
    """Rendered text: block tags break lines, the other tags vanish."""
    lined = F.regexp_replace(fragment, r"\s+", " ")
    lined = F.regexp_replace(lined, _BLOCK_TAGS, "\n")
    lined = decode_entities(F.regexp_replace(lined, _ANY_TAG, ""))
    return F.btrim(F.regexp_replace(lined, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, empty when it is absent.

    The other attributes before it are walked one by one, so a quoted value is never looked into.
    """
    value = r"(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++)"
    other = rf"(?:[\s/]++(?!{name}[\s=/>])[^\s=>/]++(?:\s*+=\s*+{value})?+)*+"
    raw = F.regexp_extract(tag, rf"(?i)^<[a-z][^\s/>]*+{other}[\s/]++{name}\s*+=\s*+({value})", 1)
    return decode_entities(F.regexp_replace(raw, r"^[\"']|[\"']$", ""))


def tags(html: Column, name: str) -> Column:
    """All opening tags of one name."""
    return F.regexp_extract_all(html, F.lit(rf"(?i)<{name}\b{TAG_BODY}>"), F.lit(0))


def first_text(html: Column, name: str) -> Column:
    return text_of(F.regexp_extract(html, rf"(?is)<{name}\b[^>]*>(.*?)</{name}\s*>", 1))


def all_texts(html: Column, name: str) -> Column:
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*>(.*?)</{name}\s*>"), F.lit(1))
    return F.transform(found, text_of)


def first_tag(html: Column, name: str, *conditions: Callable[[Column], Column]) -> Column:
    """First opening tag of one name that meets all conditions, or null."""
    found = tags(html, name)
    if conditions:
        found = F.filter(found, lambda t: reduce(and_, [c(t) for c in conditions]))
    return F.try_element_at(found, F.lit(1))


def attr_equals(name: str, value: str) -> Callable[[Column], Column]:
    """Whether the attribute of a tag is exactly ``value``, in any case."""
    return lambda tag: F.lower(attribute(tag, name)) == value


def main_block(html: Column) -> Column:
    """Inside of the first main or article element, otherwise of the body."""

    def block(seen: Column) -> Column:
        root = F.regexp_extract(seen, r"(?is)<(main|article)\b[^>]*>(.*?)</\1\s*>", 2)
        body = F.regexp_replace(
            F.regexp_replace(seen, r"(?is)^.*?<body\b[^>]*>|^.*</head\s*>", ""), r"(?is)</body\s*>.*$", ""
        )
        return F.when(seen.rlike(r"(?i)<(?:main|article)\b"), root).otherwise(body)

    return bind(visible(html), block)


def link_tokens(html: Column) -> Column:
    """Container tags and whole anchors, in document order."""
    return F.regexp_extract_all(
        visible(html),
        F.lit(
            rf"(?is)<(?:/?(?:{_CONTAINERS})\b[^>]*>|a\b{TAG_BODY}>.*?(?=<(?:/a|a)\b|\z))"
        ),
        F.lit(0),
    )


def anchors(html: Column) -> Column:
    """ARRAY<STRUCT<href, text, parent, in_nav>> of all anchors with an href.

    One pass over the tokens with a stack of the open containers.
    """
    empty = F.struct(
        F.array().cast("array<string>").alias("stack"),
        F.array()
        .cast("array<struct<href:string,text:string,parent:string,in_nav:boolean>>")
        .alias("found"),
    )

    def step(acc: Column, token: Column) -> Column:
        def with_name(name: Column) -> Column:
            stack = acc["stack"]
            kept = F.size(stack) - F.array_position(F.reverse(stack), name)
            closed = F.when(F.array_contains(stack, name), F.slice(stack, F.lit(1), kept.cast("int"))).otherwise(stack)
            tag = F.regexp_extract(token, rf"(?is)^<a\b{TAG_BODY}>", 0)
            link = F.struct(
                attribute(tag, "href").alias("href"),
                text_of(token).alias("text"),
                F.coalesce(F.try_element_at(stack, F.lit(-1)), F.lit("BODY")).alias("parent"),
                (F.array_contains(stack, "NAV") | F.array_contains(stack, "HEADER")).alias("in_nav"),
            )
            is_link = (name == "A") & token.rlike(r"(?i)^<a\b[^>]*\shref\s*=")
            return F.struct(
                F.when(name == "A", stack)
                .when(token.startswith("</"), closed)
                .otherwise(F.concat(stack, F.array(name)))
                .alias("stack"),
                F.when(is_link, F.concat(acc["found"], F.array(link))).otherwise(acc["found"]).alias("found"),
            )

        return bind(F.upper(F.regexp_extract(token, r"^</?([A-Za-z]+)", 1)), with_name)

    return F.aggregate(link_tokens(html), empty, step, lambda acc: acc["found"])
