"""Text column expressions: masking, previews, counts, colours, JSON quoting."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlscope import dims
from crawlscope.functions.arrays import bind


def _if_needed(kind: str, text: Column, work: Column, otherwise: Column) -> Column:
    need = dims.PII_NEEDS.get(kind)
    return F.when(text.contains(need), work).otherwise(otherwise) if need else work


def mask_step(text: Column, rule: tuple[str, str, str]) -> Column:
    """One of the ordered rewrites; ``text`` should be a plain column, it occurs twice."""
    kind, pattern, replacement = rule
    return _if_needed(kind, text, F.regexp_replace(text, pattern, replacement), text)


def hit_count(text: Column, rule: tuple[str, str, str]) -> Column:
    kind, pattern, _ = rule
    hits = F.regexp_count(text, F.lit(pattern)).cast("bigint")
    return _if_needed(kind, text, hits, F.lit(0).cast("bigint"))


def mask_pii(text: Column) -> Column:
    """Mask e-mail, phone, resident and card numbers, secrets and bearer tokens, in this order."""
    for rule in dims.PII_RULES:
        text = bind(text, partial(mask_step, rule=rule)) if rule[0] in dims.PII_NEEDS else mask_step(text, rule)
    return text


def preview(text: Column, limit: int = dims.PREVIEW_CHARS) -> Column:
    """Masked text, cut after masking."""
    return bind(
        mask_pii(text),
        lambda masked: F.when(
            F.length(masked) > limit, F.concat(F.left(masked, F.lit(limit)), F.lit(dims.PREVIEW_SUFFIX))
        ).otherwise(masked),
    )


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank, outer blanks go."""
    return F.trim(F.regexp_replace(text, r"[\s\u00A0]+", " "))


def strip(text: Column) -> Column:
    """Without outer white space of any kind."""
    return F.btrim(text, F.lit(" \n\t\r\f\u000b\u00a0"))


def word_count(text: Column) -> Column:
    """Number of runs of non-blank characters."""
    return F.regexp_count(text, F.lit(r"(?U)\S+")).cast("bigint")


def reading_minutes(words: Column) -> Column:
    per_minute = dims.WORDS_PER_MINUTE
    return F.greatest(F.lit(1), F.ceil(words / per_minute)).cast("bigint")


def rgb_to_hex(value: Column) -> Column:
    pattern = r"^rgba?\((\d+),\s*(\d+),\s*(\d+)"
    channel = [F.regexp_extract(value, pattern, i).try_cast("int") for i in (1, 2, 3)]
    return F.when(
        value.rlike(pattern), F.format_string("#%02X%02X%02X", *channel)
    ).otherwise(value)


def json_string(text: Column) -> Column:
    """The text as a quoted JSON string."""
    quoted = F.to_json(F.struct(text.alias("v")))
    return F.substring(quoted, F.lit(6), F.length(quoted) - 6)

