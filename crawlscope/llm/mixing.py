"""Mixing sources to target weights by systematic sampling.

Each source has a target in words. A document's expected number of copies is its source's target over
the source's size; a prefix sum of the expected copies inside the source, plus one random offset per
source, crosses an integer boundary once per copy. Documents are taken in order of their size, so the
words a source gives differ from its target by less than its largest document.

Defined cases: null texts have size 0; a null source is a source of its own and comes last; documents of
size 0 may be copied without counting; rows that are equal in every column are separate documents; null
ids are an id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlscope.llm.common import prefix_sums, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)  # by code point order of the source, repeating
MOST = 2  # times a source's size


def size_of(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _row_hash() -> F.Column:
    return F.xxhash64("text", "source")


def source_targets(units: DataFrame, share: float, weights: Sequence[int] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from ``units`` (source, size, n).

    Targets are in proportion to the weights, sum to ``share`` of all words and stop at ``most`` times
    the source's size: the least of that and rate * weight, where the rate is raised until no source
    is above. Each round is one aggregate of the table of sources, from which four numbers come back.
    """
    sums = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sums = sums.withColumn("last", F.col("source").isNull()).withColumn("one", F.lit(1))
    ranked = prefix_sums(sums, [], ["last", "source"], "one", "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = stored(ranked.select("source", "source_size", weight.cast("double").alias("weight")), "mix-sources")
    cap = F.col("source_size") * float(most)
    total = share * float(rows.agg(F.sum("source_size")).first()[0] or 0)
    rate, capped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(rate) >= cap
        held, free, n = rows.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)), F.count_if(full)
        ).first()
        if n == capped or free <= 0:
            break
        rate, capped = max(rate, (total - held) / free), n
    return rows.select("source", "source_size", F.least(cap, F.col("weight") * F.lit(rate)).alias("target"))


def copies_plan(docs: DataFrame, share: float, seed: int, weights: Sequence[int] = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row per different (doc_id, source, text) with all that decides the copies of its ``n`` rows.

    Texts do not move: only ids, sizes and hashes are shuffled. A source that holds a third of all
    rows spans many range parts.
    """
    units = stored(
        docs.select("doc_id", "source", size_of().alias("size"), _row_hash().alias("row_hash"))
        .groupBy("doc_id", "source", "size", "row_hash")
        .agg(F.count("*").alias("n")),
        "mix-units",
    )
    targets = source_targets(units, share, weights, most)
    placed = prefix_sums(units, ["source"], ["size", "doc_id", "row_hash"], "n", "rank")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # A multiple of 2 ** -20, so that adding it to whole numbers is exact.
    offset = F.pmod(F.xxhash64(F.coalesce("u.source", F.lit("\0")), F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return placed.alias("u").join(targets.alias("t"), F.col("u.source").eqNullSafe(F.col("t.source"))).select(
        "u.*", "source_size", "target", rate.alias("rate"), offset.alias("offset")
    )


def _copies(row: F.Column, rate: F.Column, offset: F.Column, most: float) -> F.Column:
    """Integer boundaries that the row with this number in its source crosses."""
    up_to = lambda k: F.floor(k * rate + offset)
    return F.least(up_to(row + 1) - up_to(row), F.lit(int(most)).cast("long"))


def mix_report(docs: DataFrame, share: float = 1.5, seed: int = 17, most: float = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row of ``docs``."""
    plan = copies_plan(docs, share, seed, most=most)
    rows = plan.withColumn("twin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    taken = F.col("size") * _copies(F.col("rank") + F.col("twin"), F.col("rate"), F.col("offset"), most)
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, share: float = 1.5, seed: int = 17, most: float = MOST) -> DataFrame:
    """The rows of the mix: each document as often as it is taken, with all its columns."""
    plan = copies_plan(docs, share, seed, most=most).select("doc_id", "source", "row_hash", "rank", "rate", "offset")
    keys = ["doc_id", "source", "_row_hash"]
    rows = docs.withColumn("_row_hash", _row_hash())
    plan = plan.withColumnRenamed("row_hash", "_row_hash")
    twin = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))) - 1
    joined = rows.alias("d").join(plan.alias("p"), [F.col(f"d.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys])
    joined = joined.select("d.*", F.struct("p.rank", "p.rate", "p.offset").alias("_plan")).withColumn("_twin", twin)
    copies = _copies(F.col("_plan.rank") + F.col("_twin"), F.col("_plan.rate"), F.col("_plan.offset"), most)
    taken = joined.withColumn("_copies", copies).filter("_copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*docs.columns)
