"""Group-wise building blocks that hold when one group owns a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlscope.session import cut_lineage

# A group above this size is split; so there are at most rows / HOT_GROUP such groups.
HOT_GROUP = 1_000_000
# Groups beyond this number stay unsplit, which changes no result; it bounds the broadcast list of keys.
MOST_HOT = 100_000


def place(major: Column, minor: Column, width: int) -> Column:
    """(major, minor) as one sortable number, for ``minor`` below ``width``.

    The minimum of a number stays in hash aggregation; that of a struct needs a sort.
    """
    whole = "decimal(38,0)"
    return (major.cast("decimal(20,0)") * F.lit(width).cast("decimal(17,0)")).cast(whole) + minor.cast("decimal(20,0)")


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int | None, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group, or all of them ranked. Spark cuts each task's share to ``k`` before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(window))
    return ranked if k is None else ranked.filter(F.col(rank) <= k)


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row by ``order`` for each key; an aggregate, so hot keys shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(picked).select(*keys, "_first.*").select(*df.columns)


def attach_group(
    rows: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    size: str,
    spread_by: Sequence[str],
    how: str = "inner",
    hot: int = HOT_GROUP,
) -> DataFrame:
    """Join per-group columns back to the rows, splitting groups of more than ``hot`` rows.

    ``groups`` has one row per key and the row count of the group in ``size``. Rows of a hot
    group go to ``ceil(size / hot)`` salts by a hash of ``spread_by``, and the group's row is
    copied once per salt. The broadcast list holds the ``MOST_HOT`` largest hot groups.
    """
    keys = list(keys)
    salts = F.ceil(F.col(size) / F.lit(hot)).cast("int")
    hot_keys = groups.filter(F.col(size) > hot).orderBy(F.desc(size)).limit(MOST_HOT).select(*keys, salts.alias("_salts"))
    salted = rows.join(F.broadcast(hot_keys), keys, "left").withColumn(
        "_salt",
        F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(*spread_by), F.col("_salts")).cast("int")
        ),
    )
    copies = groups.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1))
    )
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt", "_salts")


def numbered(df: DataFrame, group: Sequence[str], order: str, out: str) -> DataFrame:
    """1-based number per group in the order of a unique column, however its values are spread."""
    return numbered_by_range(df, group, [order], out)


def numbered_by_range(
    df: DataFrame, group: Sequence[str], order: Sequence[str], out: str, parts: int | None = None, weight: str | None = None
) -> DataFrame:
    """1-based number per group in the order of any sortable columns, or the running total of ``weight`` up to each row.

    The rows are range-partitioned by (group, order), so a big group spans several parts. The
    part numbers are pinned by a checkpoint, because a recomputed range split may differ.
    """
    group, order = list(group), list(order)
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(
        df.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id())
    )
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        placed.groupBy(*group, "_part")
        .agg((F.count("*") if weight is None else F.sum(weight)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*group, "_part").orderBy(*order)
    up_to = F.row_number() if weight is None else F.sum(weight)
    return (
        placed.withColumn("_inside", up_to.over(inside if weight is None else inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(sizes, [*group, "_part"])
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_part", "_inside", "_before")
    )
