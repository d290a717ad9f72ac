"""Spark building blocks of the operators: own columns, stored steps, prefix sums, graph components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlscope.session import cut_lineage, shared_dir


BATCH_BYTES, MOST_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that they need no installed copy, and
    lower the session's bound of Arrow batches to ``MOST_BATCH`` bytes."""
    # Batches of texts by bytes: rows alone do not bound what a task and its Python worker hold.
    if int(spark.conf.get(BATCH_BYTES).rstrip("b")) > MOST_BATCH:
        spark.conf.set(BATCH_BYTES, MOST_BATCH)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(os.path.realpath(tempfile.mkdtemp(prefix="crawlscope-"))) / "crawlscope.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder the cluster names in spark.checkpoint.dir."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back, so a lost executor costs no recomputation."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str, modulus: int, remainder: int) -> F.Column:
    """Rows that a fit must not see: crc32 of the id as text has this remainder; never null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def prefix_sums(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the group, in the given order.

    Rows are range-partitioned by group and order, so that a large group spans many tasks; the parts'
    sums make the starting points. Part numbers are pinned by a checkpoint. Rows that tie in group
    and order are kept in one part and get consecutive sums.
    """
    group, order = list(group), list(order)
    placed = cut_lineage(
        df.repartitionByRange(parts(df.sparkSession), *group, *order).withColumn("_part", F.spark_partition_id())
    )
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(*group, "_part")
        .agg(F.sum(value).alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .drop("_sum")
    )
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*group, "_part")]
    rows = placed.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.alias("a").join(starts.alias("b"), same).select(
        *[F.col(f"a.{c}") for c in df.columns], (F.col("a._inside") + F.col("b._before")).alias(out)
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of an undirected graph, root being the smallest node of the component.

    Alternating large-star and small-star contraction until nothing changes: a logarithmic number of
    rounds in practice, each an aggregation and a join. Hubs are safe: the minimum is taken before the
    shuffle, and the join with one row per node is one that adaptive execution can split. Every round
    is a reliable checkpoint. Nodes without an edge to another node are absent.
    """
    edges = cut_lineage(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    )
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    node = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return node.union(edges.select("v", "v").distinct())


def schema_of(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, most: tuple[int, int]
) -> DataFrame:
    """(doc_id, text, y) of at most ``most`` documents with label 0 and with label 1, outside the held-out fold.

    The ids are the first by a hash, so every run takes the same; their list, at most sum(most) rows
    whatever the input, is what gets broadcast. A document with several labels takes the largest, an id
    with several texts the least text.
    """
    ids = (
        labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", modulus, remainder))
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg(F.max(label).cast("int").alias("y"))
    )
    picks = [ids.filter(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most[y]) for y in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(picks[0].union(picks[1])), F.col("doc_id") == F.col("_id"))
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
