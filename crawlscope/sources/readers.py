"""Readers of the audit input tables (Parquet or JSON lines) with fixed schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlscope import schemas

TABLES = {
    "snapshots": schemas.PAGE_SNAPSHOT,
    "pages": schemas.PAGES,
    "robots": schemas.ROBOTS,
    "sitemap_docs": schemas.DOCUMENT_STORE,
    "feed_docs": schemas.DOCUMENT_STORE,
    "fetch_log": schemas.FETCH_LOG,
    "stage_log": schemas.STAGE_LOG,
    "lighthouse": schemas.LIGHTHOUSE,
}


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """One input table. JSON is read permissively: a broken line is a row of nulls."""
    reader = spark.read.schema(TABLES[name])
    if fmt == "json":
        reader = reader.option("mode", "PERMISSIVE")
    return reader.format(fmt).load(path)


def snapshot_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the JSON files under ``path``: file, snapshot (null for a broken record), record (its text).

    A file holds one record per line, or one JSON array over any lines; its first character tells. A
    path that is not there has no records. Files of lines are split as usual; an array is read whole.
    """
    schema = T.StructType.fromDDL(f"file STRING, snapshot STRUCT<{schemas.PAGE_SNAPSHOT}>, record STRING")
    try:
        lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    # The first line with text lies in the first part of a file; rows of one part are in order.
    heads = lines.filter("start = 0 AND trim(value) <> ''").select("file", "value", F.monotonically_increasing_id().alias("place"))
    heads = heads.groupBy("file").agg(F.min_by("value", "place").alias("head"))
    # A list of files, as any reader of a folder keeps on the driver.
    arrays = [r.file for r in heads.filter(F.trim("head").startswith("[")).select("file").collect()]
    records = lines.filter(F.trim("value") != "").filter(~F.col("file").isin(arrays)).select("file", F.col("value").alias("record"))
    parsed = records.select("file", _parse("record").alias("snapshot"), "record")
    if arrays:
        whole = spark.read.text(arrays, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("record"))
        items = F.from_json("record", f"array<struct<{schemas.PAGE_SNAPSHOT}>>", {"mode": "PERMISSIVE"})
        listed = whole.withColumn("items", items)
        good = listed.filter("items IS NOT NULL").select("file", F.explode("items").alias("snapshot"), F.lit(None).cast("string").alias("record"))
        bad = listed.filter("items IS NULL").select("file", F.lit(None).cast(parsed.schema["snapshot"].dataType).alias("snapshot"), "record")
        parsed = parsed.unionByName(good).unionByName(bad)
    return parsed


def _parse(column: str) -> Column:
    """The record of a JSON text, null if the text is broken."""
    whole = F.from_json(column, schemas.PAGE_SNAPSHOT + ", _broken STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    return F.when(F.col(column).rlike(r"^\s*\{") & whole["_broken"].isNull(), whole.dropFields("_broken"))


def read_snapshots(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Page snapshots of a crawl; broken records and records without a URL drop, a missing path is an empty table."""
    if fmt == "json":
        rows = snapshot_records(spark, path).filter("snapshot IS NOT NULL").select("snapshot.*")
    else:
        rows = read_table(spark, "snapshots", path, fmt)
    return rows.filter(F.coalesce("url", F.lit("")) != "")


def broken_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Quarantine of what ``read_snapshots`` could not read: file, record, one row per broken record or broken array."""
    return snapshot_records(spark, path).filter("snapshot IS NULL").select("file", "record")


def broken_counts(spark: SparkSession, path: str) -> DataFrame:
    """file, records, broken for every file with a record."""
    return snapshot_records(spark, path).groupBy("file").agg(
        F.count("*").alias("records"), F.count_if(F.col("snapshot").isNull()).alias("broken")
    )


def parse_snapshots(lines: DataFrame) -> DataFrame:
    """Snapshots out of a column ``line`` of JSON text, under the same rules."""
    parsed = lines.select(F.from_json("line", schemas.PAGE_SNAPSHOT, {"mode": "PERMISSIVE"}).alias("s"))
    return parsed.select("s.*").filter(F.coalesce("url", F.lit("")) != "")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash rows over all cores when a plain scan has fewer splits than there are cores.

    Heavy per-row work on a few big splits would leave cores idle. A table of any size has
    enough splits and is left alone, so page texts are not shuffled there. The key makes a
    recomputed task see the same rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
