"""Structured Streaming forms of URL dedupe, request rates and stage status.

Each takes a streaming DataFrame and returns one; the same expressions run in batch, so both
agree. State stays in the state store under the query's checkpoint, and watermarks bound it.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlscope.functions import urls
from crawlscope.session import shared_dir


def fresh_urls(requests: DataFrame, delay: str) -> DataFrame:
    """First request per canonical URL within ``delay``: requests(site, url, ts) -> site, norm_url, ts."""
    return (
        requests.select("site", urls.normalize(F.col("url")).alias("norm_url"), "ts")
        .filter("norm_url IS NOT NULL")
        .withWatermark("ts", delay)
        .dropDuplicatesWithinWatermark(["site", "norm_url"])
    )


def request_rates(requests: DataFrame, delay: str, width: str = "1 minute") -> DataFrame:
    """Requests per site and tumbling window: site, start, requests, bytes.

    ``delay`` is at least the spread of times inside what one trigger and the next may bring: rows later
    than that are dropped, as the watermark has passed their window. Partial sums are merged before
    the shuffle, so one busy site does not overload a task.
    """
    return (
        requests.withWatermark("ts", delay)
        .groupBy("site", F.window("ts", width).alias("w"))
        .agg(F.count("*").alias("requests"), F.sum("size").alias("bytes"))
        .select("site", F.col("w.start").alias("start"), "requests", "bytes")
    )


def latest_stages(log: DataFrame) -> DataFrame:
    """Running latest state per site and stage: at most seven rows of state per site."""
    place = F.struct("ts", "seq")
    return log.groupBy("site", "stage").agg(F.max_by("status", place).alias("status"), F.count("*").alias("events"))


def read_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """Stream over the files of one table, whether it is one file or a folder of part files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # A pattern, as a stream takes a plain path for a folder.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{name}.parque[t]")


def drain(stream: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Run a stream over all that is there and return its result.

    Without keys the output only ever grows and goes to Parquet as it is. With keys each batch
    writes the rows it changed to a folder of its own, which a repeated batch replaces; the
    newest row per key is the result, so the state may forget what the watermark closed.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if not keys:
        writer.outputMode("append").format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer.outputMode("update").foreachBatch(save).start().awaitTermination()
    changes = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    values = [c for c in stream.columns if c not in keys]
    newest = F.max_by(F.struct(*values), "batch").alias("_newest")
    return changes.groupBy(*keys).agg(newest).select(*keys, "_newest.*").select(*stream.columns)
