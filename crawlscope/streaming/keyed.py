"""Streams with keyed state of their own: running duplicate groups and running request gaps.

Both take a streaming DataFrame and return the rows that a batch changed; ``incremental.drain`` keeps the
newest row of each key. State lives in the state store under the query's checkpoint, so a query that is
started again goes on where it ended. The state store must be RocksDB, see ``with_state_store``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from crawlscope.functions import urls

# Ship the processors with the query: executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
GROUPS = "norm_url string, group_size long, first_id long"
GAPS = "site string, bucket long, kind string, requests long, violations long, low long, first long, last long, late long"


def with_state_store(spark: SparkSession) -> SparkSession:
    """Keyed state needs the RocksDB store; queries started before keep theirs."""
    spark.conf.set(PROVIDER, ROCKSDB)
    return spark


# --- running duplicate groups ----------------------------------------------------------------
class _Group(StatefulProcessor):
    """Size of a group and its keeper, the page with the least id."""

    def init(self, handle) -> None:
        self.group = handle.getValueState("group", "size long, first long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        size, first = self.group.get() if self.group.exists() else (0, None)
        for row in rows:
            size += row.n
            first = row.first if first is None else first if row.first is None else min(first, row.first)
        self.group.update((size, first))
        yield Row(norm_url=key[0], group_size=size, first_id=first)


def page_rows(pages: DataFrame) -> DataFrame:
    """pages(page_id, url) -> page_id, url, norm_url; pages without a web URL drop."""
    return pages.filter(urls.is_web(F.col("url"))).select("page_id", "url", urls.normalize(F.col("url")).alias("norm_url"))


def running_groups(pages: DataFrame) -> DataFrame:
    """Duplicate groups that a batch of pages(page_id, url) changed: norm_url, group_size, first_id.

    A task adds up its rows of a URL first, so that a frequent one sends one row from each Arrow batch.
    """

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = pa.Table.from_batches([batch]).group_by("norm_url").aggregate([([], "count_all"), ("page_id", "min")])
            yield from sums.select(["norm_url", "count_all", "page_id_min"]).rename_columns(["norm_url", "n", "first"]).to_batches()

    partial = page_rows(pages).select("norm_url", F.col("page_id").cast("long")).mapInArrow(combine, "norm_url string, n long, first long")
    return partial.groupBy("norm_url").transformWithState(_Group(), GROUPS, "Update", "None")


def members(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """page_id, url, norm_url, group_size, is_first: the rows of all pages so far with the newest state of their groups."""
    return rows.join(groups, "norm_url").select(
        "page_id", "url", "norm_url", "group_size", (F.col("page_id") == F.col("first_id")).alias("is_first")
    )


# --- running gaps ----------------------------------------------------------------------------
class _Gaps(StatefulProcessor):
    """Requests of a site in one stretch of time, in an ordered buffer until the watermark closes the stretch."""

    def __init__(self, width: int, min_gap: int):
        self.width, self.min_gap = width, min_gap

    def init(self, handle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", "us long")
        self.late = handle.getValueState("late", "n long")

    def _sums(self, key) -> Row:
        us = np.sort(np.array([t for (t,) in self.buffer.get()], np.int64))
        gaps = np.diff(us)
        low = int(gaps.min()) if len(gaps) else None
        return Row(
            site=key[0], bucket=key[1], kind="gaps", requests=len(us), violations=int((gaps < self.min_gap).sum()), low=low, first=int(us[0]), last=int(us[-1]), late=0
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        end = (key[1] + 1) * self.width // 1000
        new = [(r.us,) for r in rows]
        if end <= timerValues.getCurrentWatermarkInMs():
            late = len(new) + (self.late.get()[0] if self.late.exists() else 0)
            self.late.update((late,))
            yield Row(site=key[0], bucket=key[1], kind="late", requests=0, violations=0, low=None, first=None, last=None, late=late)
            return
        if not self.buffer.exists():
            self.handle.registerTimer(end)
        self.buffer.appendList(new)
        yield self._sums(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield self._sums(key)
        self.buffer.clear()


def running_gaps(requests: DataFrame, delay: str, min_gap_ms: int = 1000, width: str = "1 hour") -> DataFrame:
    """Stretches of ``width`` that a batch of requests(site, ts) changed: site, bucket, kind, requests, violations, low,
    first, last, late.

    A stretch takes requests in any order until the watermark, ``delay`` behind the newest time, has
    passed its end; then its buffer goes. What comes later still is counted in rows of kind ``late``. A busy site spreads over its
    stretches. Requests without a time drop, as they have no place.
    """
    micros = _micros(width)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    timed = requests.withWatermark("ts", delay).filter(F.col("ts").isNotNull())
    rows = timed.select("site", F.floor(us / micros).cast("long").alias("bucket"), us.alias("us"))
    return rows.groupBy("site", "bucket").transformWithState(_Gaps(micros, min_gap_ms * 1000), GAPS, "Update", "EventTime")


def _micros(width: str) -> int:
    """A length of time such as "15 minutes"."""
    number, unit = width.split()
    return int(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1_000_000


def gap_report(stretches: DataFrame, min_gap_ms: int = 1000) -> DataFrame:
    """Newest rows by (site, bucket, kind) -> site, requests, violations, min_gap_ms, late: gaps between stretches are added."""
    edge = F.col("first") - F.lag("last").over(Window.partitionBy("site").orderBy("bucket"))
    closed = stretches.filter("kind = 'gaps'").withColumn("edge", edge)
    sums = closed.groupBy("site").agg(
        F.sum("requests").alias("requests"),
        (F.sum("violations") + F.count_if(F.col("edge") < min_gap_ms * 1000)).alias("violations"),
        F.floor(F.least(F.min("low"), F.min("edge")) / 1000).alias("min_gap_ms"),
    )
    late = stretches.groupBy("site").agg(F.sum("late").alias("late"))
    return late.join(sums, "site", "left").select(
        "site", F.coalesce("requests", F.lit(0)).alias("requests"), F.coalesce("violations", F.lit(0)).alias("violations"), "min_gap_ms", "late"
    )
