"""Session set-up and lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "crawlscope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE on; ``master`` is only for local runs, a cluster sets its own."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and stream state.

    A cluster names it in ``spark.checkpoint.dir``. A folder of our own is only made in
    local mode, where driver and executors share one disk.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            named = tempfile.mkdtemp(prefix="crawlscope-ckpt-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of the executors that made them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def place_by(df: DataFrame, *keys: str) -> DataFrame:
    """Reliable checkpoint that stays partitioned and sorted by ``keys``.

    A table that is joined on the same keys in every round of a loop then moves only once. AQE may
    merge partitions as it likes, which hides the layout from later joins, so it rests meanwhile.
    """
    spark, switch = df.sparkSession, "spark.sql.adaptive.enabled"
    before = spark.conf.get(switch)
    spark.conf.set(switch, "false")
    try:
        return cut_lineage(df.repartition(*keys).sortWithinPartitions(*keys))
    finally:
        spark.conf.set(switch, before)


def local_session(cpus: int | None = None, app: str = "crawlscope-local") -> SparkSession:
    """Session for tests and the benchmark."""
    cpus = cpus or os.cpu_count() or 4
    return build_session(
        app,
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.driver.memory": "8g",
            "spark.driver.bindAddress": "127.0.0.1",
            "spark.driver.host": "127.0.0.1",
            "spark.ui.showConsoleProgress": "false",
        },
    )
