"""Writers of derived tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope.session import cut_lineage


def write_derived(df: DataFrame, path: str, fmt: str = "parquet", buckets: int = 64) -> None:
    """Write a derived table, replacing the rows of the sites in ``df`` and no others.

    Sites go to hashed buckets, so a million sites do not make a million folders. The buckets that
    ``df`` touches are written anew, with the old rows of their other sites, which a checkpoint holds
    meanwhile. The rebalance hint lets AQE merge small buckets into one task and split a bucket that
    one site fills, without a sampling pass over ``df``.
    """
    bucket = F.pmod(F.xxhash64("site"), F.lit(buckets)).cast("int")
    rows = cut_lineage(df.withColumn("site_bucket", bucket))
    try:
        old = df.sparkSession.read.format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    else:
        touched = old.join(rows.select("site_bucket").distinct(), "site_bucket", "left_semi")
        others = touched.join(rows.select("site").distinct(), "site", "left_anti")
        rows = rows.unionByName(cut_lineage(others), allowMissingColumns=True)
    (
        rows.hint("rebalance", "site_bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("site_bucket")
        .format(fmt)
        .save(path)
    )
