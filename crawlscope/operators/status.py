"""Stage status out of an append-only stage log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlscope import dims


def _stage_order():
    order = F.lit(None).cast("bigint")
    for i, name in enumerate(dims.STAGES):
        order = F.when(F.col("stage") == name, F.lit(i).cast("bigint")).otherwise(order)
    return order


def _latest(log: DataFrame) -> DataFrame:
    """At most one row per site and stage: last event, last non-empty artifacts, last target done."""
    place = F.struct("ts", "seq")
    has_artifacts = F.coalesce(F.size("artifacts"), F.lit(0)) > 0
    return log.filter(F.col("stage").isin(*dims.STAGES)).groupBy("site", "stage").agg(
        F.max(place).alias("at"),
        F.max_by(F.struct("status", "notes"), place).alias("last"),
        F.max(F.when(has_artifacts, place)).alias("artifacts_at"),
        F.max_by("artifacts", F.when(has_artifacts, place)).alias("artifacts"),
        F.max(F.when(F.col("status") == "done", place)).alias("done_at"),
    )


def _all_stages(rows: DataFrame) -> DataFrame:
    """Every site gets every stage: seven rows per site, absent ones with nulls."""
    grid = rows.select("site").distinct().select(
        "site", F.explode(F.array(*[F.lit(s) for s in dims.STAGES])).alias("stage")
    )
    return grid.join(rows, ["site", "stage"], "left")


def _present(rows: DataFrame) -> DataFrame:
    status = F.coalesce(F.col("last.status"), F.lit("pending"))
    return rows.select(
        "site",
        "stage",
        _stage_order().alias("stage_ord"),
        status.alias("status"),
        F.when(status == "done", F.to_date("at.ts")).alias("completed_at"),
        F.coalesce("last.notes", F.lit("")).alias("notes"),
        F.coalesce("artifacts", F.array().cast("array<string>")).alias("artifacts"),
    )


def stage_status(log: DataFrame) -> DataFrame:
    """stage_log(site, stage, status, ts, seq, notes, artifacts) -> latest state of all stages.

    Absent stages are pending, only done stages have a date, an empty artifact list keeps the
    earlier one.
    """
    return _present(_all_stages(_latest(log)))


def status_after_reset(log: DataFrame, pivot: str = "target") -> DataFrame:
    """As ``stage_status``, but a finished ``pivot`` stage wipes every later stage.

    Events up to the last ``pivot`` done do not count for later stages. The log is folded to
    seven rows per site before sites are compared, so a site with a huge log stays cheap.
    """
    pivot_ord = dims.STAGES.index(pivot)
    rows = _all_stages(_latest(log)).withColumn("_ord", _stage_order())
    reset = F.max(F.when(F.col("stage") == pivot, F.col("done_at"))).over(Window.partitionBy("site"))
    rows = rows.withColumn("_reset", reset)
    later = (F.col("_ord") > pivot_ord) & F.col("_reset").isNotNull()
    stale = later & (F.col("at") <= F.col("_reset"))
    stale_files = later & (F.col("artifacts_at") <= F.col("_reset"))
    wiped = rows.withColumn("last", F.when(~F.coalesce(stale, F.lit(False)), F.col("last"))).withColumn(
        "artifacts", F.when(~F.coalesce(stale_files, F.lit(False)), F.col("artifacts"))
    )
    return _present(wiped)


def gate_check(status: DataFrame) -> DataFrame:
    """site, stage, missing, may_run: a stage may run once all stages it needs are done."""
    done = {
        s: F.bool_or((F.col("stage") == s) & (F.col("status") == "done")).alias(s) for s in dims.STAGES
    }
    wide = status.groupBy("site").agg(*done.values())
    gates = F.array(
        *[
            F.struct(
                F.lit(stage).alias("stage"),
                F.array_join(F.array_compact(F.array(*[F.when(~F.col(n), F.lit(n)) for n in needs])), ",").alias("missing"),
            )
            for stage, needs in dims.STAGE_NEEDS.items()
        ]
    )
    return wide.select("site", F.explode(gates).alias("g")).select(
        "site", "g.stage", "g.missing", (F.col("g.missing") == "").alias("may_run")
    )
