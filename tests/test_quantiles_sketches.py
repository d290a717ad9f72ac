"""Exact quantiles of one hot site, and united sketches next to exact counts."""

import math
import random

from pyspark.sql import functions as F

from crawlscope.operators import mirror, tech


def test_quantiles_of_raw_values_with_one_site_holding_nearly_all(spark):
    rnd = random.Random(3)
    rows = [("hot", rnd.lognormvariate(6, 1)) for _ in range(3_000)] + [("hot", 250.5)] * 700 + [("b", rnd.random()) for _ in range(7)] + [("c", None), ("d", 1.5)]
    rnd.shuffle(rows)
    got = {r.site: r for r in tech.timing_rollup(spark.createDataFrame(rows, "site string, lcp double"), "lcp").collect()}
    assert set(got) == {"hot", "b", "d"}
    for site, r in got.items():
        values = sorted(v for s, v in rows if s == site)
        assert r.n == len(values) and abs(r.mean - sum(values) / len(values)) < 0.001
        assert (r.p50, r.p75) == tuple(values[math.ceil(len(values) * share) - 1] for share in (0.5, 0.75))


def test_a_hot_site_spans_several_tasks(spark):
    rows = spark.range(4_000).select(F.lit("s").alias("site"), (F.col("id") * 7919 % 4001).cast("double").alias("v"))
    from crawlscope.operators.common import numbered_by_range

    totals = numbered_by_range(rows.withColumn("c", F.lit(2)), ["site"], ["v"], "upto", parts=8, weight="c").collect()
    assert [r.upto for r in sorted(totals, key=lambda r: r.v)] == [2 * i for i in range(1, 4_001)]


def test_united_sketches_are_near_the_exact_count(spark):
    rows = spark.range(200_000).select(
        F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("site"), (F.col("id") % 30).alias("day"), F.lit("script").alias("kind"),
        F.concat(F.lit("/js/"), (F.col("id") % 60_000).cast("string")).alias("value"),
    )
    exact = {r.site: r.n for r in rows.groupBy("site").agg(F.count_distinct("value").alias("n")).collect()}
    daily = mirror.daily_sketches(rows)
    got = {r.site: r.distinct for r in mirror.united_counts(daily).collect()}
    assert all(abs(got[s] - n) <= 0.02 * n for s, n in exact.items())
    # One day's sketch alone, and all sites united.
    day = mirror.united_counts(daily.filter("day = 3"), "kind").first().distinct
    assert abs(day - rows.filter("day = 3").select("value").distinct().count()) <= 0.02 * day
    assert abs(mirror.united_counts(daily, "kind").first().distinct - 60_000) <= 1_200
    assert mirror.united_counts(mirror.daily_sketches(rows.limit(0))).collect() == []
