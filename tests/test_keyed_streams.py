"""Streams with keyed state against the batch jobs, over any split, order and restart."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from crawlscope.operators import canonical, tech
from crawlscope.streaming import incremental, keyed

START = datetime.datetime(2024, 1, 1)


def t(seconds):
    return START + datetime.timedelta(seconds=seconds)


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, files=1):
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)


PAGES = "page_id bigint, url string"


def page_table(seed):
    rnd = random.Random(seed)
    urls = [f"https://{h}.example/{p}{q}" for h in "ab" for p in ("", "x", "x/") for q in ("", "#f", "?utm_source=1", "?b=2&a=1", "?a=1&b=2")] + ["mailto:x@y.z", None]
    return [(i, rnd.choice(urls)) for i in range(120)] + [(None, urls[3])]


@pytest.mark.parametrize("seed", [1, 2])
def test_duplicate_groups_equal_the_batch_job(spark, tmp_path, seed):
    keyed.with_state_store(spark)
    rows, path, rnd = page_table(seed), str(tmp_path / "in"), random.Random(seed)
    rnd.shuffle(rows)
    cuts = sorted(rnd.sample(range(1, len(rows)), 3))
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        write(spark, path, rows[a:b], PAGES)
    groups = incremental.drain(keyed.running_groups(stream(spark, path)), ["norm_url"])
    pages = spark.read.parquet(path)
    got = keyed.members(keyed.page_rows(pages), groups)
    assert sorted(map(str, got.collect())) == sorted(map(str, canonical.canonicalize_urls(pages).collect()))


def test_groups_go_on_after_a_restart(spark, tmp_path):
    keyed.with_state_store(spark)
    path, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    url = "https://a.example/x"

    def run():
        def save(batch, number):
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        query = keyed.running_groups(stream(spark, path)).writeStream.option("checkpointLocation", state).outputMode("update")
        query.foreachBatch(save).trigger(availableNow=True).start().awaitTermination()
        newest = spark.read.parquet(out).groupBy("norm_url").agg(F.max_by(F.struct("group_size", "first_id"), "batch").alias("g"))
        return {r.norm_url: tuple(r.g) for r in newest.collect()}

    write(spark, path, [(5, url), (9, url + "#a"), (7, url + "/y")], PAGES)
    assert run() == {url: (2, 5), url + "/y": (1, 7)}
    write(spark, path, [(3, url + "?utm_source=z"), (11, url)], PAGES)
    assert run() == {url: (4, 3), url + "/y": (1, 7)}


REQUESTS = "site string, seq bigint, ts timestamp"


def report(spark, path, delay, width, min_gap_ms=1000):
    return incremental.drain(keyed.running_gaps(stream(spark, path), delay, min_gap_ms, width), ["site", "bucket", "kind"])


def test_gaps_equal_the_batch_job_for_requests_in_any_order(spark, tmp_path):
    keyed.with_state_store(spark)
    rnd, path = random.Random(4), str(tmp_path / "in")
    rows = [(rnd.choice("aaab"), i, t(round(rnd.random() * 600, 3))) for i in range(400)] + [("c", 1, t(5)), ("d", 2, None)]
    rows += [("a", 1000 + i, rows[i][2]) for i in range(5)]
    # Out of order by at most a minute.
    rows.sort(key=lambda r: (r[2] or t(0)) + datetime.timedelta(seconds=rnd.random() * 60))
    for a in range(0, len(rows), 90):
        write(spark, path, rows[a : a + 90], REQUESTS)
    got = keyed.gap_report(report(spark, path, "2 minutes", "15 seconds")).collect()
    timed = spark.read.parquet(path).filter("ts IS NOT NULL")
    assert sorted((r.site, r.requests, r.violations, r.min_gap_ms) for r in got) == sorted(map(tuple, tech.politeness(timed).collect()))
    assert {r.late for r in got} == {0}


def test_late_requests_are_counted_apart(spark, tmp_path):
    keyed.with_state_store(spark)
    path = str(tmp_path / "in")
    write(spark, path, [("a", 1, t(0)), ("a", 2, t(0.5))], REQUESTS)
    write(spark, path, [("a", 3, t(1000)), ("b", 1, t(1000))], REQUESTS)
    write(spark, path, [("a", 4, t(1001))], REQUESTS)
    write(spark, path, [("a", 5, t(0.2)), ("a", 6, t(1000.5)), ("b", 2, t(3)), ("b", 3, t(4))], REQUESTS)
    write(spark, path, [("b", 4, t(5))], REQUESTS)
    rows = report(spark, path, "10 seconds", "1 minute")
    got = {r.site: (r.requests, r.violations, r.min_gap_ms, r.late) for r in keyed.gap_report(rows).collect()}
    # a: 0, 0.5 | 1000, 1000.5, 1001; the closed stretch keeps its two requests.
    assert got == {"a": (5, 3, 500, 1), "b": (1, 0, None, 3)}


def test_lengths_of_time():
    assert [keyed._micros(x) for x in ("1 second", "15 minutes", "2 hours", "1 day")] == [10**6, 9 * 10**8, 72 * 10**8, 864 * 10**8]
