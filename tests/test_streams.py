import datetime

from crawlscope.streaming import incremental


def write(spark, path, rows):
    spark.createDataFrame(rows, "site string, url string, ts timestamp, size bigint").coalesce(1).write.mode("append").parquet(path)


def t(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


def test_fresh_urls_and_rates_equal_batch(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [(f"s{i % 3}", f"https://s/{i % 7}?utm_source={i}", t(i // 4), i) for i in range(200)]
    write(spark, path, rows[:120])
    write(spark, path, rows[120:])
    schema = spark.read.parquet(path).schema

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)

    fresh = incremental.drain(incremental.fresh_urls(stream(), "1 day"))
    assert sorted((r.site, r.norm_url) for r in fresh.collect()) == sorted({(s, u.split("?")[0]) for s, u, _, _ in rows})
    rates = incremental.drain(incremental.request_rates(stream(), "10 minutes"), ["site", "start"])
    batch = incremental.request_rates(spark.read.parquet(path), "10 minutes")
    assert sorted(map(tuple, rates.collect())) == sorted(map(tuple, batch.collect()))


def test_late_rows_drop_behind_the_watermark(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, [("s", "u", t(0), 1), ("s", "u", t(60), 1)])
    first = spark.read.parquet(path).schema
    write(spark, path, [("s", "u", t(1), 5), ("s", "u", t(59), 7)])
    stream = spark.readStream.schema(first).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)
    got = {r.start.minute: (r.requests, r.bytes) for r in incremental.drain(incremental.request_rates(stream, "5 minutes")).collect()}
    assert got.get(0) == (1, 1)


def test_latest_stages(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [("s", "ux", "pending", t(0), 0), ("s", "ux", "done", t(2), 1), ("s", "ux", "blocked", t(1), 2)]
    spark.createDataFrame(rows, "site string, stage string, status string, ts timestamp, seq bigint").write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    row = incremental.drain(incremental.latest_stages(stream), ["site", "stage"]).first()
    assert (row.status, row.events) == ("done", 3)


def test_table_as_one_file_or_as_a_folder(spark, tmp_path):
    folder = tmp_path / "tables"
    write(spark, str(folder / "log.parquet"), [("s", "u", t(1), 1)])
    write(spark, str(folder / "log.parquet"), [("s", "u", t(0), 2)])
    assert incremental.drain(incremental.read_stream(spark, str(folder), "log", 1)).count() == 2
    part = next((folder / "log.parquet").glob("part-*.parquet"))
    (folder / "single.parquet").write_bytes(part.read_bytes())
    assert incremental.drain(incremental.read_stream(spark, str(folder), "single")).count() == 1
