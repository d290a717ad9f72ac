import datetime
import json
import random
from collections import Counter

from pyspark.sql import functions as F

from crawlscope.operators import api, style, tech


def test_palette_sums_the_page_tops(spark):
    """Counts beyond the 25 top colours of a page do not count for the site."""
    rng = random.Random(1)
    rows, ord_ = [], 0
    for page in range(6):
        for c in range(40):
            rows.append(("s", page, f"rgb({c}, 0, 0)", rng.randrange(1, 6), ord_))
            ord_ += 1
    df = spark.createDataFrame(rows, "site string, page_id bigint, value string, cnt bigint, ord bigint")
    total = Counter()
    for page in range(6):
        own = [(v, n) for _, p, v, n, _ in rows if p == page]
        for value, n in sorted(own, key=lambda x: -x[1])[:25]:
            total[value] += n
    want = [(v, n) for v, n in total.most_common(12)]
    got = style.palette(df, per_page=25).orderBy("rank").collect()
    assert [(r.value, r.cnt) for r in got] == want
    assert [r.role for r in got[:6]] == ["Primary", "Secondary", "Accent", "Surface", "Muted", "Color 6"]


def test_typography_takes_the_last_sample_tag(spark):
    rows = [("s", 1, "F", "12px", "400", "P", 2, 0), ("s", 2, "F", "12px", "400", "H1", 1, 0), ("s", 2, "G", "1px", "4", "A", None, 1)]
    df = spark.createDataFrame(rows, "site string, page_id bigint, family string, size string, weight string, tag string, cnt bigint, ord bigint")
    got = [(r.family, r.cnt, r.sample_tag) for r in style.typography(df).orderBy("rank").collect()]
    assert got == [("F", 3, "H1"), ("G", 1, "A")]


def log_frame(spark):
    rows = [
        ("s", 1, "https://s/a.js", "script", 10, {"Set-Cookie": "x", "COOKIE": "y", "X-Csrf-Token": "t", "Authorization": "z", "a": "b"}),
        ("s", 2, "https://cdn/b.js", "script", 90, {"content-length": "5"}),
        ("s", 3, "https://s/", "document", None, {"Content-Length": "70", "Server": "nginx", "via": "v", "content-encoding": "br"}),
        ("s", 4, "https://s/2", "document", 90, {}),
        ("s", 5, "https://cdn/" + "x" * 400, "xhr", None, {"content-length": "nan"}),
    ]
    return spark.createDataFrame(rows, "site string, seq bigint, url string, type string, size bigint, headers map<string,string>")


def test_responses(spark):
    log = tech.response_log(log_frame(spark))
    got = {r.seq: r for r in log.collect()}
    assert got[1].headers == {"a": "b"} and got[3].size == 70 and got[5].size == 0 and len(got[5].url) == 412
    top = tech.top_resources(log, 3)
    assert [r.seq for r in top.orderBy("rank").collect()] == [2, 4, 3]
    assert [r.seq for r in tech.third_party_heavy(top).collect()] == [2]
    main = tech.main_document(log)
    assert main.first().seq == 3
    row = tech.infra_signals(main).first()
    assert (row.server, row.cdn, row.compression, row.https) == ("nginx", "v", "br", True)
    hosts = {r.host: (r.requests, r.bytes) for r in tech.third_party_inventory(log).collect()}
    assert hosts == {"cdn": (2, 90)}


def test_fingerprints(spark):
    pages = [
        '<div id="__next"></div><script>window.__NEXT_DATA__ = {}</script>',
        '<link rel="stylesheet" href="/tailwind.min.css"><link href=/bootstrap.css rel=stylesheet>',
        '<meta name="generator" content="WordPress 6"><script src="/jquery-3.6.1.min.js"></script>',
        "plain text about bootstrap and jquery",
    ]
    df = spark.createDataFrame([(i, "https://s/", h) for i, h in enumerate(pages)], "page_id bigint, url string, html string")
    got = {(r.page_id, r.name, r.confidence, r.version) for r in tech.detect_frameworks(df).collect()}
    assert got == {
        (0, "Next.js", "Confirmed", ""), (0, "React", "Confirmed", ""), (1, "Tailwind CSS", "Likely", ""), (1, "Bootstrap", "Confirmed", ""),
        (2, "WordPress", "Confirmed", ""), (2, "jQuery", "Likely", "3.6.1"),
    }


def test_vitals_and_lighthouse(spark):
    entries = spark.createDataFrame(
        [("s", 1, 100.4, 0.05, False), ("s", 2, 200.6, 0.2, True), ("s", 3, None, 0.0005, False)],
        "site string, seq bigint, start double, shift double, recent_input boolean",
    )
    row = tech.web_vitals(entries).first()
    assert (row.lcp, row.cls) == (201, 0.051)
    report = {"categories": {"performance": {"score": 0.906}, "accessibility": {"score": None}, "seo": {"score": 0.49}, "best-practices": {"score": 1}}}
    df = spark.createDataFrame([("a", json.dumps(report)), ("b", "{bad"), ("c", "{}")], "site string, body string")
    got = {(r.site, r.category): (r.score, r.grade) for r in tech.lighthouse_scores(df).collect()}
    assert got == {("a", "performance"): (90.6, "good"), ("a", "seo"): (49.0, "poor"), ("a", "best-practices"): (100.0, "good")}


def test_politeness_over_bucket_edges(spark):
    rng = random.Random(5)
    start = datetime.datetime(2024, 1, 1)
    rows = [("hot" if rng.random() < 0.6 else f"s{rng.randrange(3)}", i, start + datetime.timedelta(milliseconds=rng.randrange(400_000))) for i in range(500)]
    df = spark.createDataFrame(rows, "site string, seq bigint, ts timestamp")
    got = {r.site: (r.requests, r.violations, r.min_gap_ms) for r in tech.politeness(df, 1000).collect()}
    for site in {r[0] for r in rows}:
        times = sorted(t for s, _, t in rows if s == site)
        gaps = [(b - a) // datetime.timedelta(milliseconds=1) for a, b in zip(times, times[1:])]
        assert got[site] == (len(times), sum(g < 1000 for g in gaps), min(gaps))


def test_attempts(spark):
    rows = [("s", "u", 1, False, "e1"), ("s", "u", 2, False, "e2"), ("s", "v", 3, False, "e"), ("s", "v", 4, True, None), ("s", "w", 5, False, "x"), ("s", "w", 6, False, "x"), ("s", "w", 7, False, "x"), ("s", "w", 8, False, "y")]
    df = spark.createDataFrame(rows, "site string, url string, seq bigint, ok boolean, error string")
    got = {r.url: (r.attempts, r.ok, r.last_error, r.over_limit) for r in tech.attempt_groups(df).collect()}
    assert got == {"u": (2, False, "e2", False), "v": (2, True, None, False), "w": (4, False, "y", True)}


def test_api_calls_and_gate(spark):
    rows = [
        ("a", 1, "GET", "https://a/api/1", 200, "fetch", "application/json", '{"m": "x@y.co"}'),
        ("a", 2, "GET", "https://a/api/2", 200, "xhr", "text/html", "secret@mail.co"),
        ("a", 3, "GET", "https://a/api/3", 200, "xhr", None, None),
        ("a", 4, "GET", "https://a/api/1", 200, "fetch", "application/json", "{}"),
        ("b", 5, "GET", "https://b/api", 200, "xhr", "application/json", "{}"),
        ("c", 6, "GET", "https://x/api", 200, "xhr", "application/json", "[1]"),
        ("d", 7, "GET", "https://x/img", 200, "image", "image/png", None),
    ]
    log = spark.createDataFrame(rows, "site string, seq bigint, method string, url string, status int, type string, content_type string, body string")
    calls = api.api_calls(log)
    previews = {r.seq: r.body_preview for r in calls.collect()}
    assert previews == {1: '{"m": "***@***.***"}', 2: None, 3: None, 4: "{}", 5: "{}", 6: "[1]"}
    total = {r.site: (r.api_calls, r.same_origin_calls, r.endpoints) for r in api.api_summary(calls).collect()}
    assert total == {"a": (4, 4, 3), "b": (1, 1, 1), "c": (1, 0, 1)}
    kinds = spark.createDataFrame([("b", "form"), ("e", "form"), ("e", "json")], "site string, kind string")
    gates = {r.site: (r.gate, r.confidence_cap) for r in api.evidence_gate(calls, kinds).collect()}
    assert gates == {"a": ("sufficient", "Confirmed"), "b": ("insufficient", "Hypothesis"), "c": ("none", "Hypothesis"), "e": ("sufficient", "Confirmed")}


def test_payload_fields(spark):
    rows = [("s", "u", '{"a": 1, "b": {"c": "x"}}'), ("s", "u", '{"a": "t"}'), ("s", "u", "[1]"), ("s", "u", "{bad"), ("s", "v", '{"a": null}')]
    df = spark.createDataFrame(rows, "site string, url string, body string")
    got = {(r.url, r.field, r.type): r.calls for r in api.payload_profile(df).collect()}
    assert got == {("u", "a", "BIGINT"): 1, ("u", "b", "OBJECT<c: STRING>"): 1, ("u", "a", "STRING"): 1, ("v", "a", "VOID"): 1}
    schema = {r.url: r.calls for r in api.payload_schema(df.filter(F.col("body") != "[1]")).collect()}
    assert schema == {"u": 2, "v": 1}
