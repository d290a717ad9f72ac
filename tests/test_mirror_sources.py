import json

from pyspark.sql import functions as F

from crawlscope.operators import mirror
from crawlscope.plans import audit
from crawlscope.sources import readers, writers

CONTENT = (
    "site string, url string, content_path string, title string, depth int, status int, canonical string, lang string, og map<string,string>, "
    "types array<string>, screenshot string, screenshot_mobile string, crawled_at string, word_count bigint, body_text string, "
    "sections array<struct<id:string,heading:string,text:string>>, images array<struct<src:string,alt:string,width:bigint,height:bigint>>"
)


def markdown(spark, **changes):
    row = {
        "site": "example.com", "url": "https://example.com/about", "content_path": "p", "title": "Contact user@example.com", "depth": 1, "status": 200,
        "canonical": "https://example.com/about", "lang": "ko", "og": {"og:title": "Home me@x.org"}, "types": ["Organization"],
        "screenshot": "_audit/screenshots/001.png", "screenshot_mobile": None, "crawled_at": "2026-04-22T10:00:00", "word_count": 12,
        "body_text": "Reach us at user@example.com or 010-1234-5678.",
        "sections": [("s", "Team", "Call 01012345678 or email hi@example.org."), (None, None, "plain"), (None, None, None)],
        "images": [("https://cdn.example.com/a.png", "Ping user@example.com", 100, 80)],
    }
    row.update(changes)
    df = spark.createDataFrame([tuple(row.values())], CONTENT)
    return mirror.content_mirror(df).first().markdown


def test_markdown_masks_everything_and_keeps_the_key_order(spark):
    text = markdown(spark)
    keys = [line.split(":")[0] for line in text.split("---")[1].strip().split("\n")]
    assert keys == "url title depth status canonical lang og structured_data screenshot screenshot_mobile crawled_at word_count reading_time".split()
    assert text.startswith('---\nurl: "https://example.com/about"\ntitle: "Contact ***@***.***"\n')
    assert "word_count: 12\nreading_time: 1\n---\n\n# Contact ***@***.***\n\n## Team\nCall ***-****-**** or email ***@***.***.\n\nplain\n\n## 이미지" in text
    assert 'og: {"og:title": "Home ***@***.***"}\nstructured_data: ["Organization"]\n' in text
    for secret in ("user@example.com", "hi@example.org", "01012345678", "010-1234-5678", "me@x.org"):
        assert secret not in text
    assert text.endswith("| https://cdn.example.com/a.png | Ping ***@***.*** | 100 | 80 |\n")


def test_markdown_without_sections_status_and_images(spark):
    text = markdown(spark, sections=[], images=[], status=None, canonical=None, og=None)
    assert "status: \"unknown\"" in text and 'canonical: "https://example.com/about"' in text and "og: {}" in text
    assert text.endswith("# Contact ***@***.***\n\nReach us at ***@***.*** or ***-****-****.\n")
    many = [(f"/{i}.png", None, None, None) for i in range(60)]
    assert markdown(spark, images=many).count("\n| /") == 50


def test_snapshots_drop_broken_records(spark, tmp_path):
    lines = [json.dumps({"site": "s", "url": "u1", "title": "t", "nav_links": [{"href": "h", "text": "x"}]}), "{broken", json.dumps({"title": "no url"})]
    (tmp_path / "s.json").write_text("\n".join(lines))
    got = readers.read_snapshots(spark, str(tmp_path)).collect()
    assert [(r.url, r.nav_links[0].href, r.depth) for r in got] == [("u1", "h", None)]


def test_snapshots_of_lines_and_arrays_with_quarantine(spark, tmp_path):
    records = [{"site": "s", "url": f"u{i}", "depth": i, "meta": {"h1": ["a", "b"]}} for i in range(3)]
    folder = tmp_path / "crawls"
    folder.mkdir()
    (folder / "indented.json").write_text("\n  " + json.dumps(records, indent=2))
    (folder / "compact.json").write_text(json.dumps([{"url": "c1"}, {"url": "", "title": "no url"}]))
    (folder / "lines.json").write_text("\n".join(["", json.dumps({"url": "l1"}), "{broken", '["not a record"]', json.dumps({"url": "l2"})]))
    (folder / "cut.json").write_text(json.dumps(records, indent=2)[:-9])
    (folder / "blank.json").write_text(" \n ")
    got = readers.read_snapshots(spark, str(folder))
    assert sorted(r.url for r in got.collect()) == ["c1", "l1", "l2", "u0", "u1", "u2"]
    assert got.filter("url = 'u1'").first().meta.h1 == ["a", "b"]
    counts = {r.file.rsplit("/", 1)[1]: (r.records, r.broken) for r in readers.broken_counts(spark, str(folder)).collect()}
    assert counts == {"indented.json": (3, 0), "compact.json": (2, 0), "lines.json": (4, 2), "cut.json": (1, 1)}
    kept = {(r.file.rsplit("/", 1)[1], r.record[:8]) for r in readers.broken_snapshots(spark, str(folder)).collect()}
    assert kept == {("lines.json", "{broken"), ("lines.json", '["not a '), ("cut.json", "[\n  {\n  ")}
    missing = readers.read_snapshots(spark, str(tmp_path / "nowhere"))
    assert missing.collect() == [] and missing.columns == got.columns


def test_writing_replaces_only_the_given_sites(spark, tmp_path):
    out = str(tmp_path / "derived")
    first = spark.createDataFrame([(f"s{i}", f"u{i}", i) for i in range(50)], "site string, url string, page_ord bigint")
    writers.write_derived(first, out, buckets=4)
    new = spark.createDataFrame([("s3", "new", 3), ("s3", "newer", 4), ("added", "x", 5)], "site string, url string, page_ord bigint")
    writers.write_derived(new, out, buckets=4)
    back = {(r.site, r.url, r.page_ord) for r in spark.read.parquet(out).collect()}
    assert back == {(f"s{i}", f"u{i}", i) for i in range(50) if i != 3} | {("s3", "new", 3), ("s3", "newer", 4), ("added", "x", 5)}


def test_crawl_pipeline(spark):
    html = '<html><head><title>T</title><script src="/a.js"></script></head><body><nav>{}</nav><main>x</main></body></html>'

    def page(*targets):
        return html.format("".join(f'<a href="{t}">{t}</a>' for t in targets))

    pages = spark.createDataFrame(
        [(1, "https://s.example/", page("/a", "/b", "/private/x", "https://o.example/")), (2, "https://s.example/a/", page("/c", "/gone")), (3, "https://s.example/b#t", page("/c")), (4, "https://s.example/c", page("/d"))],
        "page_id bigint, url string, html string",
    )
    roots = spark.createDataFrame([("s.example", "https://s.example/")], "site string, url string")
    robots = spark.createDataFrame([("s.example", "User-agent: *\nDisallow: /private")], "site string, body string")
    tables = audit.crawl(pages, roots, robots, max_pages=8, max_depth=2)
    got = [(r.url.removeprefix("https://s.example"), r.depth, r.status) for r in tables["plan"].orderBy("visit_ord").collect()]
    assert got == [("/", 0, "ok"), ("/a", 1, "ok"), ("/b", 1, "ok"), ("/c", 2, "ok"), ("/gone", 2, "failed")]
    assert tables["shots"].count() == 4 and tables["assets"].first().pages == 4
    mirrored = audit.mirror_pages(pages, tables["shots"].withColumn("status", F.lit(200)), "now")
    assert {r.content_path.removeprefix("_audit/content/") for r in mirrored.collect()} == {"_index.md", "a.md", "b.md", "c.md"}


def test_flat_export_has_25_colours_and_six_page_fields(spark, tmp_path, monkeypatch):
    import __spark_entry__ as entry

    rules = "".join(f".c{i} {{ color: rgb({i}, 0, 0) }}" * (40 - i) for i in range(30))
    html = f"<html><head><title>T</title><style>{rules}</style></head><body>x</body></html>"
    pages = spark.createDataFrame([(1, "https://a.org/x", html)], "page_id bigint, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    monkeypatch.setattr(entry.A, "rich_pages", lambda *_: pages)
    want = [(str(i + 1), f"rgb({i}, 0, 0)") for i in range(25)]
    for name in ("snk3_flat_export", "snk3_flat_export_whole"):
        got = entry.queries()[name](spark, str(tmp_path)).collect()
        assert sorted(((r.place, r.value) for r in got if r.part == "color"), key=lambda c: int(c[0])) == want
    assert {r.part: r.value for r in got if r.part != "color"} == {
        "page": "https://a.org/x T", "page_depth": "0", "page_status": "200",
        "page_screenshot": "_audit/screenshots/001-x-pc.png", "page_screenshot_mobile": "_audit/screenshots/001-x-mobile.png",
    }
