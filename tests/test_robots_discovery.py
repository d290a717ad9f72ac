from pyspark.sql import functions as F

from crawlscope.operators import discovery, robots
from crawlscope.plans import audit

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
O = "https://example.com"


def rules_of(spark, body, **kw):
    df = spark.createDataFrame([("example.com", body)], "site string, body string")
    return robots.robots_rules(df, **kw).first()


def test_rules_and_sitemap_lines(spark):
    row = rules_of(spark, "User-agent: *\nDisallow: /private\nSitemap: /sitemap.xml")
    assert (row.prefixes, row.sitemaps, row.loaded) == (["/private"], ["/sitemap.xml"], True)


def test_last_agent_line_wins_and_values_are_case_sensitive(spark):
    body = "User-Agent: *\r\nuser-agent: Other\r\nDisallow: /a\r\nUSER-AGENT: crawlscope\r\nDISALLOW : /b # c\r\nDisallow:\r\nAllow: /c\r\nno colon\r\nUser-agent: CrawlScope\r\nDisallow: /d"
    assert rules_of(spark, body).prefixes == ["/b"]
    assert rules_of(spark, body, agents=["Other"]).prefixes == ["/a"]


def test_empty_and_missing_files(spark):
    assert rules_of(spark, None).loaded is False
    assert rules_of(spark, "  \n").prefixes == []


def test_blocking(spark):
    rules = spark.createDataFrame([("example.com", ["/", "/private", "/x?y"]), ], "site string, prefixes array<string>")
    rows = [
        ("example.com", f"{O}/private/a", True), ("example.com", f"{O}/privateer", True), ("example.com", f"{O}/pub", False),
        ("example.com", f"{O}/x?y", False), ("example.com", "https://other.example/private", False), ("other.example", "https://other.example/private", False),
        ("example.com", O, False),
    ]
    df = spark.createDataFrame(rows, "site string, url string, want boolean")
    for few in (False, True):
        assert all(r.blocked == r.want for r in robots.mark_blocked(df, rules, few=few).collect())
    strict = robots.mark_blocked(df, rules, strict=True)
    assert strict.filter("site = 'example.com' AND NOT blocked").count() == 1, "only the foreign address is free"


def test_a_site_of_many_rules(spark):
    """Both ways agree, with nulls, repeated rows and other columns; a site of 100,000 rules is looked up."""
    from pyspark.sql import Row

    many = [f"/r{i:05d}/" for i in range(100_000)]
    rules = spark.createDataFrame([("a.org", many), ("b.org", ["/", "/é", "/x"]), ("c.org", []), ("d.org", None)], "site string, prefixes array<string>")
    urls_ = [f"https://a.org/r{i * 7 % 120_000:05d}/{i}" for i in range(2_000)] + ["https://b.org/étage", "https://b.org/x", "https://b.org", "https://c.org/x", "https://d.org/", None]
    rows = [Row(site=(u or "https://a.org").split("/")[2], url=u, prefix="p", _hit=1) for u in urls_ * 2]
    df = spark.createDataFrame(rows, "site string, url string, prefix string, _lengths int")
    got = robots.mark_blocked(df, rules)
    assert got.columns == [*df.columns, "blocked"] and got.count() == len(rows)
    want = {u: u is not None and ("a.org" in u and int(u.split("/r")[1][:5]) < 100_000 and len(u.split("/")[3]) == 6 or u in urls_[2_000:2_002]) for u in urls_}
    assert {r.url: r.blocked for r in got.collect()} == want
    few = [r for r in rows if r.site != "a.org"]
    small = spark.createDataFrame(few, df.schema)
    assert sorted(map(str, robots.mark_blocked(small, rules).collect())) == sorted(map(str, robots.mark_blocked(small, rules, few=True).collect()))
    assert robots.mark_blocked(df.limit(0), rules).collect() == [] and not robots.mark_blocked(small, rules.limit(0)).filter("blocked").count()


def docs(spark, mapping, status=200):
    return spark.createDataFrame([("example.com", u, status, b) for u, b in mapping.items()], "site string, doc_url string, status int, body string")


def test_sitemap_and_feed_discovery(spark):
    sites = spark.createDataFrame([("example.com", O)], "site string, origin string")
    robots_files = spark.createDataFrame([("example.com", "Sitemap: /sitemap.xml")], "site string, body string")
    sitemap = docs(spark, {f"{O}/sitemap.xml": f"<urlset {NS}><url><loc>{O}/about</loc></url><url><loc> {O}/blog/post-1 </loc></url></urlset>"})
    feed = docs(spark, {f"{O}/feed.xml": f"<rss><channel><item><link>{O}/news/alpha</link></item></channel></rss>"}).withColumn("feed_ord", F.lit(0).cast("bigint"))
    found = audit.discover(sites, robots_files, sitemap, feed)
    assert {r.url for r in found.collect()} == {f"{O}/about", f"{O}/blog/post-1", f"{O}/news/alpha"}
    counts = discovery.discovery_counts(found).first()
    assert (counts.sitemap, counts.rss, counts.total_unique) == (2, 1, 3)


def index(*locs):
    return f"<sitemapindex {NS}>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in locs) + "</sitemapindex>"


def urlset(*locs):
    return f'<?xml version="1.0"?><!-- c --><urlset {NS}>' + "".join(f"<url><loc>{u}</loc></url>" for u in locs) + "</urlset>"


def walk(spark, mapping, **kw):
    roots = spark.createDataFrame([("example.com", f"{O}/sitemap.xml", 0)], "site string, doc_url string, ord bigint")
    rows = discovery.walk_sitemaps(roots, docs(spark, mapping), **kw).orderBy("depth", "ord").collect()
    return [r.url.removeprefix(O) for r in rows]


def test_walk_is_breadth_first(spark):
    mapping = {
        f"{O}/sitemap.xml": index(f"{O}/nested.xml", f"{O}/a.xml"),
        f"{O}/nested.xml": index(f"{O}/b.xml", f"{O}/sitemap.xml"),
        f"{O}/a.xml": urlset(f"{O}/a-first", "https://other.example/x", "", f"{O}/a-second"),
        f"{O}/b.xml": urlset(f"{O}/b-deep"),
    }
    assert walk(spark, mapping) == ["/a-first", "/a-second", "/b-deep"]
    assert walk(spark, mapping, max_urls=2) == ["/a-first", "/a-second"]
    assert walk(spark, mapping, max_depth=1) == ["/a-first", "/a-second"]


def test_walk_skips_bad_documents(spark):
    mapping = {
        f"{O}/sitemap.xml": index(f"{O}/bad.xml", f"{O}/nons.xml", f"{O}/missing.xml", f"{O}/pre.xml", f"{O}/pre.xml"),
        f"{O}/bad.xml": f"<urlset {NS}><url>",
        f"{O}/nons.xml": f"<urlset><url><loc>{O}/no</loc></url></urlset>",
        f"{O}/pre.xml": f'<s:urlset xmlns:s="http://www.sitemaps.org/schemas/sitemap/0.9"><s:url><s:loc>{O}/pre</s:loc></s:url></s:urlset>',
    }
    assert walk(spark, mapping) == ["/pre"]


def test_default_sitemaps(spark):
    sites = spark.createDataFrame([("example.com", O), ("b.example", "http://b.example")], "site string, origin string")
    rules = spark.createDataFrame([("example.com", ["m.xml", "https://cdn.example/s.xml"])], "site string, sitemaps array<string>")
    got = [(r.site, r.doc_url) for r in discovery.sitemap_roots(sites, rules).orderBy("site", "ord").collect()]
    assert got == [
        ("b.example", "http://b.example/sitemap.xml"), ("b.example", "http://b.example/sitemap_index.xml"),
        ("example.com", f"{O}/m.xml"), ("example.com", "https://cdn.example/s.xml"),
    ]


def test_atom_links(spark):
    atom = f"""<feed xmlns="http://www.w3.org/2005/Atom">
    <entry><link rel="self" href="{O}/self"/><link rel="Alternate" href=" {O}/alt "/></entry>
    <entry><link href="{O}/plain"/></entry>
    <entry><link rel="enclosure" href="{O}/first"/><link rel="next" href="{O}/second"/></entry>
    <entry><title>none</title></entry><entry><link href="https://other.example/x"/></entry></feed>"""
    bad = docs(spark, {f"{O}/bad": "<feed", f"{O}/gone": atom}).withColumn("status", F.when(F.col("doc_url").endswith("gone"), 404).otherwise(200))
    got = discovery.feed_links(docs(spark, {f"{O}/atom": atom}).unionByName(bad)).orderBy("pos").collect()
    assert [r.url.removeprefix(O) for r in got] == ["/alt", "/plain", "/first"]


def test_feed_repeats_count_once(spark):
    sitemap = spark.createDataFrame([("s", "u1", 0, [0, 0])], "site string, url string, depth int, ord array<bigint>")
    feeds = spark.createDataFrame([("s", 0, 0, "u2"), ("s", 0, 1, "u2"), ("s", 0, 2, "u1")], "site string, feed_ord bigint, pos bigint, url string")
    found = discovery.discover_urls(sitemap, feeds)
    assert [(r.url, r.source) for r in found.orderBy("ord").collect()] == [("u1", "sitemap"), ("u2", "rss")]
    counts = discovery.discovery_counts(found).first()
    assert (counts.sitemap, counts.rss, counts.total_unique) == (1, 3, 2)


def test_seeds_are_normalised_and_same_site(spark):
    roots = spark.createDataFrame([("example.com", f"{O}/")], "site string, url string")
    found = spark.createDataFrame(
        [("example.com", f"{O}/?ref=x", [1]), ("example.com", f"{O}/b/", [0, 1]), ("example.com", "https://o.example/", [2]), ("example.com", "mailto:x", [3])],
        "site string, url string, ord array<bigint>",
    )
    got = [r.url for r in discovery.merge_seeds(roots, found).orderBy("ord").collect()]
    assert got == [f"{O}/", f"{O}/b"]


def test_first_page_chooses_the_feeds(spark):
    from crawlscope.plans import audit

    pages = spark.createDataFrame(
        [
            (1, "https://a.example/", '<link rel=feed href="/two"><link type="application/rss+xml" href="/one">'),
            (2, "https://a.example/x", "<link rel=feed href=/three>"),
            (3, "https://b.example/", "<p>"),
        ],
        "page_id bigint, url string, html string",
    )
    rss = lambda u: f"<rss><channel><item><link>{u}</link></item></channel></rss>"
    feeds = spark.createDataFrame(
        [(f"{s}.example", f"https://{s}.example/{f}", 200, rss(f"https://{s}.example/{f}-item")) for s, f in (x.split() for x in ("a one", "a two", "a three", "a feed", "b feed", "b one"))],
        "site string, doc_url string, status int, body string",
    )
    got = {(r.site, r.feed_ord, r.doc_url.rsplit("/", 1)[1]) for r in audit.announced_feeds(pages, feeds).collect()}
    assert got == {("a.example", 0, "two"), ("a.example", 1, "one"), ("b.example", 0, "feed")}
    assert audit.announced_feeds(pages, feeds, limit=1).count() == 2
    sites = spark.createDataFrame([("a.example", "https://a.example"), ("b.example", "https://b.example")], "site string, origin string")
    robots_files = spark.createDataFrame([], "site string, status int, body string")
    sitemaps = spark.createDataFrame([], "site string, doc_url string, status int, body string")
    found = audit.discover(sites, robots_files, sitemaps, feeds, pages)
    assert {(r.url, r.source) for r in found.collect()} == {(f"https://{u}-item", "rss") for u in ("a.example/two", "a.example/one", "b.example/feed")}
