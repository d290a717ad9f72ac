"""Audit inputs derived from the given tables, row by row or by plain grouping.

The expressions are SQL text that Spark and other engines read alike, so a check can build the
very same inputs. No row is left out; ``%`` only varies the values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlscope.operators.canonical import site_pages
from crawlscope.operators.common import numbered
from crawlscope.sources.readers import spread

HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
LANG = "regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)', 1)"


TEXT_KEYS = {"pages": "page_id", "documents": "doc_id"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df, TEXT_KEYS[name]) if name in TEXT_KEYS else df


# events -> responses, one per event ------------------------------------------------------
_EVENT_SITE = "concat('site', CAST(user_id % 20 AS STRING))"
_EVENT_HOST = (
    f"CASE WHEN event_id % 4 = 0 THEN concat('cdn', CAST(user_id % 3 AS STRING)) ELSE {_EVENT_SITE} END"
)
FETCH_LOG = {
    "site": _EVENT_SITE,
    "seq": "event_id",
    "page_url": f"concat('https://', {_EVENT_SITE}, '/')",
    "url": f"concat('https://', {_EVENT_HOST}, '/', event_type, '/', CAST(event_id % 50 AS STRING))",
    "type": (
        "CASE event_type WHEN 'view' THEN 'document' WHEN 'click' THEN 'script' WHEN 'purchase' THEN 'fetch' "
        "WHEN 'signup' THEN 'xhr' ELSE 'image' END"
    ),
    "method": "CASE WHEN event_type = 'signup' THEN 'POST' ELSE 'GET' END",
    "status": "CAST(CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS BIGINT)",
    "size": "CAST(round(value * 100) AS BIGINT)",
    "content_type": "CASE WHEN event_id % 5 = 0 THEN 'text/plain' ELSE 'application/json' END",
    "body": "props",
    "ts": "ts",
}
# Bodies whose members, types and depth change from event to event; some are cut off.
NESTED_BODY = (
    "concat('{\"id\":', CAST(event_id AS STRING), ',\"event\":', props, ',\"user\":{\"id\":', CAST(user_id AS STRING), "
    "CASE event_id % 4 WHEN 0 THEN ',\"tags\":[\"a b\",1,{\"deep\":[true,null,[]]}]' WHEN 1 THEN ',\"tags\":[]' WHEN 2 THEN ',\"tags\":null' ELSE '' END, "
    "'},\"kind\":', CASE WHEN event_id % 3 = 0 THEN concat('\"', event_type, ' [{\"') ELSE concat('{\"name\":\"', event_type, '\"}') END, "
    "CASE WHEN event_id % 5 = 0 THEN ',\"rows\":[{\"n\":1,\"s\":\"x\"},{\"n\":false}]' ELSE '' END, "
    "CASE WHEN event_id % 11 = 0 THEN '' ELSE '}' END)"
)
ATTEMPTS = {
    "site": _EVENT_SITE,
    "url": FETCH_LOG["url"],
    "seq": "event_id",
    "ok": "event_type <> 'error'",
    "error": "CASE WHEN event_type = 'error' THEN concat('status 500 at ', CAST(event_id AS STRING)) END",
}
VITALS = {
    "site": _EVENT_SITE,
    "seq": "event_id",
    "start": "CASE WHEN event_type = 'view' THEN CAST(round(value * 10) AS BIGINT) END",
    "shift": "CAST(round(value * 100) AS DOUBLE) / 1000000",
    "recent_input": "event_type = 'click'",
}
TIMINGS = {
    "site": "concat('visit', CAST(event_id AS STRING))",
    "dom_content_loaded": "round(value * 40, 0)",
    "load_complete": "round(value * 70, 0)",
    "lcp": "round(value * 60, 0)",
    "cls": "round(value / 400, 3)",
}
LIGHTHOUSE = {
    "site": "concat('report', CAST(event_id AS STRING))",
    "body": (
        "CASE WHEN event_id % 11 = 0 THEN '{broken' ELSE concat('{\"categories\":{\"performance\":{\"score\":', "
        "CAST(CAST((event_id % 101) / 100.0 AS DECIMAL(5,2)) AS STRING), '},\"best-practices\":{\"score\":', "
        "CASE WHEN event_id % 7 = 0 THEN 'null' ELSE '0.5' END, '},\"seo\":{\"score\":0.9}}}') END"
    ),
}
# orders -> stage log, one entry per order ------------------------------------------------
STAGE_LOG = {
    "site": "concat('site', CAST(o_custkey % 50 AS STRING))",
    "stage": (
        "CASE o_orderkey % 7 WHEN 0 THEN 'target' WHEN 1 THEN 'ux' WHEN 2 THEN 'ia' WHEN 3 THEN 'tech' "
        "WHEN 4 THEN 'db' WHEN 5 THEN 'report' ELSE 'handover' END"
    ),
    "status": "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'in_progress' ELSE 'pending' END",
    "ts": "o_orderdate",
    "seq": "o_orderkey",
    "notes": "o_orderpriority",
    "artifact": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('file', CAST(o_orderkey AS STRING)) END",
}
# lineitem -> style observations, one per line --------------------------------------------
STYLE_OBS = {
    "site": "concat('site', CAST(l_suppkey % 10 AS STRING))",
    "page_id": "CAST(floor(l_orderkey / 256) AS BIGINT)",
    "value": (
        "concat('rgb(', CAST(l_linenumber * 30 AS STRING), ', ', CAST(l_partkey % 5 * 50 AS STRING), ', 0)')"
    ),
    "family": "l_returnflag",
    "size": "l_linestatus",
    "weight": "CAST(l_linenumber AS STRING)",
    "tag": "CASE WHEN l_partkey % 2 = 0 THEN 'P' ELSE 'H1' END",
    "cnt": "CAST(l_quantity AS BIGINT)",
    "o1": "l_orderkey",
    "o2": "CAST(l_linenumber AS BIGINT)",
    "o3": "l_partkey",
    "o4": "l_suppkey",
}
# pages -> richer markup ------------------------------------------------------------------
_PID = "CAST(page_id AS STRING)"


def _mod(n: int) -> str:
    return f"CAST(page_id % {n} AS STRING)"


HEAD_EXTRA = (
    "concat("
    f"CASE WHEN page_id % 3 <> 0 THEN concat('<meta name=\"description\" content=\"Desc ', {_PID}, ' &amp; more\">') ELSE '' END, "
    f"CASE WHEN page_id % 4 <> 0 THEN concat('<link rel=\"canonical\" href=\"/c/', {_PID}, '\">') ELSE '' END, "
    f"'<meta property=\"og:title\" content=\"OG ', {_PID}, '\">', "
    f"CASE WHEN page_id % 2 = 0 THEN concat('<meta property=\"og:title\" content=\"Second ', {_PID}, '\">') ELSE '' END, "
    f"CASE WHEN page_id % 5 <> 0 THEN concat('<meta name=\"og:image\" content=\"/img/', {_PID}, '.png\">') ELSE '' END, "
    f"'<script src=\"/js/app', {_mod(7)}, '.js\"></script><script src=\"https://cdn.example.net/jquery-3.', {_mod(10)}, '.0.min.js\"></script>', "
    f"'<link rel=\"stylesheet\" href=\"/css/s', {_mod(3)}, '.css\"><link rel=\"stylesheet\" href=\"/css/s', {_mod(3)}, '.css\">', "
    f"CASE WHEN page_id % 4 = 0 THEN concat('<link rel=\"alternate\" type=\"application/rss+xml\" href=\"/feed-', {_mod(9)}, '.xml\">') ELSE '' END, "
    f"CASE WHEN page_id % 6 = 0 THEN '<script type=\"application/ld+json\">{{bad</script>' "
    f"ELSE concat('<script type=\"application/ld+json\">{{\"@type\":\"Article\",\"id\":', {_PID}, '}}</script>') END, "
    f"CASE WHEN page_id % 10 = 3 THEN '<script type=\"application/ld+json\">[{{\"@type\":[\"A\",\"B\"]}},{{\"x\":1}}]</script>' ELSE '' END, "
    f"'<style>.a{{color:rgb(1, 2, ', {_mod(5)}, ');font-family:F', {_mod(3)}, ';font-size:12px;font-weight:', {_mod(4)}, '00}}</style>')"
)
SECTION_EXTRA = (
    f"concat('<section id=\"s', {_PID}, '\"><h2>Sec ', {_PID}, '</h2><p>Text of ', {_PID}, '</p>"
    f"<img src=\"/i/', {_mod(8)}, '.png\" alt=\"Alt ', {_PID}, '\" width=\"10\" height=\"20\"><img src=\"/i/', {_mod(8)}, '.png\">', "
    f"CASE WHEN page_id % 2 = 0 THEN concat('<img src=\"/j/', {_PID}, '.png\" loading=\"lazy\">') ELSE '' END, '</section>')"
)
TAIL_EXTRA = (
    f"concat('<aside role=\"navigation\"><a href=\"aside/', {_PID}, '?utm_source=x&b=2&a=1\">aside ', {_PID}, '</a>"
    f"<a href=\"https://other.example/', {_PID}, '\">out</a></aside>"
    f"<form action=\"/send\" method=\"post\"><label for=\"e\">Mail</label><input id=\"e\" name=\"email\" type=\"email\" required placeholder=\"you\">"
    f"<input name=\"q', {_mod(2)}, '\"><select name=\"topic\"></select><textarea name=\"msg\"></textarea></form>', "
    f"CASE WHEN page_id % 5 = 1 THEN '<script>window.__NEXT_DATA__={{}}</script>' ELSE '' END)"
)
RICH_HTML = (
    f"replace(replace(html, '</head>', concat({HEAD_EXTRA}, '</head>')), '</article>', "
    f"concat({SECTION_EXTRA}, '</article>', {TAIL_EXTRA}))"
).replace("{{", "{").replace("}}", "}")
# pages -> up to four responses for each page, and its times.
PAGE_LOG = {
    "site": HOST,
    "page_url": "url",
    "seq": "page_id * 4 + k",
    "url": f"CASE WHEN k = 0 THEN url ELSE concat('https://cdn.example/', CAST(k AS STRING), '.js') END",
    "type": "CASE WHEN k = 0 THEN 'document' ELSE 'script' END",
    "status": "CAST(CASE WHEN k > 0 THEN 304 WHEN page_id % 7 = 0 THEN 404 ELSE 200 END AS BIGINT)",
}
PAGE_TIMES = {
    "site": HOST, "page_url": "url", "dom_content_loaded": "CAST(page_id * 37 % 3000 AS BIGINT)", "load_complete": "CAST(page_id * 53 % 6000 AS BIGINT)"
}
PAGE_VITALS = {
    "site": HOST, "page_url": "url", "seq": "page_id * 4 + k", "start": "CASE WHEN k < 3 THEN CAST(page_id % 4000 + k * 100 AS BIGINT) END",
    "shift": "CAST(page_id % 97 + k AS DOUBLE) / 3000", "recent_input": "(page_id + k) % 3 = 0",
}
# pages -> a further sheet that changes from page to page, over the page's own markup.
SHEET = (
    "concat('<style>body{color:rgb(1, 2, ', " + _mod(5) + ", ');font:12px F', " + _mod(3) + ", '}', "
    "CASE page_id % 4 WHEN 0 THEN 'nav a{color:rgb(200, 0, 0)!important}nav ul>li>a{color:#00c800}' WHEN 1 THEN 'nav ul>li>a{color:#00c800}a{color:blue}' "
    "WHEN 2 THEN 'nav a{color:inherit}' ELSE '' END, "
    "CASE WHEN page_id % 3 = 0 THEN '@media (max-width:600px){h1{background:#090909}}' ELSE '@media screen{article > h1:first-child{background:#090909 none}}' END, "
    "'</style></head>')"
)
# pages -> robots, one file per site ------------------------------------------------------
ROBOTS_PREFIX = (
    "CASE length(site) % 4 WHEN 0 THEN '/fr' WHEN 1 THEN '/de' WHEN 2 THEN '/en/1' ELSE '/es' END"
)
# One line break per rule; chr(10) works in every engine.
ROBOTS_BODY = (
    "concat('# rules', chr(10), 'User-agent: otherbot', chr(10), 'Disallow: /en', chr(10), 'USER-AGENT: *', chr(10), "
    f"'Disallow:', chr(10), 'Disallow: /', chr(10), ' Disallow : ', {ROBOTS_PREFIX}, ' # lang', chr(10), "
    "'no colon here', chr(10), 'Sitemap: /map-index.xml')"
)


def select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expr} AS {name}" for name, expr in columns.items()])


def fetch_log(spark: SparkSession, folder: str) -> DataFrame:
    return select(table(spark, folder, "events"), FETCH_LOG)


def header_log(spark: SparkSession, folder: str) -> DataFrame:
    """The responses with a header map built from each event."""
    headers = (
        "map('Server', concat('srv', CAST(user_id % 3 AS STRING)), 'Set-Cookie', 'a=1', 'AUTHORIZATION', 'x', "
        "'Via', 'edge', 'Content-Encoding', CASE WHEN event_id % 2 = 0 THEN 'gzip' ELSE 'br' END, "
        "'Content-Length', CAST(event_id AS STRING))"
    )
    columns = {**FETCH_LOG, "size": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(round(value * 100) AS BIGINT) END"}
    return select(table(spark, folder, "events"), {**columns, "headers": headers})


def nested_log(spark: SparkSession, folder: str) -> DataFrame:
    """The responses with bodies of several levels."""
    return select(table(spark, folder, "events"), {**FETCH_LOG, "body": NESTED_BODY})


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    return select(table(spark, folder, "events"), ATTEMPTS)


def vitals(spark: SparkSession, folder: str) -> DataFrame:
    return select(table(spark, folder, "events"), VITALS)


def timings(spark: SparkSession, folder: str) -> DataFrame:
    return select(table(spark, folder, "events"), TIMINGS)


def lighthouse(spark: SparkSession, folder: str) -> DataFrame:
    return select(table(spark, folder, "events"), LIGHTHOUSE)


def stage_log(spark: SparkSession, folder: str) -> DataFrame:
    log = select(table(spark, folder, "orders"), STAGE_LOG)
    listed = F.when(F.col("artifact").isNull(), F.array().cast("array<string>")).otherwise(F.array("artifact"))
    return log.withColumn("artifacts", listed).drop("artifact")


def style_obs(spark: SparkSession, folder: str) -> DataFrame:
    obs = select(table(spark, folder, "lineitem"), STYLE_OBS)
    # One number in the order of the four keys: order, line, part and supplier (below 10^11 each).
    wide = F.lit(10**11).cast("decimal(12,0)")
    line = F.col("o1").cast("decimal(38,0)") * 8 + F.col("o2")
    return obs.withColumn("ord", (line * wide + F.col("o3")) * wide + F.col("o4")).drop("o1", "o2", "o3", "o4")


def rich_pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").selectExpr("page_id", "url", f"{RICH_HTML} AS html")


def page_log(spark: SparkSession, folder: str, columns: dict[str, str]) -> DataFrame:
    """Rows k = 0 to page_id % 4 for each page."""
    rows = table(spark, folder, "pages").selectExpr("page_id", "url", "explode(sequence(0, CAST(page_id % 4 AS INT))) AS k")
    return select(rows, columns)


def styled_pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").selectExpr("page_id", "url", f"replace(html, '</head>', {SHEET}) AS html")


def crawled_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct canonical pages with a number per site in page order: site, url, page_ord, rn."""
    return numbered(site_pages(table(spark, folder, "pages")).drop("raw_url"), ["site"], "page_ord", "rn")


def robots(spark: SparkSession, folder: str) -> DataFrame:
    sites = table(spark, folder, "pages").selectExpr(f"{HOST} AS site").distinct()
    return sites.selectExpr("site", f"{ROBOTS_BODY} AS body")


def sites(spark: SparkSession, folder: str) -> DataFrame:
    """site, origin of every host among the pages; the origin is that of its first page."""
    pages = table(spark, folder, "pages").selectExpr(f"{HOST} AS site", "page_id", "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin")
    return pages.groupBy("site").agg(F.min_by("origin", "page_id").alias("origin"))


def heap_edges(pages: DataFrame) -> DataFrame:
    """Links of a binary heap over the page numbers of each site, with back links and repeats.

    Page n links to its children 2n and 2n+1 and back to its parent; a page of rank n is thus
    floor(log2 n) clicks away from the first one.
    """
    numbers = pages.select("site", F.col("rn").alias("dst_rn"), F.col("url").alias("dst"))
    sources = pages.select("site", F.col("rn"), F.col("url").alias("src"))
    wanted = sources.select(
        "site",
        "src",
        F.posexplode(F.array(F.col("rn") * 2, F.col("rn") * 2 + 1, F.floor(F.col("rn") / 2), F.col("rn") * 2 + 1)).alias(
            "link_ord", "dst_rn"
        ),
    )
    return wanted.join(numbers, ["site", "dst_rn"]).select(
        "site", "src", "dst", F.col("link_ord").cast("bigint").alias("link_ord")
    )


def sitemap_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Three levels of sitemaps per site: index of indexes, indexes, and lists of 64 page ids.

    A list holds at most 64 pages, an index at most 50,000 lists (the limit of the format).

    Each list also names a page of another host, which the walk must drop.
    """
    ns = "http://www.sitemaps.org/schemas/sitemap/0.9"
    pages = table(spark, folder, "pages").selectExpr(
        "page_id", "url", f"{HOST} AS site", "CAST(floor(page_id / 64) AS BIGINT) AS leaf",
        "CAST(floor(page_id / 3200000) AS BIGINT) AS branch",
    )
    hosts = sites(spark, folder)

    def document(df: DataFrame, keys: list[str], order: str, item: str, wrap: str, extra: str, name) -> DataFrame:
        listed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, item))).alias("items"))
        inner = F.array_join(
            F.transform("items", lambda i: F.concat(F.lit(f"<{wrap}><loc> "), F.replace(i[item], F.lit("&"), F.lit("&amp;")), F.lit(f" </loc></{wrap}>"))), ""
        )
        outer = "urlset" if wrap == "url" else "sitemapindex"
        return listed.join(hosts, "site").select(
            "site", F.concat("origin", name).alias("doc_url"), F.lit(200).alias("status"),
            F.concat(F.lit(f'<?xml version="1.0"?><{outer} xmlns="{ns}">'), inner, F.lit(f"{extra}</{outer}>")).alias("body"),
        )

    leaf_name = F.concat(F.lit("/list-"), F.col("leaf").cast("string"), F.lit(".xml"))
    branch_name = F.concat(F.lit("/index-"), F.col("branch").cast("string"), F.lit(".xml"))
    foreign = "<url><loc>https://elsewhere.example/x</loc></url>"
    leaves = document(pages, ["site", "leaf"], "page_id", "url", "url", foreign, leaf_name)
    # Absolute addresses, so the indexes need the site's origin.
    located = pages.select("site", "leaf", "branch").distinct().join(hosts, "site")
    branches = document(
        located.withColumn("loc", F.concat("origin", leaf_name)), ["site", "branch"], "leaf", "loc", "sitemap", "", branch_name
    )
    tops = document(
        located.select("site", "branch", F.concat("origin", branch_name).alias("loc")).distinct(),
        ["site"], "branch", "loc", "sitemap", "", F.lit("/map-index.xml"),
    )
    broken = hosts.select("site", F.concat("origin", F.lit("/broken.xml")).alias("doc_url"), F.lit(200).alias("status"), F.lit(f'<urlset xmlns="{ns}"><url>').alias("body"))
    return leaves.unionByName(branches).unionByName(tops).unionByName(broken)


def feed_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Per page one small feed: RSS for even ids, Atom for odd ones, with a foreign entry each."""
    atom = (
        "concat('<feed xmlns=\"http://www.w3.org/2005/Atom\"><entry><link rel=\"self\" href=\"https://elsewhere.example/s\"/>"
        "<link rel=\"alternate\" href=\"', u, '\"/></entry><entry><link rel=\"enclosure\" href=\"', u, '-first\"/>"
        "<link rel=\"next\" href=\"https://elsewhere.example/n\"/></entry></feed>')"
    )
    rss = (
        "concat('<rss version=\"2.0\"><channel><title>t</title><item><link> ', u, ' </link></item>"
        "<item><link>https://elsewhere.example/x</link></item><item><title>no link</title></item></channel></rss>')"
    )
    return table(spark, folder, "pages").selectExpr(
        f"{HOST} AS site", "page_id", "url", "replace(url, '&', '&amp;') AS u"
    ).selectExpr(
        "site", "page_id AS feed_ord", "concat('https://', site, '/feed/', CAST(page_id AS STRING)) AS doc_url", "200 AS status",
        f"CASE WHEN page_id % 2 = 0 THEN {rss} ELSE {atom} END AS body",
    )


def snapshot_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Each page as one JSON line, each followed by a broken and a blank line."""
    pages = table(spark, folder, "pages").selectExpr(f"{HOST} AS site", "page_id AS page_ord", "url", "html")
    record = F.to_json(
        F.struct("site", "page_ord", "url", F.regexp_extract("html", r"<title>([^<]*)", 1).alias("title"), F.lit(200).alias("status"))
    )
    return pages.select(record.alias("line")).select(F.explode(F.array("line", F.concat(F.lit("{"), "line"), F.lit(""))).alias("line"))
