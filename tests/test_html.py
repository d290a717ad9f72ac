import pyarrow as pa
import pytest

from crawlscope.operators import content, dom, links, style
from crawlscope.functions import elements
from crawlscope.functions import html as H
from pyspark.sql import functions as F

PAGE = """<!DOCTYPE html><html lang="ko"><head><title> A &amp; B
</title><meta name="description" content="d > 1"><meta property='og:title' content=x><meta name="og:title" content="y">
<link rel="canonical" href="/c"><link rel="stylesheet" href="/s.css"><link href=/s.css rel='stylesheet'><script src="/a.js"></script>
<script src='/a.js'></script><script>var t="</p><a href='/script'>no</a>"</script>
<link rel="alternate" type="application/atom+xml" href="/atom"><link rel="feed" href="https://other.example/f">
<script type="application/ld+json">{"@type":["A","B"]}</script><script type="application/ld+json">{bad</script>
<script type="application/ld+json">[{"@type":"Org a@b.co"},{"x":1},3]</script>
<style>.a{color:#FFF;background-color: rgba(0, 0, 0, 0)} h1 { font-family: Inter, sans-serif; font-size:12px }</style></head><body>
<header><a href="/">Home <b>x</b></a></header>%s<main><h1>T</h1><p style="color: red">Hello<br>wor
ld</p>%s<img src="/i.png" alt="a>b" width=10 loading=lazy><img src="/i.png"><img>
<!-- <a href="/no">no</a> --><a href="/a">one<a href="/b">two</a><a href="/a">again</a> <a name=z>z</a>
<form method=post><label for=e>E</label><input id=e type=EMAIL required placeholder="p q"><select name=c></select>
<label>w<textarea name=t></textarea></label><input name=free></form>
</main><aside><a href="#x">aside</a></aside><footer><a href="mailto:x@y.z">m</a><section><h3>foot</h3></section></footer>"""
SECTION = '<section id=s1><h2>S1</h2><p>text <img src="/in.png"></p><article><h4>Inner</h4>deep</article></section>'
NAV = '<div role="navigation"><a href="menu">Menu</a></div>'


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "https://Ex.com/p/q", PAGE % (NAV, SECTION)), (2, "https://ex.com/r", PAGE % ("", ""))]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("page_id", *[c for c in ("link_ord", "ord") if c in df.columns]).collect()]


def test_links_and_parents(pages):
    found = links.extract_links(pages)
    got = rows(links.page_links(found), "page_id", "href", "text", "parent")
    assert got == [
        (1, "https://ex.com/", "Home x", "HEADER"),
        (1, "https://ex.com/p/menu", "Menu", "BODY"),
        (1, "https://ex.com/a", "one", "MAIN"),
        (1, "https://ex.com/b", "two", "MAIN"),
        (1, "https://ex.com/p/q#x", "aside", "ASIDE"),
        (1, "mailto:x@y.z", "m", "FOOTER"),
        (2, "https://ex.com/", "Home x", "HEADER"),
        (2, "https://ex.com/a", "one", "MAIN"),
        (2, "https://ex.com/b", "two", "MAIN"),
        (2, "https://ex.com/r#x", "aside", "ASIDE"),
        (2, "mailto:x@y.z", "m", "FOOTER"),
    ]
    assert rows(links.nav_links(found), "page_id", "text") == [(1, "Home x"), (1, "Menu"), (2, "Home x")]


def test_parser_pass_and_expressions_agree(spark, pages):
    """The page without a navigation role gives the same links either way."""
    plain = pages.filter("page_id = 2")
    forced = plain.withColumn("html", F.concat("html", F.lit('<i role="navigation"></i>')))
    left = rows(links.page_links(links.extract_links(plain)), "href", "text", "parent", "in_nav")
    assert left == rows(links.page_links(links.extract_links(forced)), "href", "text", "parent", "in_nav")


def test_nested_containers(spark):
    html = "<nav><section><a href=/1>1</a></nav><a href=/2>2</a></section><main><aside><a href=/3>3</a></aside><a href=/4>4</a></main><a href=/5>5</a>"
    df = spark.createDataFrame([(1, "http://e.example/", html)], "page_id bigint, url string, html string")
    got = df.select(F.inline(H.anchors(F.col("html")))).collect()
    assert [(r.text, r.parent, r.in_nav) for r in got] == [
        ("1", "SECTION", True), ("2", "BODY", False), ("3", "ASIDE", False), ("4", "MAIN", False), ("5", "BODY", False)
    ]


def test_link_graph_and_same_site(pages):
    found = links.extract_links(pages)
    edges = rows(links.link_graph(found), "src", "dst")
    assert ("https://Ex.com/p/q", "https://ex.com/b") in edges
    assert all(not dst.startswith("mailto") for _, dst in edges)
    same = rows(links.same_site(found), "page_id", "href")
    assert {p for p, _ in same} == {2}, "host case counts on the page's own address"


def test_meta(pages):
    row = content.page_meta(pages).filter("page_id = 1").first()
    assert (row.title, row.lang, row.description, row.canonical, row.h1, row.h2) == (
        "A & B", "ko", "d > 1", "https://ex.com/c", ["T"], ["S1"],
    )


def test_content_root_sections_and_words(pages):
    got = {r.page_id: r for r in content.extract_content(pages).collect()}
    # The plain page stays in the JVM and has no sections below its root.
    assert "<" not in got[2].body_text.replace("a>b", "")
    sections = got[1].sections
    assert [(s.id, s.heading) for s in sections] == [("s1", "S1"), (None, "Inner")]
    assert sections[0].text == "S1\ntext\nInner\ndeep"
    assert [i.src for i in sections[0].images] == ["https://ex.com/in.png"]
    assert got[1].body_text.startswith("T\nHello\nwor ld\nS1\ntext\nInner\ndeep")
    assert got[1].word_count == len(got[1].body_text.split())


@pytest.mark.parametrize(
    "html,text",
    [
        ("<body>x<div class='a content b'>in</div>y</body>", "in"),
        ("<body>x<div id=main>in</div>y</body>", "in"),
        ("<body>x<p role=main>in</p>y</body>", "in"),
        ("<body>x<main>one</main><article>two</article></body>", "one"),
        ("<body>x<article>a<article>b</article>c</article>y</body>", "a\nb\nc"),
        ("<body>x <b>y</b><script>z</script></body>", "x y"),
        ("no body at all", "no body at all"),
    ],
)
def test_content_roots(spark, html, text):
    df = spark.createDataFrame([(1, "http://e.example/", html)], "page_id bigint, url string, html string")
    assert content.extract_content(df).first().body_text == text


def test_images_and_assets(pages):
    images = [r for r in content.extract_images(pages).orderBy("page_id", "ord").collect() if r.page_id == 2]
    assert [(r.src, r.alt, r.width, r.height, r.loading) for r in images] == [("https://ex.com/i.png", "a>b", 10, None, "lazy")]
    got = rows(links.extract_assets(pages).filter("page_id = 2"), "kind", "src")
    assert sorted(got) == [("script", "https://ex.com/a.js"), ("style", "https://ex.com/s.css")]


def test_structured_data(pages):
    found = content.extract_structured(pages)
    assert found.filter("page_id = 2").first().og == {"og:title": "y"}
    types = content.page_types(found).filter("page_id = 2").orderBy("ord").collect()
    assert [r.type for r in types] == ["A", "B", "Org ***@***.***", "Unknown", "Unknown"]


def test_forms(pages):
    fields = content.form_fields(content.extract_forms(pages)).filter("page_id = 2").orderBy("field_ord").collect()
    assert [(f.name, f.type, f.required, f.placeholder, f.labelled) for f in fields] == [
        ("e", "email", True, "p q", True), ("c", "select-one", False, "", False), ("t", "textarea", False, "", True),
        ("free", "text", False, "", False),
    ]
    assert {(f.method, f.action) for f in fields} == {("POST", "https://ex.com/r")}
    inventory = {r.type: r for r in content.field_inventory(content.form_fields(content.extract_forms(pages))).filter("site = 'ex.com'").collect()}
    assert inventory["email"].required == 1 and inventory["text"].fields == 1


def test_feed_hints(spark, pages):
    got = rows(links.feed_link_hints(pages.filter("page_id = 2"), limit=3), "feed_url")
    assert got == [("https://ex.com/atom",)], "the foreign feed counts for the cut but drops afterwards"
    bare = spark.createDataFrame([(1, "https://ex.com/x", "<p>")], "page_id bigint, url string, html string")
    assert [r[0] for r in rows(links.feed_link_hints(bare), "feed_url")] == [
        "https://ex.com/feed", "https://ex.com/rss", "https://ex.com/atom.xml"
    ]
    four = "".join(f'<link rel=feed href="{h}">' for h in ("https://o.example/1", "/2", "/3", "/4"))
    cut = spark.createDataFrame([(1, "https://ex.com/x", four)], "page_id bigint, url string, html string")
    assert [r[0] for r in rows(links.feed_link_hints(cut, limit=3), "feed_url")] == ["https://ex.com/2", "https://ex.com/3"]


def test_declared_styles(pages):
    seen = style.count_styles(style.declared_styles(pages.filter("page_id = 2"))).collect()
    assert {(r.value, r.cnt) for r in seen if r.kind == "color"} == {("#fff", 1), ("red", 1)}
    font = [r for r in seen if r.kind == "font"][0]
    assert (font.family, font.size, font.tag) == ("Inter, sans-serif", "12px", "H1")


def test_seo_and_markup(pages):
    seo = content.seo_audit(pages).filter("page_id = 2").first()
    assert seo.h1_differs and seo.og_image_missing and not seo.og_title_missing and not seo.canonical_missing
    assert seo.issues == 3
    checks = content.markup_checks(pages).filter("page_id = 2").first()
    assert (checks.has_header, checks.has_nav, checks.has_main, checks.has_footer) == (True, False, True, True)
    assert checks.alt_state == "partial" and checks.has_form and checks.has_label


def test_entities_of_any_kind(spark):
    import html as stdlib_html

    texts = ["a &amp;lt; b &lt;", "caf&eacute; &#8217;x&#x1F600; &hellip; &unknown; & &copy;", "plain & text", "&nbsp;&middot;", "&#39;&apos;&Auml;", "&#146;&#x80;", "&#9999999;&#xD800;&#0;&#xFFFFFF;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(H.decode_entities(F.col("t"))).collect()]
    assert got == [stdlib_html.unescape(t) for t in texts]


def test_pages_without_html_stay(spark):
    df = spark.createDataFrame([(1, "http://e.example/", None), (2, "http://e.example/2", "")], "page_id bigint, url string, html string")
    got = content.extract_content(df).orderBy("page_id").collect()
    assert [(r.page_id, r.body_text, r.word_count) for r in got] == [(1, "", 0), (2, "", 0)]
    assert content.page_records(df).count() == 2 and links.extract_links(df).count() == 0


def test_types_in_lists_of_any_depth(spark):
    def block(depth):
        return "[" * depth + '{"@type": "Deep", "x": [1, [2]]}, {"@type": ["A", "B"]}, 3' + "]" * depth

    rows = spark.createDataFrame([(d, [block(d), '{"@type": "Last"}']) for d in (1, 5, 6, 9, 40, 300)], "page_id int, json_ld array<string>")
    got = content.page_types(rows).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", "type"))).alias("t")).collect()
    assert len(got) == 6
    for r in got:
        assert [t.type for t in r.t] == ["Deep", "A", "B", "Unknown", "Last"], r.page_id


class Pass:
    """Stands for a DataFrame; mapInArrow gives the function that a task runs."""

    def __init__(self, schema):
        self.schema = schema

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_parser_pass_takes_a_large_batch_in_pieces(pages):
    html = "<body>" + "<a href='/x'>text</a>" * 10_000 + "</body>"
    bodies = [None, "", html, *["<form><input name=a></form>" + html[:50_000]] * 90, html * 8, None]
    batch = pa.RecordBatch.from_pydict(
        {"page_id": list(range(len(bodies))), "url": ["https://ex.com/"] * len(bodies), "html": pa.array(bodies, pa.string())}
    )
    got = list(dom.parse_nodes(Pass(pages.schema))(iter([batch, batch.slice(5, 0), batch.slice(3, 2)])))
    assert [i for b in got for i in b.column("page_id").to_pylist()] == [*range(len(bodies)), 3, 4]
    whole = pa.array([elements.of_page(html) for html in bodies], got[0].column("nodes").type)
    assert pa.concat_arrays([b.column("nodes") for b in got])[: len(bodies)].equals(whole)
    held = [sum(len(bodies[i] or "") for i in b.column("page_id").to_pylist()) for b in got]
    assert len(got) >= 6 and all(n <= elements.PIECE or b.num_rows == 1 for n, b in zip(held, got))
