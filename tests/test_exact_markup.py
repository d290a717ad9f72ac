"""Markup that differs from the usual template: quoting, attribute order, entities, nested data."""

import time

from pyspark.sql import functions as F

from crawlscope.functions import html as H
from crawlscope.operators import content, links, report, style, tech


def pages(spark, *bodies):
    return spark.createDataFrame([(i, "https://ex.com/p", b) for i, b in enumerate(bodies)], "page_id bigint, url string, html string")


def test_attributes_are_not_read_inside_quoted_values(spark):
    tags = [
        ('<img alt="see src=bad here" src="/good.png">', "src", "/good.png"),
        ("<meta title='a content=evil' content=good>", "content", "good"),
        ("<img data-src=no src = '/a b'>", "src", "/a b"),
        ("<input disabled name=x>", "name", "x"),
        ("<a\nHREF=/u>", "href", "/u"),
        ("<img alt=src>", "src", ""),
        ("<br/>", "src", ""),
        ("<img srcset=x src=>", "src", ""),
    ]
    for tag, name, want in tags:
        got = spark.createDataFrame([(tag,)], "t string").select(H.attribute(F.col("t"), name)).first()[0]
        assert got == want, tag


def test_rel_is_compared_whole(spark):
    found = links.extract_assets(pages(spark, '<link rel="stylesheet preload" href=/no.css><link href="/yes.css" rel=StyleSheet>')).collect()
    assert [(r.kind, r.src) for r in found] == [("style", "https://ex.com/yes.css")]


def test_both_routes_give_the_same_text(spark):
    body = "<p>Hello &check; &lpar;x&rpar;</p><noscript>no</noscript><template>t</template>"
    rows = content.extract_content(pages(spark, f"<body>{body}</body>", f'<body><div id="content">{body}</div></body>')).orderBy("page_id").collect()
    assert [r.body_text for r in rows] == ["Hello ✓ (x)"] * 2


def test_types_of_form_fields(spark):
    html = '<form><select multiple name=a></select><select name=b></select><input type=bogus name=c><input type=EMAIL name=d></form>'
    fields = content.form_fields(content.extract_forms(pages(spark, html))).orderBy("field_ord").collect()
    assert [f.type for f in fields] == ["select-multiple", "select-one", "text", "email"]


def test_section_images_are_absolute(spark):
    row = content.extract_content(pages(spark, '<main><section><h2>A</h2><img src="i/x.png"></section></main>')).first()
    assert [i.src for i in row.sections[0].images] == ["https://ex.com/i/x.png"]


def test_nested_lists_of_structured_data(spark):
    block = '[[{"@type":"A"}],[[{"@type":["B","C"]}]],{"x":1}]'
    assert spark.createDataFrame([(block,)], "b string").select(content.structured_types(F.col("b"))).first()[0] == ["A", "B", "C", "Unknown"]


def test_colours_without_a_value_are_left_out(spark):
    html = "<style>a{color:var(--x)} b{color:rgba(0,0,0,0)} c{color:red} d{color:rgba(0, 0, 0, 0)}</style>"
    assert [r.value for r in style.declared_styles(pages(spark, html)).filter("kind = 'color'").collect()] == ["red"]


def test_palette_sums_all_colours_of_a_page(spark):
    rows = [("s", p, f"rgb({c}, 0, 0)", 40 - c if p == 1 else 1, c) for p in (1, 2) for c in range(40)]
    obs = spark.createDataFrame(rows, "site string, page_id bigint, value string, cnt bigint, ord bigint")
    whole = {r.value: r.cnt for r in style.palette(obs, k=None).collect()}
    assert len(whole) == 40 and whole["rgb(39, 0, 0)"] == 2
    assert len(style.palette(obs, k=None, per_page=25).collect()) == 25


def test_fingerprints_look_at_tags_and_scripts_only(spark):
    prose = "<link rel=canonical href=/bootstrap-guide><meta name=description content='about WordPress'><p>__NEXT_DATA__ id=\"__next\" jquery.js</p><!-- <script src=jquery.js></script> -->"
    real = [
        ("<script>window.__NEXT_DATA__={}</script>", "Next.js"), ("<script id=__NEXT_DATA__ type=application/json>{}</script>", "Next.js"),
        ("<div id='__next'>", "React"), ("<div data-reactroot>", "React"), ("<meta content='WordPress 6' name=generator>", "WordPress"),
        ("<body class='a wp-b'>", "WordPress"), ("<link href=/bootstrap.css rel=stylesheet>", "Bootstrap"), ("<script src=/jquery-3.1.js></script>", "jQuery"),
    ]
    found = {r.page_id: (r.name, r.version) for r in tech.detect_frameworks(pages(spark, prose, *[h for h, _ in real])).collect()}
    assert {i: n for i, (n, _) in found.items()} == {i + 1: name for i, (_, name) in enumerate(real)}
    assert found[8] == ("jQuery", "3.1")


def test_no_calls_are_no_evidence(spark):
    findings = spark.createDataFrame([("a", "x", "Confirmed"), ("b", "x", "Confirmed"), ("c", "x", "Unknown")], "site string, item string, state string")
    gates = spark.createDataFrame([("a", "Confirmed")], "site string, confidence_cap string")
    assert {r.site: r.state for r in report.cap_confidence(findings, gates).collect()} == {"a": "Confirmed", "b": "Hypothesis", "c": "Unknown"}


def test_a_page_with_very_many_links(spark):
    html = "<nav>" + "".join(f"<a href='/l{i}'>t{i}</a>" for i in range(16_000)) + "</nav>"
    links.extract_links(pages(spark, "<a href=/>x</a>"), ["page"]).count()
    began = time.time()
    assert links.page_links(links.extract_links(pages(spark, html), ["page"])).count() == 16_000
    assert time.time() - began < 10
