from urllib.parse import parse_qsl, urljoin, urlparse

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crawlscope import dims
from crawlscope.functions import urls

BASE = "https://example.com/a/b/c?z=1#f"
CASES = [
    "https://example.com/about/?utm_source=newsletter&foo=1#team",
    "https://example.com/p?b=2&a=1&a=&b=%20z*~é",
    "https://example.com/p?q=a+b&r=%2B&s=~x-._",
    "https://example.com/p?blank&x=&=v",
    "https://example.com/p?x=%zz&y=%4",
    "https://example.com/p?utm_source=1",
    "https://example.com/p?&&a=1&",
    "https://example.com/p?a=1=2",
    "https://Example.COM:8080/Path///",
    "HTTP://user:pw@Host/x/",
    "//other.example/x",
    "../up",
    "../../../../far",
    "./here/./x/..",
    "/root/../x/",
    "rel",
    "rel/",
    "?only=query",
    "#frag",
    "",
    "mailto:a@b.example",
    "javascript:void(0)",
    "tel:010-1234-5678",
    "ftp://example.com/x",
    "http://example.com",
    "http://example.com?x=1",
    "/path;v=1?q=1",
    "/dir;p/leaf",
    "/%20a%2Fb/",
    "/한글/경로?이름=값",
    "/a//b///c",
    " /padded ",
    "..",
    ".",
]


# Given, base "https://example.com/a/b/c?x=1": canonical form.
NORMAL = [
    ("https://example.com/x/?utm_source=a&b=2&a=1#f", "https://example.com/x?a=1&b=2"),
    ("?only=query", None),
    ("#frag", None),
    ("/", "https://example.com/"),
    ("//other.example/p/", "https://other.example/p"),
    ("../up", None),
    ("mailto:a@b.example", ""),
    ("ftp://example.com/x", ""),
    ("http://example.com", "http://example.com/"),
    ("http://example.com?x=1", "http://example.com/?x=1"),
    ("/p?b=&a=1&a=0", "https://example.com/p?a=0&a=1&b="),
    ("/p?q=a b&gclid=3&ref=x", "https://example.com/p?q=a+b"),
    ("/p?q=%C3%A9~*", "https://example.com/p?q=%C3%A9~%2A"),
    ("/p///", "https://example.com/p"),
]


def run(spark, rows, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, u string, b string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_resolve_matches_rfc_join(spark):
    rows = [(u, b) for b in (BASE, "http://example.com", "http://example.com/dir/") for u in CASES]
    got = run(spark, rows, urls.resolve(F.col("u"), F.col("b")))
    for (u, b), g in zip(rows, got):
        assert g == urljoin(b, u.strip()), (u, b)


def test_normalize_written_out_pairs(spark):
    rows = [(u, BASE) for u, _ in NORMAL]
    got = run(spark, rows, urls.normalize(F.col("u"), F.col("b")))
    for (u, want), g in zip(NORMAL, got):
        if want is not None:
            assert (g or "") == want, u


def test_normal_forms_keep_their_properties(spark):
    got = [g for g in run(spark, [(u, BASE) for u in CASES], urls.normalize(F.col("u"), F.col("b"))) if g]
    assert got and run(spark, [(g, g) for g in got], urls.normalize(F.col("u"))) == got
    for g in got:
        parts = urlparse(g)
        names = [n for n, _ in parse_qsl(parts.query, keep_blank_values=True)]
        assert parts.scheme in ("http", "https") and not parts.fragment
        assert parts.path == "/" or not parts.path.endswith("/")
        assert names == sorted(names) and not set(names) & set(dims.TRACKING_KEYS)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="abz09/.?&=%+~*;-_é# ", max_size=25), min_size=20, max_size=20))
def test_normal_forms_of_random_paths(spark, tails):
    rows = [("/x" + t.strip(), BASE) for t in tails]
    got = run(spark, rows, urls.normalize(F.col("u"), F.col("b")))
    assert run(spark, [(g, g) for g in got], urls.normalize(F.col("u"))) == got
    for (u, b), g in zip(rows, got):
        # Fragments, order of parameters and tracking keys do not matter.
        assert "#" not in g and g.startswith("https://example.com/")
    joined = [(u.split("#")[0] + ("&" if "?" in u.split("#")[0] else "?") + "utm_source=q#f", b) for u, b in rows]
    assert run(spark, joined, urls.normalize(F.col("u"), F.col("b"))) == got


def test_dom_href_is_what_a_browser_reports(spark):
    rows = [("x y", "http://EX.com/a"), ("/für", "http://ex.com/"), ("HTTP://A.b", "http://ex.com/"), ("mailto:x@y", "http://ex.com/")]
    got = run(spark, rows, urls.dom_href(F.col("u"), F.col("b")))
    assert got == ["http://ex.com/x%20y", "http://ex.com/f%C3%BCr", "http://a.b/", "mailto:x@y"]


@pytest.mark.parametrize(
    "left,right,same",
    [
        ("http://a.example/x", "https://a.example/y", True),
        ("http://a.example:80/x", "http://a.example/y", False),
        ("http://a.example/x|y z", "http://a.example", True),
        ("http://A.example", "http://a.example", False),
    ],
)
def test_same_origin_compares_netloc_only(spark, left, right, same):
    assert run(spark, [(left, right)], urls.same_origin(F.col("u"), F.col("b"))) == [same]


def test_slug(spark):
    cases = {
        "https://e.example/": "home",
        "https://e.example/About Us/": "About-Us",
        "https://e.example/a?q=1&b=2": "a-q-1-b-2",
        "https://e.example/?!!": "home",
        "https://e.example/" + "x" * 100: "x" * 80,
    }
    assert run(spark, [(u, "") for u in cases], urls.slug(F.col("u"))) == list(cases.values())
