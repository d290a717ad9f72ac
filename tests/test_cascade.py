"""The cascade of a page against a plain restatement, and what a browser reports in written-out cases."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crawlscope import dims
from crawlscope.functions import cascade as C
from crawlscope.operators import style

BASE, WIDTH = dims.BASE_STYLES, dims.VIEWPORT_WIDTH


def computed(html):
    return C.cascade(html, BASE, WIDTH)


def by_id(html):
    return {e.attrs["id"]: e.style for e in computed(html) if "id" in e.attrs}


def test_order_specificity_importance_and_inheritance():
    got = by_id(
        """<style>p { color: red } .a { color: #00f } #x { color: rgb(0 128 0) } p.a { color: navy } * { color: gray }
        .late { color: #123 } .late { color: #456 } .i { color: lime !important }
        div { color: hsl(120, 100%, 25%); font: italic bold 20px/1.5 'Open  Sans', serif } div span { font-size: 50%; font-weight: lighter }
        em { color: inherit; border-color: red blue } u { color: currentcolor; background: url("a;b.png") #abc no-repeat }</style>
        <p id=p>1</p><p class=a id=pa>2</p><p class=a id=x>3</p><i class="late" id=late>4</i>
        <p class=i id=imp style="color: black">5</p><p id=inline style="COLOR : rgba(1,2,3,.5)">6</p><p id=bad style="color: nocolor; color:">7</p>
        <div id=d><span id=s>8</span><em id=e>9</em><u id=u>10</u></div>"""
    )
    assert {k: v["color"] for k, v in got.items()} == {
        "p": "rgb(255, 0, 0)", "pa": "rgb(0, 0, 128)", "x": "rgb(0, 128, 0)", "late": "rgb(68, 85, 102)", "imp": "rgb(0, 255, 0)",
        "inline": "rgba(1, 2, 3, 0.5)", "bad": "rgb(255, 0, 0)", "d": "rgb(0, 128, 0)", "s": "rgb(128, 128, 128)", "e": "rgb(0, 128, 0)", "u": "rgb(0, 128, 0)",
    }
    assert (got["d"]["font-family"], got["d"]["font-size"], got["d"]["font-weight"]) == ('"Open Sans", serif', 20, 700)
    assert (got["s"]["font-family"], got["s"]["font-size"], got["s"]["font-weight"]) == ('"Open Sans", serif', 10, 400)
    assert C._border(got["e"]) == "rgb(255, 0, 0) rgb(0, 0, 255)" and C._border(got["p"]) == "rgb(255, 0, 0)"
    assert got["u"]["background-color"] == "rgb(170, 187, 204)" and got["p"]["background-color"] == C.CLEAR


@pytest.mark.parametrize(
    "selector,ids",
    [
        ("nav > a", "a b"), ("nav a", "a b c"), ("a + a", "b"), ("a ~ p", "p"), ("a:first-child", "a c"), ("#nav .k[href]", "b"), ("[href='/b?x=1,2']", "b"),
        ('[class~="k"]', "b"), ("[href^='/']", "a b c"), ("nav *:last-child", "p c"), ("body>nav>p a", "c"), ("a:hover, p", "p"), ("a::before", ""), (":root", ""), ("q, a.k", "b"),
        ("nav>a+a~p>a", "c"), ("a:link", "a b c"), ("NAV A", "a b c"), ("*", "nav a b p c"),
    ],
)
def test_selectors(selector, ids):
    html = f"<style>{selector} {{ color: #010203 }}</style><nav id=nav><a id=a href=/a>1</a><a id=b class='j k' href='/b?x=1,2'>2</a><p id=p>3<a id=c href=/c>4</a></nav>"
    assert [k for k, v in by_id(html).items() if _own(html, k)] == ids.split()


def _own(html, name):
    """Whether the rule holds for the element itself: its border does not come from its parent."""
    plain = by_id(html.replace("color: #010203", "border-color: #010203"))
    return plain[name]["border-top-color"] == "rgb(1, 2, 3)"


def test_sheets_that_apply():
    sheet = "@charset 'x'; @import url(a.css); @media print { a { color: red } } @media screen and (min-width: 1000px) { a { color: #111 } }"
    html = f"<style>{sheet}/* a {{ color: blue }} */ @font-face {{ font-family: X }} @keyframes k {{ 0% {{ color: red }} }}</style><style media=print>a {{ color: red }}</style><a id=a href=/>x</a>"
    assert by_id(html)["a"]["color"] == "rgb(17, 17, 17)"
    assert by_id(html.replace("1000px", "3000px"))["a"]["color"] == "rgb(0, 0, 238)"


def test_colors_as_a_browser_reports_them():
    cases = {
        "#abc": "rgb(170, 187, 204)", "#AABBCC80": "rgba(170, 187, 204, 0.502)", "transparent": C.CLEAR, "rgb(300, -1, 12.6)": "rgb(255, 0, 13)", "rgb(10% 20% 30% / 50%)": "rgba(26, 51, 77, 0.5)",
        "hsl(0, 100%, 50%)": "rgb(255, 0, 0)", "hsla(240deg 100% 50% / 1)": "rgb(0, 0, 255)", "RebeccaPurple": "rgb(102, 51, 153)", "#ab": None, "rgb(1,2)": None, "rgb(a,b,c)": None, "": None,
    }
    assert {k: C.color_of(k) for k in cases} == cases


def test_trees_of_careless_markup():
    tags = [(e.tag, e.parent.tag if e.parent else None) for e in computed("text<p>a<p>b<ul><li>c<li>d</ul><table><tr><td>e<td>f<tr><td>g</table><a href=1>h<a href=2>i<br/></nothing>")]
    assert tags == [
        ("html", None), ("head", "html"), ("body", "html"), ("p", "body"), ("p", "body"), ("ul", "body"), ("li", "ul"), ("li", "ul"),
        ("table", "body"), ("tr", "table"), ("td", "tr"), ("td", "tr"), ("tr", "table"), ("td", "tr"), ("a", "body"), ("a", "body"), ("br", "a"),
    ]
    for html in (None, "", "<", "<style>a{", "<style>}}{{", "<body class=x><body id=y>"):
        assert [e.tag for e in computed(html)][:1] == ["html"]


NAMES, CLASSES = ["div", "p", "span", "em"], ["a", "b", "c"]
compound = st.builds(lambda t, c: (t, tuple(sorted(c))), st.sampled_from([*NAMES, "*"]), st.sets(st.sampled_from(CLASSES), max_size=2))
rule = st.tuples(st.lists(st.tuples(st.sampled_from([" ", ">", "+", "~"]), compound), min_size=1, max_size=4), st.integers(0, 250), st.booleans())


@settings(max_examples=150, deadline=None)
@given(seed=st.integers(0, 10**6), rules=st.lists(rule, max_size=8))
def test_random_pages_as_a_plain_restatement(seed, rules):
    rnd = random.Random(seed)
    nodes = []  # (parent, position among the children, tag, classes, color of the style attribute)

    def grow(parent, depth):
        out = ""
        for position in range(rnd.randrange(4) if depth else 3):
            me, tag = len(nodes), rnd.choice(["div", "span", "em"])
            classes, own = {c for c in CLASSES if rnd.random() < 0.3}, rnd.choice([None, None, None, rnd.randrange(250)])
            nodes.append((parent, position, tag, classes, own))
            attrs = f" class='{' '.join(classes)}'" * bool(classes) + (f" style='color:rgb(0,0,{own})'" if own is not None else "")
            out += f"<{tag}{attrs}>{grow(me, depth - 1) if depth else 'x'}</{tag}>"
        return out

    markup = grow(None, 3)

    def text(steps):
        return "".join((" " if i and j == " " else j if i else "") + t + "".join("." + c for c in cs) for i, (j, (t, cs)) in enumerate(steps))

    sheet = "".join(f"{text(steps)} {{ color: rgb({n}, 1, 1) {'!important' if strong else ''} }}" for steps, n, strong in rules)

    def fits(i, one):
        return one[0] in ("*", nodes[i][2]) and set(one[1]) <= nodes[i][3]

    def reached(i, joint):
        """Elements that stand in the relation to i, going forward."""
        for k, (parent, position, *_) in enumerate(nodes):
            if joint == ">" and parent == i or joint == "+" and parent == nodes[i][0] and position == nodes[i][1] + 1:
                yield k
            if joint == "~" and parent == nodes[i][0] and position > nodes[i][1]:
                yield k
            while joint == " " and parent is not None:
                if parent == i:
                    yield k
                    break
                parent = nodes[parent][0]

    best = {}
    for order, (steps, n, strong) in enumerate(rules):
        hit = {i for i in range(len(nodes)) if fits(i, steps[0][1])}
        # The page's own ancestors: html and body fit a first "*" and have all others below them.
        root = steps[0][1] == ("*", ())
        for place, (joint, one) in enumerate(steps[1:], 1):
            new = {k for i in hit for k in reached(i, joint) if fits(k, one)}
            if root:
                new |= {k for k, node in enumerate(nodes) if fits(k, one) and (joint == " " or joint == ">" and node[0] is None)}
            # html > body, html > head + body are matched by "*" too.
            root = root and one == ("*", ()) and (joint in (" ", ">") or (joint in "+~" and place == 1))
            hit = new
        weight = (sum(len(cs) for _, (_, cs) in steps), sum(t != "*" for _, (t, _) in steps))
        for i in hit:
            best[i] = max(best.get(i, ((False, -1, (0, 0), -1), "")), ((strong, 0, weight, order), f"rgb({n}, 1, 1)"))
    # Only rules that need no ancestors besides the drawn elements are compared exactly.
    if any(steps[0][1] == ("*", ()) and len(steps) > 1 for steps, _, _ in rules) or any(steps == [s for s in steps if s[1] == ("*", ())] for steps, _, _ in rules):
        return
    expected = []
    for i, (parent, _, _, _, own) in enumerate(nodes):
        if own is not None and not best.get(i, ((False,),))[0][0]:
            expected.append(f"rgb(0, 0, {own})")
        else:
            expected.append(best[i][1] if i in best else expected[parent] if parent is not None else C.BLACK)
    got = [e.style["color"] for e in computed(f"<style>{sheet}</style><body>{markup}</body>") if e.tag in NAMES]
    assert got == expected


def test_page_observations_and_caps(spark):
    html = "<style>p{color:red;background:#000}h1{color:red}</style><body><h1>a</h1><p>b</p><p>c</p><span>d</span>"
    seen = C.page_styles(html, BASE, WIDTH, None, None)
    colors = [(s["value"], s["cnt"]) for s in seen if s["kind"] == "color"]
    # html, head, style, body and span are black twice, h1 and two p are red twice, p has a background.
    assert colors == [("rgb(0, 0, 0)", 10 + 2), ("rgb(255, 0, 0)", 6)]
    fonts = [(s["size"], s["weight"], s["tag"], s["cnt"]) for s in seen if s["kind"] == "font"]
    assert fonts == [("32px", "700", "H1", 1), ("16px", "400", "P", 3)]
    capped = C.page_styles(html, BASE, WIDTH, 5, 2)
    assert [(s["value"], s["cnt"]) for s in capped if s["kind"] == "color"] == [("rgb(0, 0, 0)", 8), ("rgb(255, 0, 0)", 2)]
    assert [(s["tag"], s["cnt"]) for s in capped if s["kind"] == "font"] == [("H1", 1), ("P", 1)]

    pages = spark.createDataFrame([(1, "https://a.org/", html), (2, "https://a.org/b", html), (3, "https://b.org/", None)], "page_id int, url string, html string")
    obs = style.computed_styles(pages)
    top = {(r.site, r.rank): (r.role, r.value, r.cnt) for r in style.palette(obs.filter("kind = 'color'"), per_page=25).collect()}
    assert top["a.org", 1] == ("Primary", "rgb(0, 0, 0)", 24) and top["a.org", 2] == ("Secondary", "rgb(255, 0, 0)", 12)
    assert top["b.org", 1] == ("Primary", "rgb(0, 0, 0)", 6)
    fonts = {(r.site, r.size): (r.weight, r.sample_tag, r.cnt) for r in style.typography(obs.filter("kind = 'font'"), per_page=20).collect()}
    assert fonts == {("a.org", "16px"): ("400", "P", 6), ("a.org", "32px"): ("700", "H1", 2)}


def test_counts_of_a_large_page():
    html = "<style>.a b{color:red}</style>" + "<div class=a><b>x</b></div><i>y</i>" * 2_000
    counts = Counter(e.style["color"] for e in computed(html) if e.tag == "b")
    assert counts == {"rgb(255, 0, 0)": 2_000}
