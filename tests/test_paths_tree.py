import hashlib
import random
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from crawlscope.functions import urls
from crawlscope.operators import paths, tree

E = "https://example.com"


def page_frame(spark, rows):
    """rows of (url, depth); the site is the host, the order the position."""
    data = [(u.split("/")[2], u, i, d) for i, (u, d) in enumerate(rows)]
    return spark.createDataFrame(data, "site string, url string, page_ord bigint, depth bigint")


def roots_of(spark, url):
    return spark.createDataFrame([(url.split("/")[2], url)], "site string, root_url string")


def test_content_paths(spark):
    def hashed(query):
        return hashlib.sha1(query.encode()).hexdigest()[:10]

    listed = ["/", "/about", "/about/team", "/search?q=1", "/?q=1", "/docs?v=2", "/docs/a/b", "/deep/x?y=1"]
    df = page_frame(spark, [(E + p, 0) for p in listed])
    rows = paths.content_paths(df, hot=1).collect()
    got = {r.url[len(E):]: (r.content_path.removeprefix("_audit/content/"), r.is_collision) for r in rows}
    assert got == {
        "/": ("_index.md", True),
        "/?q=1": ("_index.md", True),
        "/about": ("about/_index.md", False),
        "/about/team": ("about/team.md", False),
        "/search?q=1": ("search__q-7de36096ee.md", False),
        "/docs?v=2": (f"docs__q-{hashed('v=2')}.md", False),
        "/docs/a/b": ("docs/a/b.md", False),
        "/deep/x?y=1": (f"deep/x__q-{hashed('y=1')}.md", False),
    }


def test_children_under_query_urls_make_folders(spark):
    df = page_frame(spark, [(E + "/a", 0), (E + "/a/b?x=1", 1)])
    got = {r.url: r.content_path for r in paths.content_paths(df).collect()}
    assert got[E + "/a"] == "_audit/content/a/_index.md"


def test_page_sequence(spark):
    df = page_frame(spark, [(E + f"/p{i}", 0) for i in range(1200)])
    got = {r.page_no: r for r in paths.page_sequence(df).collect()}
    assert got[1].screenshot == "_audit/screenshots/001-p0-pc.png"
    assert got[1200].screenshot_mobile == "_audit/screenshots/1200-p1199-mobile.png"


def check(spark, pages, root, hot=1_000_000):
    """The rules of the tree, each on its own: parent one level up, order among siblings, reachability."""
    got = {r.url: r for r in tree.site_tree(page_frame(spark, pages), roots_of(spark, root), hot).collect()}
    listed = list(dict.fromkeys([*(u for u, _ in pages), root]))
    depth = {root: 0} | dict(pages)
    path = {u: urlsplit(u).path.rstrip("/") or "/" for u in listed}
    assert set(got) == set(listed) and got[root].parent_url is None
    siblings = {}
    for u in listed:
        if u == root:
            continue
        parent, above = got[u].parent_url, path[u].rpartition("/")[0] or "/"
        owners = [o for o in listed if path[o] == above]
        if not owners:
            assert parent == root, u
        else:
            assert path[parent] == above, u
            assert "?" not in parent or all("?" in o for o in owners), u
        siblings.setdefault(parent, []).append((depth[u], u))
    for members in siblings.values():
        assert [got[u].child_ord for _, u in sorted(members)] == list(range(1, len(members) + 1))
    for u in listed:
        at, steps = u, 0
        while at != root and steps <= len(listed):
            at, steps = got[at].parent_url, steps + 1
        assert got[u].in_tree == (at == root), u
    return got


def test_small_tree(spark):
    got = check(spark, [(E + "/", 0), (E + "/about", 1), (E + "/about/team", 2), (E + "/search?q=1", 1)], E + "/")
    assert got[E + "/about/team"].parent_url == E + "/about"
    assert all(r.in_tree for r in got.values())


def test_page_above_the_root_drops_out_with_its_children(spark):
    pages = [(E + "/en", 0), (E + "/", 1), (E + "/other", 1), (E + "/other/x", 2), (E + "/en/a", 1), (E + "/far/away/x", 2)]
    got = check(spark, pages, E + "/en")
    assert not got[E + "/"].in_tree and not got[E + "/other/x"].in_tree
    assert got[E + "/en/a"].in_tree and got[E + "/far/away/x"].in_tree


def test_missing_root_gets_a_row(spark):
    got = check(spark, [(E + "/a", 1), (E + "/a/b", 2)], E + "/")
    assert got[E + "/"].in_tree and got[E + "/a/b"].in_tree


def test_chain_of_1200_levels(spark):
    parts, pages = [], [(E + "/", 0)]
    for i in range(1, 1201):
        parts.append(f"l{i}")
        pages.append((E + "/" + "/".join(parts), i))
    got = tree.site_tree(page_frame(spark, pages), roots_of(spark, E + "/")).filter("in_tree")
    assert got.count() == 1201
    assert got.groupBy("parent_url").count().agg(F.max("count")).first()[0] == 1


def test_random_trees_with_tiny_hot_limit(spark):
    rng = random.Random(3)
    for root in ("/", "/a"):
        urls_ = {E + root: 0}
        for _ in range(150):
            path = "/".join(rng.choice("abc") for _ in range(rng.randrange(0, 5)))
            url = E + "/" + path + rng.choice(["", "", "?q=1", "?q=2"])
            urls_.setdefault(url, rng.randrange(4))
        check(spark, list(urls_.items()), E + root, hot=5)


def test_site_path(spark):
    df = spark.createDataFrame([("http://e.example",), ("http://e.example/a/",)], "u string")
    assert [r[0] for r in df.select(urls.site_path(F.col("u"))).collect()] == ["/", "/a"]
