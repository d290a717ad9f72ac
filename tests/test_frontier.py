import random
from collections import defaultdict

import pytest

from crawlscope.operators import frontier

O = "https://s.example"


def run(spark, seeds, edges, prefixes, failed, max_pages, max_depth):
    seed_df = spark.createDataFrame([("s.example", u, [i]) for i, u in enumerate(seeds)], "site string, url string, ord array<bigint>")
    edge_df = spark.createDataFrame([("s.example", s, d, i) for s, d, i in edges], "site string, src string, dst string, link_ord bigint")
    rules = spark.createDataFrame([("s.example", prefixes)], "site string, prefixes array<string>")
    bad = spark.createDataFrame([("s.example", u) for u in failed], "site string, url string")
    plan = frontier.crawl_plan(seed_df, edge_df, rules, bad, max_pages, max_depth)
    return [(r.url, r.depth, r.visit_ord, r.status) for r in plan.orderBy("visit_ord").collect()]


def u(n):
    return f"{O}/{n}"


def test_cycle_diamond_blocked_and_budget(spark):
    edges = [(u("r"), u("a"), 0), (u("r"), u("b"), 1), (u("r"), u("private/x"), 2), (u("a"), u("r"), 0), (u("a"), u("c"), 1), (u("b"), u("c"), 0), (u("b"), u("d"), 1), (u("c"), u("e"), 0), (u("a"), "https://else.example/z", 2)]
    # b fails, so d is never linked from an opened page; the other site and the private page stay out.
    whole = [
        (u("r"), 0, 1, "ok"), (u("private/seed"), 0, 2, "blocked"), (u("a"), 1, 3, "ok"), (u("b"), 1, 4, "failed"), (u("c"), 2, 5, "ok"), (u("e"), 3, 6, "ok"),
    ]
    for pages, depth, n in ((None, None, 6), (8, 2, 5), (4, 5, 4), (3, 2, 3), (1, 0, 1)):
        assert run(spark, [u("r"), u("private/seed")], edges, ["/", "/private"], [u("b")], pages, depth) == whole[:n]


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs_keep_the_rules_of_a_crawl(spark, seed):
    rng = random.Random(seed)
    names = [u(rng.choice(["p/", "q/", ""]) + str(i)) for i in range(25)]
    edges = [(s, d, i) for i, (s, d) in enumerate(sorted({(rng.choice(names), rng.choice(names)) for _ in range(70)}))]
    seeds, failed, deepest = names[:3], rng.sample(names, 4), rng.choice([1, 3])
    plan = run(spark, seeds, edges, ["/p"], failed, None, deepest)
    depth = {url: d for url, d, _, _ in plan}
    place = {url: n for url, _, n, _ in plan}
    status = {url: s for url, _, _, s in plan}
    private = lambda url: url.startswith(f"{O}/p")
    assert len(depth) == len(plan) and [n for _, _, n, _ in plan] == list(range(1, len(plan) + 1))
    assert [d for _, d, _, _ in plan] == sorted(depth.values()) and max(depth.values()) <= deepest
    assert [url for url, d, _, _ in plan if d == 0] == seeds
    for url in depth:
        assert status[url] == ("blocked" if private(url) else "failed" if url in failed else "ok")
        assert url in seeds or not private(url)
    opened = {url for url in depth if status[url] == "ok" and depth[url] < deepest}
    first = defaultdict(lambda: (10**9, 0))
    for s, d, i in edges:
        if s in opened and not private(d):
            assert d in depth and depth[d] <= depth[s] + 1
            first[d] = min(first[d], (place[s], i))
    for a, b in zip(plan, plan[1:]):
        if a[1] > 0:
            parents = [s for s, d, _ in edges if d == a[0] and s in opened]
            assert depth[a[0]] == 1 + min(depth[s] for s in parents)
            if a[1] == b[1]:
                assert first[a[0]] < first[b[0]]
    # A budget is a prefix of the plan without one.
    for budget in (1, 5, 12):
        assert run(spark, seeds, edges, ["/p"], failed, budget, deepest) == plan[:budget]


def test_limits(spark):
    with pytest.raises(ValueError):
        frontier.crawl_plan(None, None, None, None, 0, 2)


def test_journeys(spark):
    plan = spark.createDataFrame(
        [("s", u("r"), 0, 1, "ok"), ("s", u("contact"), 2, 2, "ok"), ("s", u("shop"), 3, 3, "ok"), ("s", u("deep/about"), 5, 4, "ok"), ("s", u("login"), 1, 5, "failed")],
        "site string, url string, depth bigint, visit_ord bigint, status string",
    )
    goals = {"contact": "/contact", "shop": "/shop", "about": "about$", "login": "/login"}
    got = {r.goal: (r.steps, r.grade) for r in frontier.journey_steps(plan, goals).collect()}
    assert got == {"contact": (3, "good"), "shop": (4, "fair"), "about": (6, "poor"), "login": (None, "poor")}


def test_shortest_paths_to_goals(spark):
    from collections import deque

    rnd = random.Random(6)
    names = [f"https://s.example/{i}" + ("/goal" if i in (17, 23) else "/chain" if i == 32 else "") for i in range(33)]
    links = [(a, b, k) for a in range(25) for k, b in enumerate(rnd.sample(range(25), 2))] + [(a, a + 1, 9) for a in range(25, 32)] + [(0, 25, 5)]
    edges = spark.createDataFrame([("s.example", names[a], names[b], k) for a, b, k in links], "site string, src string, dst string, link_ord bigint")
    seeds = spark.createDataFrame([("s.example", names[0], [0]), ("t.example", "https://t.example/", [0])], "site string, url string, ord array<bigint>")
    rules = spark.createDataFrame([], "site string, prefixes array<string>")
    plan = frontier.crawl_plan(seeds, edges, rules)
    goals = {"goal": "/goal$", "chain": "/chain$", "home": "^/0$", "none": "/nothing$"}
    navigation = spark.createDataFrame([("s.example", names[0]), ("s.example", names[17])], "site string, url string")
    got = {(r.site, r.goal): r for r in frontier.journey_paths(plan, edges, goals, navigation).collect()}

    follow = {}
    for a, b, _ in sorted(links, key=lambda x: x[2]):
        follow.setdefault(a, []).append(b)
    before, queue, order = {0: None}, deque([0]), []
    while queue:
        a = queue.popleft()
        order.append(a)
        for b in follow.get(a, []):
            if b not in before:
                before[b] = a
                queue.append(b)

    def path(i):
        return ([] if before[i] is None else path(before[i])) + [names[i]]

    want = {"goal": next(i for i in order if names[i].endswith("/goal")), "chain": 32, "home": 0}
    for goal, i in want.items():
        r = got["s.example", goal]
        assert (r.goal_url, r.path, r.steps) == (names[i], path(i), len(path(i)))
    assert len(got["s.example", "chain"].path) == 9 and got["s.example", "chain"].grade == "poor"
    assert (got["s.example", "home"].grade, got["s.example", "home"].in_navigation) == ("good", True)
    nothing = got["s.example", "none"]
    assert (nothing.goal_url, nothing.path, nothing.steps, nothing.grade) == (None, None, None, "poor")
    assert len(got) == 8 and got["t.example", "home"].path is None
