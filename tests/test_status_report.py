import datetime
import random

from crawlscope import dims
from crawlscope.operators import report, status

LOG = "site string, stage string, status string, ts timestamp, seq bigint, notes string, artifacts array<string>"


def at(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=n)


def brute(events, reset):
    """Replay one site's log: each event overwrites, empty artifacts keep, target done wipes later stages."""
    state = {s: ["pending", None, "", []] for s in dims.STAGES}
    for _, stage, stat, ts, _, notes, artifacts in sorted(events, key=lambda e: (e[3], e[4])):
        row = state[stage]
        state[stage] = [stat, ts.date() if stat == "done" else None, notes, artifacts or row[3]]
        if reset and stage == "target" and stat == "done":
            for later in dims.STAGES[1:]:
                state[later] = ["pending", None, "", []]
    return state


def test_status_and_reset_by_replay(spark):
    rng = random.Random(11)
    events = []
    for site in ("a", "b", "c"):
        for i in range(40):
            files = [] if rng.random() < 0.4 else [f"f{i}"]
            events.append((site, rng.choice(dims.STAGES), rng.choice(["done", "in_progress", "blocked"]), at(rng.randrange(30)), i, f"n{i}", files))
    events.append(("d", "ux", "done", at(1), 0, "", []))
    df = spark.createDataFrame(events, LOG)
    for job, reset in ((status.stage_status, False), (status.status_after_reset, True)):
        got = {}
        for r in job(df).collect():
            got.setdefault(r.site, {})[r.stage] = [r.status, r.completed_at, r.notes, r.artifacts]
        for site in "abcd":
            assert got[site] == brute([e for e in events if e[0] == site], reset), (site, reset)


def test_gates(spark):
    rows = [("s", stage, "done", at(i), i, "", []) for i, stage in enumerate(["target", "ux", "ia"])]
    gates = {r.stage: (r.missing, r.may_run) for r in status.gate_check(status.stage_status(spark.createDataFrame(rows, LOG))).collect()}
    assert gates == {"ux": ("", True), "ia": ("", True), "tech": ("", True), "db": ("tech", False), "report": ("tech,db", False)}


def summaries(spark):
    ux = spark.createDataFrame([("a", 3), ("b", 2)], "site string, page_count bigint")
    ia = spark.createDataFrame([("a", 4, 5)], "site string, page_count bigint, nav_items bigint")
    tech = spark.createDataFrame([("a", 2)], "site string, frameworks bigint")
    api = spark.createDataFrame([("a", 7), ("c", 0)], "site string, same_origin_calls bigint")
    return report.site_report(ux, ia, tech, api)


def test_metrics_gaps_and_requests(spark):
    joined = summaries(spark)
    metrics = {r.site: tuple(r)[1:] for r in report.report_metrics(joined).collect()}
    assert metrics == {"a": (4, 5, 2, 7), "b": (2, 0, 0, 0), "c": (0, 0, 0, 0)}
    gaps = {(r.site, r.item, r.state) for r in report.known_gaps(joined).collect()}
    assert gaps == {
        ("a", "none", "Confirmed"), ("b", "ia_summary", "Unknown"), ("b", "tech_summary", "Unknown"), ("b", "api_evidence", "Hypothesis"),
        ("c", "ux_summary", "Unknown"), ("c", "ia_summary", "Unknown"), ("c", "tech_summary", "Unknown"), ("c", "api_evidence", "Hypothesis"),
    }
    requests = [(r.site, r.request) for r in report.request_list(joined).orderBy("site", "ord").collect()]
    assert requests[:3] == [("a", dims.REQUESTS[0]), ("a", dims.REQUESTS[1]), ("b", dims.API_CAUTION_REQUEST)]
    classes = {r.site: (r.confirmed, r.hypothesis, r.unknown, r.follow_up) for r in report.confidence_rollup(report.known_gaps(joined)).collect()}
    assert classes == {"a": (1, 0, 0, False), "b": (0, 1, 2, True), "c": (0, 1, 3, True)}


def test_features(spark):
    sites = spark.createDataFrame([("a",), ("b",), ("c",)], "site string")
    nav = spark.createDataFrame([("a", "CONTACT"), ("a", "Products & Shop"), ("a", "문의"), ("b", "misc")], "site string, text string")
    features = report.site_features(nav, sites)
    got = {}
    for r in features.orderBy("site", "feature_ord").collect():
        got.setdefault(r.site, []).append(r.feature)
    assert got == {"a": ["home", "contact_form", "payment"], "b": dims.DEFAULT_FEATURES, "c": dims.DEFAULT_FEATURES}
    checklist = report.feature_checklist(features, sites)
    assert checklist.count() == 30 and checklist.filter("site = 'a' AND found").count() == 3


def test_cap_confidence(spark):
    findings = spark.createDataFrame([("a", "x", "Confirmed"), ("b", "x", "Likely"), ("b", "y", "Unknown"), ("c", "x", "Confirmed")], "site string, item string, state string")
    gates = spark.createDataFrame([("a", "Confirmed"), ("b", "Hypothesis")], "site string, confidence_cap string")
    got = {(r.site, r.item): r.state for r in report.cap_confidence(findings, gates).collect()}
    assert got == {("a", "x"): "Confirmed", ("b", "x"): "Hypothesis", ("b", "y"): "Unknown", ("c", "x"): "Hypothesis"}


def test_sections_have_a_default_line(spark):
    empty = "site string, rank bigint"
    palette = spark.createDataFrame([("a", i, "Primary", "#0", "v", i) for i in range(1, 8)], empty + ", role string, hex string, value string, cnt bigint")
    fonts = spark.createDataFrame([], empty + ", family string, size string, weight string")
    nav = spark.createDataFrame([], empty + ", text string, href string")
    stack = spark.createDataFrame([], "site string, name string, version string, confidence string, first_page bigint, rule_ord bigint")
    ends = spark.createDataFrame([("a", "https://a/x?y", 1), ("a", "https://a", 2)], "site string, url string, first_seq bigint")
    sites = spark.createDataFrame([("a",)], "site string")
    got = report.report_sections(palette, fonts, nav, stack, ends, sites).orderBy("section", "rank").collect()
    lines = {}
    for r in got:
        lines.setdefault(r.section, []).append(r.line)
    assert len(lines["palette"]) == 5 and lines["api"] == ["/x", "https://a"]
    assert lines["navigation"] == lines["typography"] == lines["frameworks"] == ["needs_more_data"]
