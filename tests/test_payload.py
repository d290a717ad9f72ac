"""Nested payload fields against a plain walk of the parsed JSON."""

import json
from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from crawlscope.operators import api

SCHEMA = "site string, url string, body string"


def walk(value, path="$"):
    if isinstance(value, dict):
        yield path, "OBJECT"
        for k, v in value.items():
            yield from walk(v, f"{path}.{k}")
    elif isinstance(value, list):
        yield path, "ARRAY"
        for v in value:
            yield from walk(v, f"{path}[]")
    else:
        yield path, {bool: "BOOLEAN", int: "BIGINT", str: "STRING", type(None): "VOID"}[type(value)]


def brute(rows):
    bodies, counts = Counter(), defaultdict(int)
    for site, url, body in rows:
        try:
            value = json.loads(body)
        except (TypeError, ValueError):
            continue
        bodies[site, url] += 1
        for field in set(walk(value)):
            counts[site, url, *field] += 1
    return sorted((*k, n, bodies[k[:2]]) for k, n in counts.items())


def found(spark, rows):
    return sorted(map(tuple, api.payload_fields(spark.createDataFrame(rows, SCHEMA)).collect()))


def test_changing_shapes_and_broken_bodies(spark):
    deep = json.dumps(eval("[" * 40 + "{'x': 1}" + "]" * 40))  # noqa: S307
    bodies = [
        '{"a": 1, "b": {"c": [1, "x", {"d": null}, []], "e": {}}}', '{"a": "1", "b": []}', '{"a": true}', "[1, 2]", '"text with { and ["', "3", "null", "{broken", "", None,
        '{"k.l": {"m n": [[1], [[]]]}, "é": "ß"}', deep,
    ]
    rows = [("s", f"u{i % 2}", b) for i, b in enumerate(bodies * 2)] + [("t", "u", bodies[0])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, [("s", "u", "{broken")]) == [] and found(spark, []) == []


value = st.recursive(st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.text("ab{[\"é", max_size=4), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text("xyé", min_size=1, max_size=3), v, max_size=3), max_leaves=12)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(values=st.lists(value, min_size=15, max_size=15))
def test_random_bodies(spark, values):
    rows = [("s", f"u{i % 3}", json.dumps(v, ensure_ascii=i % 2 == 0)) for i, v in enumerate(values)]
    assert found(spark, rows) == brute(rows)
