"""The secret scan against the patterns as they are stated, and the Markov models on labelled strings."""

import hashlib
import random
import re
import string

import pytest

from crawlscope.llm import secrets
from crawlscope.llm.common import table

SMALL = "/root/testdata/sf0.001"


KEYWORDS = "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
STATED = (
    ("assign", re.compile(rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def stated(text):
    spans = [(m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(STATED) for m in p.finditer(text or "") if ok(m)]
    return [f"{name}:{a}:{b}" for a, _, b, name in sorted(spans)]


def check(frame, rows):
    got = sorted((tuple(r) for r in frame.collect()), key=str)
    assert len(got) == len(rows)
    texts = {}
    for doc_id, text in rows:
        texts.setdefault(doc_id, []).append(text)
    for doc_id, n_assign, n_access, n_hex, digest, spans in got:
        wanted = [stated(t) for t in texts[doc_id]]
        base = [s for s in spans.split(",") if s and not s.startswith("markov")]
        assert base in wanted
        assert digest == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [n_assign, n_access, n_hex] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]
    return got


def test_base_patterns_on_the_whole_table(spark):
    docs = table(spark, SMALL, "documents")
    check(secrets.report(secrets.scan(docs)), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_base_patterns_on_hard_texts(spark):
    rng = random.Random(4)
    parts = ["password", "PassWD", "token", "api_key", "APIKEY", "ſecret", "secret", "=", ":", " ", '"', "'", "AKIA", "A1B2C3D4E5F6G7H8", "deadbeef0123", "abc", "-", ".", "é", "🙂", "K", "\n", "x_Y"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randrange(60)))) for i in range(400)]
    check(secrets.report(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"))), rows)


@pytest.mark.parametrize("name", ["odd_docs", "clashing", "no_docs"])
def test_odd_rows(request, name):
    docs = request.getfixturevalue(name)
    check(secrets.report(secrets.scan(docs)), [(r["doc_id"], r["text"]) for r in docs.collect()])


def random_string(rng, n=32):
    return "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))


def test_models_add_random_tokens_and_leave_identifiers(spark):
    rng = random.Random(9)
    syllables = ["get", "user", "name", "list", "item", "value", "count", "index", "table", "row", "key", "file", "path", "load", "save"]
    name = lambda: "_".join(rng.choice(syllables) for _ in range(5))
    samples = [(random_string(rng), 1) for _ in range(300)] + [(name(), 0) for _ in range(300)] + [(str(rng.randrange(10**18)), 0) for _ in range(100)]
    samples += [(None, 1), ("", 0)]
    ratio = secrets.train_from_samples(spark.createDataFrame(samples, "value string, label int"))
    new = [(i, f"see {random_string(rng)} and {name()} é 1234567890123456789") for i in range(100)]
    found = secrets.scan(spark.createDataFrame(new, "doc_id long, text string"), ratio).collect()
    hits = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in found}
    assert sum((4, 36) in h for h in hits.values()) >= 97
    assert sum(len(h) for h in hits.values()) <= 105


def test_models_train_on_the_texts_themselves(spark):
    rng = random.Random(11)
    rows = [(i, f'the value of token = "{random_string(rng)}" should stay hidden in ordinary sentences of words') for i in range(200)]
    rows.append((999, f"bare {random_string(rng, 40)} here, internationalization stays, so does counterrevolutionaries"))
    spans = {r["doc_id"]: r["spans"] for r in secrets.report(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert spans[999] == "markov:5:45"
    assert spans[0] == "assign:13:54"


def test_free_tokens_equal_the_pairwise_test():
    rng = random.Random(5)
    parts = ["token=", "password: ", "deadbeef" * 3, "AKIA" + "Z9" * 9, "a_long_identifier_here", "Xy9/" * 6, " ", "é", '"', "short", "=", "\n"]
    for _ in range(500):
        text = "".join(rng.choices(parts, k=rng.randrange(40)))
        found = secrets.base_spans(text)
        long_ = [m for m in secrets.TOKEN.finditer(text) if m.end() - m.start() >= secrets.LEAST_TOKEN]
        free = [(m.start(), m[0]) for m in long_ if not any(a < m.end() and m.start() < b for a, _, b in found)]
        assert secrets.free_tokens(text, found) == free


def test_a_text_of_very_many_spans_and_tokens(spark):
    n = 40_000
    text = " ".join(f"token=abc{i:09d} an_identifier_of_number_{i:09d}" for i in range(n))
    rows = secrets.report(secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()
    assert rows[0]["n_assign"] == n and rows[0]["spans"].count("assign") == n
