"""The Jaccard join against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from crawlscope.llm import jaccard
from crawlscope.llm.common import table

SMALL = "/root/testdata/sf0.001"



def grams(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(rows, n, num, den):
    sets = [grams(t, n) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and den * shared >= num * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (doc_id, _), g in zip(rows, group, strict=True):
        if doc_id is not None:
            least[g] = min(least.get(g, doc_id), doc_id)
    return Counter((doc_id, len(s), least.get(g)) for (doc_id, _), s, g in zip(rows, sets, group, strict=True))


def families(seed=3):
    """Base texts, chains of edits that link only step by step, copies, and a passage that many share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = " ".join(word() for _ in range(15))
    rows = []
    for f in range(40):
        words = [word() for _ in range(rng.choice([3, 6, 9, 14, 25, 60, 150]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            rows.append((len(rows), " ".join(words)))
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(len(words))] = word()
        if f % 3 == 0:
            rows.append((len(rows), passage + " " + " ".join(word() for _ in range(f))))
    rows += [(len(rows) + i, rows[0][1]) for i in range(5)]
    return rows


def got(frame):
    return Counter(tuple(r) for r in frame.collect())


@pytest.mark.parametrize(("n", "num", "limit"), [(4, 85, 2_000_000), (5, 80, 2_000_000), (2, 60, 300)])
def test_equals_all_pairs(spark, n, num, limit):
    rows = families(n)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard.jaccard_join(docs, n, num, 100, limit=limit, pivots=2)) == brute(rows, n, num, 100)


def test_query_on_the_whole_table(spark):
    docs = table(spark, SMALL, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(jaccard.jaccard_join(docs, 4, 85, 100)) == brute(rows, 4, 85, 100)


@pytest.mark.parametrize("name", ["odd_docs", "clashing"])
def test_odd_rows(request, name):
    docs = request.getfixturevalue(name)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(jaccard.jaccard_join(docs, 4, 85, 100)) == brute(rows, 4, 85, 100)
    kept = jaccard.one_of_each_class(docs, 4, 85, 100)
    assert kept.columns == docs.columns
    # 3 and 4 are one class and row 3 comes twice; 5 and 6 have nearly the same shingles.
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 3, None, None, 5, 7, 8])


def test_nothing(no_docs):
    assert jaccard.jaccard_join(no_docs).count() == 0
    assert jaccard.one_of_each_class(no_docs).count() == 0


def test_linked_sets_always_share_a_region():
    rng = np.random.default_rng(1)
    for size in [*range(1, 60), 150, 400, 1_000]:
        for _ in range(12):
            base = np.unique(rng.integers(1 << 63, size=size, dtype=np.uint64))
            keep = base[rng.random(len(base)) > rng.choice([0.02, 0.08, 0.15])]
            other = np.unique(np.concatenate([keep, rng.integers(1 << 63, size=int(rng.integers(0, 1 + size // 12)), dtype=np.uint64)]))
            shared = len(np.intersect1d(base, other))
            if not len(other) or 100 * shared < 85 * (len(base) + len(other) - shared) or np.array_equal(base, other):
                continue
            for share in (0.0, 0.5, 1.0):
                cold = lambda s: (s % np.uint64(1_000)).astype(float) >= 1_000 * share
                assert set(jaccard.signatures(base, cold(base), 85, 100).tolist()) & set(jaccard.signatures(other, cold(other), 85, 100).tolist())


def test_copies_in_any_order_of_ids_before_near_copies(spark):
    """One task and one piece hold copies whose ids descend or are null, and near copies of them after those."""
    texts = [" ".join(f"{name}{i}" for i in range(60)) for name in "abcd"]
    ids = [(9, 3, 4), (None, 7, 6), (None, None, 8), (12, None, 11)]
    rows = [(i, t + end) for t, (*same, near) in zip(texts, ids, strict=True) for i, end in [*((i, "") for i in same), (near, " end")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = brute(rows, 4, 85, 100)
    assert want[4, 58, 3] == 1 and want[6, 58, 6] == 1
    assert got(jaccard.jaccard_join(docs, 4, 85, 100)) == want
    assert Counter(r["doc_id"] for r in jaccard.one_of_each_class(docs, 4, 85, 100).collect()) == Counter([3, 6, 8, 11])


def region_classes(spark, sets, limit, pivots):
    """Classes by ``region_links`` over one island, next to classes by all pairs, at similarity 0.85."""
    rows = [(1, i + 1, sorted(s)) for i, s in enumerate(sets)]
    frame = spark.createDataFrame(rows, "island long, node long, elements array<long>")
    links = [tuple(r) for r in jaccard.region_links(frame, 85, 100, limit, pivots).collect()]
    true = [(i + 1, j + 1) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and 100 * len(a & b) >= 85 * len(a | b)]
    assert set(links) <= set(true)
    least = []
    for edges in (links, true):
        group = list(range(len(sets) + 1))
        for a, b in edges:
            if group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
        least.append([group.index(g) for g in group])
    return least


def edited(rng, base, times):
    out = [set(base)]
    for _ in range(times):
        out.append(set(out[-1]))
        out[-1].remove(rng.choice(sorted(out[-1])))
        out[-1].add(rng.randrange(1 << 40, 1 << 41))
    return out


@pytest.mark.parametrize("pivots", [2, 8])
def test_sets_equally_far_apart_are_joined_in_pairs_of_blocks(spark, pivots):
    """Half of each set is shared by all, so no cut parts them; chains of near copies lie among them."""
    rng = random.Random(pivots)
    shared = set(range(1, 21))
    sets = [s for _ in range(25) for s in edited(rng, shared | set(rng.sample(range(100, 1 << 30), 20)), rng.choice([0, 1, 5]))]
    got, want = region_classes(spark, sets, 500, pivots)
    assert got == want and len(set(want)) > 20


def test_one_large_class_and_few_open_sets(spark):
    """The largest class is never compared with itself, and still takes in what links to any of its members."""
    rng = random.Random(5)
    base = set(rng.sample(range(100, 1 << 30), 60))
    sets = [set(base) - {x} for x in sorted(base)] + edited(rng, base, 30) + edited(rng, set(list(base)[:30]), 12)
    got, want = region_classes(spark, sets, 1_000, 4)
    assert got == want and len(set(want)) < 12


def test_windows_make_a_row_per_region_and_pivot_not_per_set(spark):
    rng = random.Random(5)
    rows = [(rng.choice([7, -3, 11]), sorted(rng.sample(range(65), rng.choice([0, 1, 40]))), 0) for _ in range(3_000)]
    rows = [(region, held, [round(rng.random(), 3) for _ in held]) for region, held, _ in rows]
    schema = "region long, parts array<long>, away array<double>"
    kinds = pa.schema([("region", pa.int64()), ("parts", pa.list_(pa.int64())), ("away", pa.list_(pa.float64()))])
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)
    made = [r for b in jaccard._windows([batch, batch.slice(5, 0), batch.slice(40, 900)]) for r in b.to_pylist()]
    assert len(made) <= 2 * 3 * 65
    want = {}
    for region, held, far in rows:
        for part, d in zip(held, far):
            low, high = want.get((region, part), (d, d))
            want[region, part] = min(low, d), max(high, d)
    assert {(r["region"], r["parts"]): (r["low"], r["high"]) for r in made[: len(want)]} == want
    empty = spark.createDataFrame([], "region long, kind int, node long, part long, other long, core long, label long, size long, " + schema.split(", ", 1)[1])
    assert "Generate inline(places" not in jaccard._regions(empty, 0.2, 1_000)._jdf.queryExecution().toString()


def test_sums_make_a_row_per_part_and_class_not_per_set():
    rng = random.Random(6)
    rows = [(rng.choice([7, -3]), rng.choice([None, 0, 5, -9]), rng.randrange(1, 200), sorted(rng.sample(range(65), rng.choice([1, 2, 40])))) for _ in range(3_000)]
    kinds = pa.schema([("region", pa.int64()), ("label", pa.int64()), ("size", pa.int64()), ("parts", pa.list_(pa.int64()))])
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)
    want = Counter(), Counter()
    for region, label, size, parts in rows + rows[40:940]:
        for part in [-1, *parts]:
            want[0][region, part, label] += 1
            want[1][region, part, label] += size
    made = [r for b in jaccard._sums([batch, batch.slice(5, 0), batch.slice(40, 900)]) for r in b.to_pylist()]
    assert len(made) <= 2 * 2 * 66 * 4
    sums = Counter(), Counter()
    for r in made:
        sums[0][r["region"], r["part"], r["label"]] += r["n"]
        sums[1][r["region"], r["part"], r["label"]] += r["held"]
    assert sums == want


@pytest.mark.parametrize("halved", [False, True])
def test_a_set_is_dealt_out_only_where_the_cut_halves_the_work(spark, monkeypatch, halved):
    """Open sets near all pivots stay one row each until it is known that they go to blocks, not to parts."""
    written = {}

    def stored(df, name):
        out = jaccard_stored(df, name)
        written[name] = out
        return out

    jaccard_stored = jaccard.stored
    monkeypatch.setattr(jaccard, "stored", stored)
    parts = lambda i: [i % 20] if halved else list(range(20))
    rows = [(1, 1, i, None, None, None, None, 50, parts(i), [0.2] * len(parts(i))) for i in range(400)]
    schema = "region long, kind int, node long, part long, other long, core long, label long, size long, parts array<long>, away array<double>"
    cut = jaccard._regions(spark.createDataFrame(rows, schema), 0.15, 2_000_000)
    assert written["jaccard-places"].count() == 400
    assert "Generate inline(filter(places" not in cut._jdf.queryExecution().toString()
    held = Counter(r["region"] for r in cut.collect())
    assert sorted(held.values()) == ([20] * 20 if halved else [400])


def test_signatures_are_folded_over_pieces():
    """A list goes to each bucket for each fold, not for each piece of rows: else lists grow with rows times buckets."""
    rng = np.random.default_rng(2)
    given = [(rng.integers(1 << 60, size=k, dtype=np.uint64), rng.integers(1 << 40, size=k)) for k in [3, 0, 50, 7, 40, 1, 2, 300, 5]]
    made = list(jaccard._folds(iter(given), 100))
    assert [len(keys) for keys, _ in made] == [100, 303, 5] and jaccard.FOLD >= 1 << 18
    for at in (0, 1):
        assert np.array_equal(np.concatenate([p[at] for p in made]), np.concatenate([p[at] for p in given]))
    assert list(jaccard._folds(iter([]), 100)) == []


def test_signatures_of_many_sets_are_those_of_each():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(1 << 63, size=k, dtype=np.uint64)) for k in [0, 1, 2, 5, 0, 9, 30, 31, 100, 700, 0]]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    values = np.concatenate(sets)
    for share in (0, 300, 1_000):
        cold = values % np.uint64(1_000) >= share
        keys, owner = jaccard.signatures_of(values, cold, bounds, 80, 100)
        for i, s in enumerate(sets):
            alone = jaccard.signatures(s, cold[bounds[i] : bounds[i + 1]], 80, 100)
            assert sorted(keys[owner == i].tolist()) == sorted(alone.tolist()) and (len(alone) > 0) == (len(s) > 3)


def test_small_groups_share_a_call():
    rng = random.Random(8)
    rows = [(g, s, rng.randrange(100)) for g in range(-40, 40) for s in range(rng.choice([1, 2])) for _ in range(rng.choice([1, 3, 60]))]
    kinds = pa.schema([("region", pa.int64()), ("slice", pa.int64()), ("node", pa.int64())])
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=kinds)
    batches = [batch.slice(i, 17) for i in range(0, len(rows), 17)] + [batch.slice(0, 0)]
    for most, calls in ((1 << 20, 1), (2_000, len(rows) * 24 // 2_000 + 1), (1, len(rows))):
        lots = list(jaccard._lots(batches, ["region", "slice"], most))
        assert len(lots) <= calls
        assert pa.concat_tables(lots).to_pylist() == batch.to_pylist()
        ends = [(lot.column("region")[0].as_py(), lot.column("slice")[0].as_py()) for lot in lots]
        last = [(lot.column("region")[-1].as_py(), lot.column("slice")[-1].as_py()) for lot in lots]
        assert all(a != b for a, b in zip(ends[1:], last[:-1]))
        for lot in lots:
            cut = jaccard._cut(lot, ["region", "slice"])
            assert len(cut) - 1 == len({(r["region"], r["slice"]) for r in lot.to_pylist()}) and cut[-1] == lot.num_rows


def test_many_islands_at_once(spark):
    """Islands of 2 to 40 sets that share elements with each other: each is joined by itself."""
    rng = random.Random(11)
    common = rng.sample(range(100, 1 << 30), 150)
    rows = []
    for island in range(60):
        while sum(r[0] == island for r in rows) < rng.choice([2, 3, 9, 40]):
            rows += [(island, len(rows) + i, sorted(s)) for i, s in enumerate(edited(rng, set(common) | {island} | set(rng.sample(range(1 << 31, 1 << 32), 60)), rng.choice([0, 1, 4])))]
    frame = spark.createDataFrame(rows, "island long, node long, elements array<long>")
    links = {tuple(r) for r in jaccard.region_links(frame, 85, 100, 2_000_000, 64).collect()}
    sets = {node: (island, set(e)) for island, node, e in rows}
    near = lambda a, b: sets[a][0] == sets[b][0] and 100 * len(sets[a][1] & sets[b][1]) >= 85 * len(sets[a][1] | sets[b][1])
    assert all(near(a, b) for a, b in links)
    least = []
    for edges in (links, {(a, b) for a in sets for b in sets if a < b and near(a, b)}):
        group = {a: a for a in sets}
        for a, b in edges:
            if group[a] != group[b]:
                old, new = group[a], group[b]
                group = {k: new if v == old else v for k, v in group.items()}
        first = {}
        least.append([first.setdefault(group[a], a) for a in sorted(sets)])
    assert least[0] == least[1] and len(set(least[0])) > 60


def test_rows_that_stay_do_not_move(spark, odd_docs):
    """A bitmap parts the rows that may have to go from those that stay; the texts of the latter pass no shuffle."""
    listed = odd_docs.filter("doc_id IN (3, 5) OR doc_id IS NULL AND text IS NULL").selectExpr("doc_id", "xxhash64(text) AS text_hash")
    bits = jaccard.row_bits(listed.select(jaccard.row_key("doc_id", "text_hash").alias("key")))
    inside, outside = jaccard.by_bits(odd_docs, bits, True), jaccard.by_bits(odd_docs, bits, False)
    assert inside.columns == outside.columns == odd_docs.columns
    assert Counter(r["doc_id"] for r in inside.collect()) == Counter([3, 3, 5, None])
    assert Counter(map(tuple, inside.collect())) + Counter(map(tuple, outside.collect())) == Counter(map(tuple, odd_docs.collect()))
    assert "hashpartitioning" not in outside._jdf.queryExecution().executedPlan().toString()
    kept = jaccard.one_of_each_class(odd_docs, 5, 80, 100)
    moved = [x for x in kept._jdf.queryExecution().optimizedPlan().toString().split("Union")[1].splitlines() if "Anti" in x or "Join" in x]
    assert "LeftOuter" in moved[0] and "Anti" not in moved[0]
