"""Template windows: planted items, changed values, clean texts."""

import random
import re

import pytest

from crawlscope.llm import decontamination as D
from crawlscope.llm.common import table

SMALL = "/root/testdata/sf0.001"


ITEMS = [
    (1, "Tom has 3 apples and gives Anna 2 of them. How many apples does Tom have after 4 days?"),
    (2, "A train travels 120 km in 2 hours. What is the average speed of the train in km per hour?"),
    (3, "blue green red"),
    (4, None),
    (5, ""),
    (6, "12 13 14"),
]


def found(spark, docs, items=ITEMS):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in D.contaminated(docs, items).collect()}


def test_items_with_changed_values(spark):
    filler = "some other words that come before the question and more after it"
    got = found(
        spark,
        [
            (1, f"{filler} {ITEMS[0][1]} {filler}"),
            (2, f"{filler}. Mary has 7 apples and gives Jack 5 of them. How many apples does Mary have after 9 weeks? {filler}"),
            (3, f"{filler}. Mary has 7 apples and gives Jack 5 of them. How many apples does Paul have after 9 weeks? And Zoe"),
            (4, ITEMS[1][1].upper()),
            (5, "A train travels 300 miles in 5 hours. What is the average speed of the train in miles per hour?"),
            (6, "A train travels to town. What is the average age of the people in the train?"),
            (7, "red\nblue - GREEN: red!"),
            (8, "blue green"),
            (9, None),
            (10, "7 8 9"),
            (None, ITEMS[1][1]),
        ],
    )
    assert {(1, 1), (2, 1), (4, 2), (5, 2), (7, 3), (None, 2), (10, 6)} <= set(got)
    assert not {k for k in got if k[0] in (6, 8, 9)}
    assert got[1, 1]["covered"] == 1 and not got[1, 1]["changed_slots"] and got[2, 1]["changed_slots"]
    assert got[2, 1]["consistency"] == 1


def test_inconsistent_values_are_no_match(spark):
    item = [(1, "x is 5 and y is 5 and z is 5 and w is 5 so the sum over all of 5 is 25")]
    got = found(spark, [(1, "x is 8 and y is 8 and z is 8 and w is 8 so the sum over all of 8 is 40"), (2, "x is 1 and y is 2 and z is 3 and w is 4 so the sum over all of 6 is 7")], item)
    assert set(got) == {(1, 1)}


@pytest.mark.parametrize("most_flags", [1 << 19, 1])
def test_whole_items_of_the_given_benchmark(spark, most_flags):
    docs, items = table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark")
    plain = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    texts = {r["doc_id"]: plain(r["text"]) for r in docs.collect()}
    wanted = {(d, r["item_id"]) for r in items.collect() for d, t in texts.items() if plain(r["text"]) in t}
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(docs, items, most_flags=most_flags).collect()}
    assert wanted and got == wanted
    kept = D.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(texts) - {d for d, _ in wanted}


@pytest.mark.parametrize("name", ["odd_docs", "clashing", "no_docs"])
def test_odd_rows(spark, request, name):
    docs = request.getfixturevalue(name)
    items = spark.createDataFrame([(1, "One, two; three four five six seven")], "item_id long, text string")
    rows = D.contaminated(docs, items).collect()
    assert [(r["doc_id"], r["item_id"]) for r in rows] == ([] if name == "no_docs" else [(None, 1)])
    kept = D.decontaminate(docs, items)
    assert kept.columns == docs.columns and kept.count() == max(0, docs.count() - 1)
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(docs, none).count() == docs.count()


def test_one_edit_does_not_hide_an_item(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(30)]
    edited = words.copy()
    edited[15] = "changed"
    del edited[20]
    got = found(spark, [(1, " ".join(edited)), (2, " ".join(rng.sample(words, 30)))], [(1, " ".join(words))])
    assert set(got) == {(1, 1)}
