"""The stages in order, each against its own rule, and the registered queries."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from crawlscope.llm import decontamination, jaccard, mixing, toxicity
from crawlscope.llm.common import table
from crawlscope.llm.queries import ORACLES, QUERIES
from tools.run_queries import TABLES
from tools.run_queries import table as plain_table

SMALL = "/root/testdata/sf0.001"
LABELLED = "/root/testdata/sf0.01"  # with labels enough to learn from



def test_stages_on_the_whole_table(spark, tmp_path):
    docs = table(spark, LABELLED, "documents")
    columns, counts = docs.columns, [docs.count()]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, LABELLED)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / str(number)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(number)))
        counts.append(docs.count())
        if number == 0:
            judged = toxicity.judge(before, table(spark, LABELLED, "labels"))
            assert counts[-1] == judged.filter("predicted = 0").count()
        if number == 1:
            again = jaccard.jaccard_join(docs, 5, 80, 100)
            assert again.filter("component_id <> doc_id").count() == 0
        if number == 2:
            assert decontamination.contaminated(docs, table(spark, LABELLED, "benchmark")).count() == 0
        if number == 3:
            assert mixing.mix_report(before).selectExpr("sum(taken)").first() == docs.select(mixing.size_of().alias("n")).selectExpr("sum(n)").first()
        if number == 4:
            assert counts[-1] == counts[-2]
    assert counts[0] > counts[1] > counts[2]
    whole = corpus_pipeline.run(spark, LABELLED)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.collect()))


@pytest.mark.parametrize("name", ["odd_docs", "clashing", "no_docs"])
def test_odd_rows_pass_through(spark, request, name):
    docs = request.getfixturevalue(name)
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        if number < 4:
            assert out.columns == docs.columns
            docs = out
    assert out.count() == docs.count()


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    frame = QUERIES[name](spark, SMALL)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    cursor = con.execute(ORACLES[name])
    assert plain_table(frame.columns, [tuple(r) for r in frame.collect()]) == plain_table([c[0] for c in cursor.description], cursor.fetchall())
