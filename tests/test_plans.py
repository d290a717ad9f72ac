"""The audit pipelines end to end on inputs derived from the smallest data."""

from pyspark.sql import functions as F

from crawlscope.operators import canonical, links
from crawlscope.plans import audit
from crawlscope.sources import adapters as A

FOLDER = "/root/testdata/sf0.001"


def test_summaries_and_report(spark):
    pages = A.rich_pages(spark, FOLDER)
    found = links.extract_links(pages)
    visited = canonical.site_pages(pages).withColumn("depth", F.lit(0))
    ux = audit.ux_summary(A.style_obs(spark, FOLDER))
    ia = audit.ia_summary(pages, visited, found)
    stack = audit.tech_summary(pages, A.header_log(spark, FOLDER), A.lighthouse(spark, FOLDER))
    log = A.fetch_log(spark, FOLDER)
    calls = audit.api_summary(log, log.select("site", F.col("type").alias("kind")))
    for tables in (ux, ia, stack, calls):
        for name, table in tables.items():
            assert table.count() > 0, name
    report = audit.final_report(
        A.style_obs(spark, FOLDER).groupBy("site").agg(F.count("*").alias("page_count")),
        ia["pages"].groupBy("site").agg(F.count("*").alias("page_count"), F.lit(1).alias("nav_items")),
        stack["frameworks"].groupBy("site").agg(F.count("*").alias("frameworks")),
        calls["totals"],
        ia["main_navigation"],
    )
    sites = report["report"].count()
    assert report["metrics"].count() == sites and report["checklist"].count() >= 10 * sites
    assert report["confidence"].agg(F.sum("confirmed")).first()[0] is not None
