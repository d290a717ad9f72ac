"""robots.txt: rules, sitemap lines and the allow filter. One row holds one site's file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlscope import dims
from crawlscope.functions import urls


def _lines(body: Column) -> Column:
    """Lines as STRUCT<key, value>: cut at #, key lower-cased, both trimmed; others drop."""
    raw = F.transform(F.split(body, r"\R"), lambda line: F.trim(F.substring_index(line, "#", 1)))
    return F.transform(
        F.filter(raw, lambda line: line.contains(":")),
        lambda line: F.struct(
            F.lower(F.trim(F.substring_index(line, ":", 1))).alias("key"),
            F.trim(F.regexp_replace(line, r"^[^:]*:", "")).alias("value"),
        ),
    )


def robots_rules(robots: DataFrame, agents: Sequence[str] = tuple(dims.ROBOTS_AGENTS)) -> DataFrame:
    """robots(site, body) -> site, prefixes ARRAY<STRING>, sitemaps ARRAY<STRING>, loaded.

    Each user-agent line replaces the current group, so the last one before a rule decides.
    The fold runs inside the row: no shuffle, and the size is that of one file.
    """
    ours = F.array(*[F.lit(a) for a in agents])
    start = F.struct(
        F.lit(False).alias("applies"), F.array().cast("array<string>").alias("prefixes")
    )

    def step(acc: Column, line: Column) -> Column:
        is_agent = line["key"] == "user-agent"
        is_rule = acc["applies"] & (line["key"] == "disallow") & (line["value"] != "")
        return F.struct(
            F.when(is_agent, F.array_contains(ours, line["value"])).otherwise(acc["applies"]).alias("applies"),
            F.when(is_rule, F.concat(acc["prefixes"], F.array(line["value"])))
            .otherwise(acc["prefixes"])
            .alias("prefixes"),
        )

    lines = _lines(F.coalesce("body", F.lit("")))
    maps = F.transform(
        F.filter(lines, lambda s: (s["key"] == "sitemap") & (s["value"] != "")), lambda s: s["value"]
    )
    return robots.select(
        "site",
        F.aggregate(lines, start, step, lambda acc: acc["prefixes"]).alias("prefixes"),
        maps.alias("sitemaps"),
        (F.trim(F.coalesce("body", F.lit(""))) != "").alias("loaded"),
    )


def rule_rows(rules: DataFrame) -> DataFrame:
    return rules.select("site", F.posexplode("prefixes").alias("line_no", "prefix")).withColumn(
        "line_no", F.col("line_no").cast("bigint")
    )


def is_blocked(url: Column, prefixes: Column, strict: bool = False) -> Column:
    """Path starts with a rule. The rule ``/`` alone blocks nothing unless ``strict``."""
    url_path = urls.path(url)
    url_path = F.when(url_path == "", F.lit("/")).otherwise(url_path)
    hit = F.exists(prefixes, lambda p: F.startswith(url_path, p) & (F.lit(strict) | (p != "/")))
    return F.coalesce(hit, F.lit(False))


def mark_blocked(rows: DataFrame, rules: DataFrame, url: str = "url", strict: bool = False, few: bool = False) -> DataFrame:
    """Add ``blocked`` to rows(site, <url>, ...). Links to another origin are never blocked.

    A rule is met by hash join: a path is cut to the lengths that rules of its site have, and the pieces are looked
    up among the rules. So a site may have any number of rules, the rules never travel with the rows, and
    Spark broadcasts them where they are small. ``few`` is for rows that are few per site by
    construction: the rules join them on the site and are tried one by one, which looks at the rows once.
    """
    own = urls.netloc(F.col(url)) == F.col("site")
    if few:
        joined = rows.join(rules.select("site", "prefixes"), "site", "left")
        return joined.withColumn("blocked", own & is_blocked(F.col(url), F.col("prefixes"), strict)).drop("prefixes")
    path = F.when(own, F.coalesce(F.nullif(urls.path(F.col(url)), F.lit("")), F.lit("/")))
    prefixes = rule_rows(rules).select("site", "prefix").filter(F.lit(strict) | (F.col("prefix") != "/")).distinct()
    lengths = prefixes.groupBy("site").agg(F.sort_array(F.collect_set(F.length("prefix"))).alias("_lengths"))
    tested = rows.select("site", path.alias("_path")).filter("_path IS NOT NULL").join(lengths, "site")
    pieces = F.transform(
        F.filter("_lengths", lambda n: n <= F.length("_path")), lambda n: F.substring(F.col("_path"), F.lit(1), n)
    )
    met = tested.select("site", "_path", F.explode(pieces).alias("prefix")).join(prefixes, ["site", "prefix"], "left_semi")
    hits = met.select("site", "_path").distinct().withColumn("_hit", F.lit(True))
    marked = rows.withColumn("_path", path).join(hits, ["site", "_path"], "left")
    return marked.select(*rows.columns, F.coalesce("_hit", F.lit(False)).alias("blocked"))
