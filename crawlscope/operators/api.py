"""API calls: selection, previews, summary, evidence gate, payload profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlscope import dims
from crawlscope.functions import text as X
from crawlscope.functions import urls


def api_calls(log: DataFrame) -> DataFrame:
    """fetch/xhr responses: same_origin flag, masked preview of JSON bodies."""
    is_json = F.coalesce(F.col("content_type"), F.lit("")).contains("json")
    return log.filter(F.col("type").isin(*dims.API_TYPES)).select(
        "site", "seq", "method", "url", "status", "type", "content_type",
        (urls.netloc(F.col("url")) == F.col("site")).alias("same_origin"),
        F.when(is_json, X.preview(F.col("body"))).alias("body_preview"),
    )


def endpoints(calls: DataFrame) -> DataFrame:
    """Distinct endpoints per site with the first call's place: site, url, first_seq, calls, same_origin."""
    return calls.groupBy("site", "url").agg(
        F.min("seq").alias("first_seq"), F.count("*").alias("calls"), F.bool_or("same_origin").alias("same_origin")
    )


def api_summary(calls: DataFrame) -> DataFrame:
    """Calls, same-origin calls and distinct endpoints per site.

    Endpoints are folded first, so the distinct count is a plain count.
    """
    return endpoints(calls).withColumn("own", F.when(F.col("same_origin"), F.col("calls")).otherwise(0)).groupBy(
        "site"
    ).agg(
        F.sum("calls").alias("api_calls"), F.sum("own").cast("bigint").alias("same_origin_calls"), F.count("*").alias("endpoints"),
    )


def evidence_gate(calls: DataFrame, structures: DataFrame) -> DataFrame:
    """sufficient / insufficient / none per site, and the confidence its findings may claim.

    structures(site, kind): distinct kinds of form or response structure seen on the site.
    Three own endpoints or two kinds suffice; no own call at all is none.
    """
    own = endpoints(calls).groupBy("site").agg(
        F.count_if("same_origin").alias("own_endpoints")
    )
    kinds = structures.select("site", "kind").distinct().groupBy("site").agg(F.count("*").alias("structures"))
    both = own.join(kinds, "site", "full_outer").na.fill(0, ["own_endpoints", "structures"])
    gate = (
        F.when((F.col("own_endpoints") >= 3) | (F.col("structures") >= 2), F.lit("sufficient"))
        .when(F.col("own_endpoints") == 0, F.lit("none"))
        .otherwise(F.lit("insufficient"))
    )
    return both.withColumn("gate", gate).withColumn(
        "confidence_cap", F.when(F.col("gate") == "sufficient", F.lit("Confirmed")).otherwise(F.lit("Hypothesis"))
    )


def payload_profile(calls: DataFrame) -> DataFrame:
    """Fields of JSON object bodies per endpoint: site, url, field, type, calls.

    calls(site, url, body). Bodies that fail to parse drop; the schema as a whole is
    ``payload_schema``.
    """
    parsed = calls.select("site", "url", F.try_parse_json("body").alias("v")).filter("v IS NOT NULL")
    fields = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("v").outer())).select(
        "site", "url", F.col("key").alias("field"), F.schema_of_variant("value").alias("type")
    ).filter("field IS NOT NULL")
    return fields.groupBy("site", "url", "field", "type").agg(F.count("*").alias("calls"))


def _children(node: Column) -> Column:
    """Named members of an object, or elements of a list, one level below (path, v)."""
    path, v = node["path"], node["v"]
    members = F.transform(
        F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")),
        lambda e: F.struct(F.concat(path, F.lit("."), e["key"]).alias("path"), e["value"].alias("v")),
    )
    elements = F.transform(
        F.try_variant_get(v, "$", "array<variant>"), lambda x: F.struct(F.concat(path, F.lit("[]")).alias("path"), x.alias("v"))
    )
    kind = F.schema_of_variant(v)
    none = F.array().cast("array<struct<path:string,v:variant>>")
    return F.when(kind.startswith("OBJECT"), members).when(kind.startswith("ARRAY"), elements).otherwise(none)


def payload_fields(calls: DataFrame) -> DataFrame:
    """Fields of JSON bodies at any depth: site, url, path, type, calls, bodies.

    calls(site, url, body). ``$`` is the whole body, ``$.a.b`` a member and ``$.a[]`` any element of a list;
    ``calls`` counts the bodies that hold the path with this type, ``bodies`` those of the endpoint that
    parse. Objects and lists have the types OBJECT and ARRAY. The descent folds over the levels inside the row,
    at most one for each bracket in the text, so nothing moves before the counts.
    """
    parsed = calls.select("site", "url", "body", F.try_parse_json("body").alias("v")).filter("v IS NOT NULL")
    node = "array<struct<path:string,v:variant>>"
    field = "array<struct<path:string,type:string>>"

    def step(acc: Column, _: Column) -> Column:
        here = F.transform(
            acc["level"],
            lambda n: F.struct(n["path"].alias("path"), F.regexp_extract(F.schema_of_variant(n["v"]), r"^[^<]*", 0).alias("type")),
        )
        below = F.flatten(F.transform(acc["level"], _children)).cast(node)
        ended = F.size(acc["level"]) == 0
        return F.when(ended, acc).otherwise(
            F.struct(F.array_union(acc["found"], here).cast(field).alias("found"), below.alias("level"))
        )

    whole = F.array(F.struct(F.lit("$").alias("path"), F.col("v").alias("v"))).cast(node)
    start = F.struct(F.array().cast(field).alias("found"), whole.alias("level"))
    # Text in quotes may hold brackets too, which only makes the bound larger.
    levels = F.sequence(F.lit(0), F.length(F.regexp_replace("body", r"[^\[{]", "")))
    found = F.aggregate(levels, start, step, lambda acc: acc["found"])
    rows = parsed.select("site", "url", F.explode(found).alias("f")).select("site", "url", "f.*")
    counts = rows.groupBy("site", "url", "path", "type").agg(F.count("*").alias("calls"))
    # A body has exactly one type at its root.
    bodies = counts.filter("path = '$'").groupBy("site", "url").agg(F.sum("calls").alias("bodies"))
    return counts.join(bodies, ["site", "url"])


def payload_schema(calls: DataFrame) -> DataFrame:
    """Merged body schema per endpoint."""
    parsed = calls.select("site", "url", F.try_parse_json("body").alias("v")).filter("v IS NOT NULL")
    return parsed.groupBy("site", "url").agg(
        F.count("*").alias("calls"), F.schema_of_variant_agg("v").alias("schema")
    )
