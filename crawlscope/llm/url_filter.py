"""URL rules held in a cascade of Bloom filters over the corpus's keys.

A rule names a host, with its subdomains, and a beginning of the path. The keys of a URL are its host and
each parent domain, joined with each beginning of its path that has the length of a rule's. The cascade
of a list is built over all different keys of the corpus: level 1 holds the listed keys; level 2 the other
keys that level 1 accepts by mistake; level 3 the listed keys that level 2 accepts; and so on until no
mistake is left. A key is on the list if the number of levels that accept it, up to the first that does
not, is odd. That is exact for every key of the corpus, and needs no join. Blocked and allowed keys have a
cascade each; the longest key on either list decides, and a URL without one is allowed.

The filters go with each task, so their size is bounded. Longer lists are looked up in parts: URLs are put into parts by
their host, a part too large for its filters (one host) by host and path, and each part has cascades of its own over the
keys that its URLs have. The parts are worked on one after the other, each by all tasks, and each row is read in its part only.

Only DataFrame functions are used. Defined cases: a null URL or one without ``://`` has an empty host and
path and is allowed; equal rules count once, and a rule on both lists blocks; without rules everything is
allowed; rows with equal ids are judged one by one.
"""

from __future__ import annotations

import math
import string
import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlscope.llm.common import new_folder, stored

MOST_BITS = 1 << 25  # of all levels of a cascade together: 4 MiB go with each task
LEAST_BITS = 1 << 10  # smaller bounds count as this one
MOST_PARTS = 64  # of one division; a part still too large is divided again


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty without ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    after = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(after, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(after, F.length(raw) + 1, F.length(after) + 1), "^[^?#]*", 0)
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), path


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys of a URL; ``lengths`` are those of the rules' paths."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path))
    return F.flatten(F.transform(domains, lambda d: F.transform(starts, lambda n: F.concat(d, F.substr(path, F.lit(1), n)))))


@dataclass
class Level:
    bits: int
    hashes: int
    data: bytes


def _slots(key: Column, level: int, bits: int, hashes: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(bits)) for j in range(hashes)])


def build_level(keys: DataFrame, level: int, count: int, rate: float) -> Level:
    """Bloom filter of ``keys`` (key): ``count`` keys at the given rate of mistakes."""
    bits = 64 * max(1, math.ceil(count * -math.log(rate) / math.log(2) ** 2 / 64))
    hashes = max(1, round(-math.log2(rate)))
    slots = keys.select(F.explode(_slots(F.col("key"), level, bits, hashes)).alias("slot"))
    words = slots.groupBy(F.floor(F.col("slot") / 64).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot % 64 AS INT))")).alias("w"))
    data = bytearray(bits // 8)
    for row in words.collect():  # at most ``bits`` bits
        struct.pack_into("<q", data, 8 * row["i"], row["w"])
    return Level(bits, hashes, bytes(data))


def accepts(key: Column, number: int, level: Level) -> Column:
    filled = F.lit(level.data)
    hit = []
    for j in range(level.hashes):
        slot = F.pmod(F.xxhash64(key, F.lit(number), F.lit(j)), F.lit(level.bits))
        byte = F.conv(F.hex(F.substr(filled, (F.floor(slot / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        hit.append(F.getbit(byte, (slot % 8).cast("int")) == 1)
    out = hit[0]
    for h in hit[1:]:
        out = out & h
    return out


@dataclass
class Cascade:
    levels: list[Level]

    def holds(self, key: Column) -> Column:
        """Whether a key of the corpus is on the list."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(accepts(key, i, self.levels[i]), out).otherwise(F.lit(i % 2 == 1))
        return out


def build_cascade(universe: DataFrame, most_bits: float = MOST_BITS) -> Cascade | None:
    """Cascade of ``universe`` (key, listed), or None if it would exceed ``most_bits``."""
    other, listed = (universe.filter(F.col("listed") == v).select("key") for v in (False, True))
    row = universe.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()
    inside, outside, levels, bits = listed, other, [], 0
    n_in, n_out = row[0], row[1]
    while n_in:
        rate = min(0.5, n_in / (2 * n_out)) if not levels and n_out else 0.5
        if bits + n_in * -math.log(rate) / math.log(2) ** 2 > most_bits:
            return None
        levels.append(build_level(inside, len(levels), n_in, rate))
        bits += levels[-1].bits
        wrong = outside.filter(accepts(F.col("key"), len(levels) - 1, levels[-1]))
        wrong = stored(wrong, "cascade")
        inside, outside = wrong, inside
        n_in = wrong.count()
    return Cascade(levels)


def judge_urls(pages: DataFrame, rules: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of ``pages`` (page_id, url) under ``rules`` (host, path, action).

    ``most_bits`` bounds a cascade that goes with the tasks; lists that need more are looked up in parts.
    """
    listed = rules.select(F.concat("host", "path").alias("key"), F.length("path").alias("n"), "action").filter("key IS NOT NULL")
    # A path's length is at most that of a URL; rules come with few different ones.
    lengths = [r["n"] for r in listed.select("n").distinct().orderBy("n").collect()]
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    if not lengths:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    rows = rows.withColumn("keys", F.when(F.col("host") != "", keys_of(F.col("host"), F.col("path"), lengths)).otherwise(F.array().cast("array<string>")))
    lists = listed.groupBy("key").agg((F.max((F.col("action") == F.lit("block")).cast("int")) == 1).alias("block"))
    universe = stored(
        rows.select(F.explode("keys").alias("key")).distinct().join(lists, "key", "left").select(
            "key", F.coalesce(F.col("block"), F.lit(False)).alias("block"), F.coalesce(~F.col("block"), F.lit(False)).alias("allow")
        ),
        "url-keys",
    )
    most_bits = max(most_bits, LEAST_BITS)
    cascades = _cascades(universe, most_bits)
    if cascades is not None:
        return _verdicts(rows, cascades)
    folder = new_folder(pages.sparkSession, "url-verdicts")
    _judge_parts(rows, universe, most_bits, folder)
    out = _verdicts(rows, {"block": Cascade([]), "allow": Cascade([])})
    return pages.sparkSession.read.schema(out.schema).parquet(folder).select(out.columns)


def _cascades(universe: DataFrame, most_bits: float) -> dict[str, Cascade] | None:
    """Cascades of the blocked and the allowed keys of ``universe`` (key, block, allow), or None if one is too large."""
    out = {}
    for action in ("block", "allow"):
        out[action] = build_cascade(universe.select("key", F.col(action).alias("listed")), most_bits)
        if out[action] is None:
            return None
    return out


def _verdicts(rows: DataFrame, cascades: dict[str, Cascade]) -> DataFrame:
    on_list = [
        F.transform(F.filter("keys", cascades["block"].holds), lambda k: F.struct(F.length(k).alias("n"), k.alias("key"), F.lit(True).alias("block"))),
        F.transform(F.filter("keys", cascades["allow"].holds), lambda k: F.struct(F.length(k).alias("n"), k.alias("key"), F.lit(False).alias("block"))),
    ]
    best = F.array_max(F.concat(*on_list))
    rows = rows.select("page_id", "host", "path", best.alias("best"))
    return rows.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.when(F.col("best.block"), "block").otherwise("allow").alias("verdict"))


def _judge_parts(rows: DataFrame, universe: DataFrame, most_bits: int, folder: str, name: str = "", salt: int = 0) -> None:
    """Write the verdicts of ``rows`` (page_id, host, path, keys) below ``folder``, one folder for each part.

    A part takes neighbouring files of the divided tables, so a pass reads little else, and a hot host spans many tasks.
    """
    n_block, n_allow, n = universe.agg(F.count_if("block"), F.count_if("allow"), F.count("*")).first()
    bits = max(_bits(listed, n - listed) for listed in (n_block, n_allow))
    parts = min(MOST_PARTS, max(2, math.ceil(2 * bits / most_bits)))
    by = ["host"] if salt == 0 else ["host", "path"]
    placed = rows.withColumn("_part", F.pmod(F.xxhash64(*by, F.lit(salt)), F.lit(parts)).cast("int"))
    placed = placed.withColumn("_row", F.monotonically_increasing_id())
    placed = stored(placed.repartitionByRange("_part", "_row").sortWithinPartitions("_part").drop("_row"), "url-rows")
    met = placed.select("_part", F.explode("keys").alias("key")).distinct()
    met = met.join(universe.filter("block OR allow"), "key", "left").na.fill(False, ["block", "allow"])
    met = stored(met.repartitionByRange("_part", "key").sortWithinPartitions("_part"), "url-keys")
    for k in range(parts):
        own, keys = (t.filter(F.col("_part") == k).drop("_part") for t in (placed, met))
        cascades = _cascades(keys, most_bits)
        if cascades is None:
            url = F.struct("host", "path")
            least, greatest = own.agg(F.min(url), F.max(url)).first()
            if salt == 0 or least != greatest:
                _judge_parts(own, keys, most_bits, folder, f"{name}{k}-", salt + 1)
                continue
            cascades = _cascades(keys, math.inf)  # the keys of a single URL
        _verdicts(own, cascades).write.parquet(f"{folder}/part=p{name}{k}")


def _bits(listed: int, other: int) -> float:
    """About the bits of a cascade: the first level, and the later ones, which halve."""
    rate = min(0.5, listed / (2 * other)) if listed and other else 0.5
    return listed * (-math.log(rate) / math.log(2) ** 2 + 4)
