"""Near-duplicate vectors by an epsilon grid order join.

Vectors of one label link when their cosine is at least ``least``, that is, when their unit vectors lie
within eps = sqrt(2 - 2 * least). Unit vectors are rotated to their leading principal dimensions and
sorted by grid cells of side eps on them. The sequence is cut into blocks; a pair of blocks is joined only
if they touch in the first two grid dimensions and their bounding boxes are within eps. Inside a task both
sequence intervals are halved recursively, and pairs of halves whose boxes are farther apart are skipped;
what is left is compared by matrix products in double precision. Rotation and boxes only skip; links are
decided on the given components.

Equal vectors of a label are one class before the join, so groups of copies cost nothing. Blocks send
numbers of links and the connected classes of the block pair, never the pairs.

Defined cases: vectors that are null, zero or hold null or non-finite components, and rows without a
label, link with nothing; vectors of different lengths never link; rows with equal ids are separate
vectors; a null id is its own component unless the component has an id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope.llm.common import components, parts, stored

BLOCK, LEAF, GRID, BOX = 512, 64, 3, 8
MOST_DIMENSIONS = 2_048  # rotation is left out for longer vectors


def usable(vectors: DataFrame) -> DataFrame:
    """``vectors`` (vec_id, embedding, label) with ``dim`` and ``raw``, the components as doubles; both null for
    rows that link with nothing."""

    def run(batches):
        for batch in batches:
            dims, raws = [], []
            for v, labelled in zip(batch.column(1), batch.column(2).is_valid().to_pylist(), strict=True):
                x = None if v.as_py() is None or not labelled or v.values.null_count else np.asarray(v.values, np.float64)
                good = x is not None and len(x) and np.isfinite(x).all() and x.any()
                dims.append(len(x) if good else None)
                raws.append((x + 0.0).tobytes() if good else None)  # -0.0 becomes 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())], ["vec_id", "label", "dim", "raw"]
            )

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("string"))
    return rows.mapInArrow(run, "vec_id long, label string, dim int, raw binary")


def units(raws: pa.Array, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raws.to_pylist()), np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def rotation(kinds: DataFrame) -> tuple[int, np.ndarray | None]:
    """(most frequent length, its leading principal axes) of the unit vectors of all classes.

    Tasks send one sum of outer products each; the merged sums, dim * (dim + 1) numbers, come to the driver.
    """
    top = kinds.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if top is None or top["dim"] > MOST_DIMENSIONS:
        return 0, None
    dim = top["dim"]

    def run(batches):
        total, sums, n = np.zeros((dim, dim)), np.zeros(dim), 0
        for batch in batches:
            x = units(batch.column(0), dim)
            total, sums, n = total + x.T @ x, sums + x.sum(0), n + len(x)
        if n:
            every = np.concatenate([total.ravel(), sums, [n]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(every))), pa.array(every)], ["i", "v"])

    merged = kinds.filter(F.col("dim") == dim).select("raw").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v"))
    every = np.zeros(dim * dim + dim + 1)
    for row in merged.collect():
        every[row["i"]] = row["v"]
    mean = every[dim * dim : -1] / every[-1]
    _, axes = np.linalg.eigh(every[: dim * dim].reshape(dim, dim) / every[-1] - np.outer(mean, mean))
    return dim, np.ascontiguousarray(axes[:, ::-1][:, :BOX])


def places(x: np.ndarray, dim: int, axes: np.ndarray | None) -> np.ndarray:
    """Coordinates on the leading dimensions, padded to ``BOX``; an orthonormal map never stretches distances."""
    y = x @ axes if axes is not None and x.shape[1] == dim else x[:, :BOX]
    return np.hstack([y, np.zeros((len(y), BOX - y.shape[1]))])


def blocks(kinds: DataFrame, eps: float) -> DataFrame:
    """The classes in epsilon grid order, ``BLOCK`` to a row: ids, sizes and components packed, with the box
    of their places and their cells on the first two grid dimensions, and the cells next to these."""
    dim, axes = rotation(kinds)

    def locate(batches):
        for batch in batches:
            spot = np.zeros((batch.num_rows, BOX))
            lengths = np.asarray(batch.column(2))
            for d in np.unique(lengths):
                mine = np.flatnonzero(lengths == d)
                spot[mine] = places(units(batch.column(3).take(pa.array(mine)), int(d)), dim, axes)
            cells = np.floor(spot[:, :GRID] / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(cells[:, i]) for i in range(GRID)), pa.array(spot[:, 0])],
                [*batch.schema.names, *(f"c{i}" for i in range(GRID)), "first"],
            )

    order = ["label", "dim", *(f"c{i}" for i in range(GRID)), "first", "kind"]
    schema = "kind long, label string, dim int, raw binary, copies long, " + ", ".join(f"c{i} int" for i in range(GRID)) + ", first double"
    rows = kinds.select("kind", "label", "dim", "raw", "copies").mapInArrow(locate, schema)
    rows = rows.repartitionByRange(parts(kinds.sparkSession), *order).sortWithinPartitions(*order)

    def pack(batches):
        for batch in batches:
            labels, lengths = batch.column(1).to_pylist(), np.asarray(batch.column(2)).tolist()
            cuts = [i for i in range(1, batch.num_rows) if labels[i] != labels[i - 1] or lengths[i] != lengths[i - 1]]
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                for at in range(low, high, BLOCK):
                    part = batch.slice(at, min(BLOCK, high - at))
                    d = lengths[at]
                    x = units(part.column(3), d)
                    spot = places(x, dim, axes)
                    cells = np.unique(np.floor(spot[:, :2] / eps).astype(np.int64), axis=0)
                    near = np.unique(np.concatenate([cells + [i, j] for i in (-1, 0, 1) for j in (-1, 0, 1)]), axis=0)
                    code = lambda c: (c[:, 0] * (1 << 20) + c[:, 1]).tolist()
                    raw = np.frombuffer(b"".join(part.column(3).to_pylist()), np.float64)
                    yield pa.RecordBatch.from_pylist(
                        [{
                            "block": int(np.asarray(part.column(0))[0]), "label": labels[at], "dim": d, "kinds": np.asarray(part.column(0)).astype("<i8").tobytes(),
                            "copies": np.asarray(part.column(4)).astype("<i8").tobytes(), "raw": raw.tobytes(), "low": spot.min(0).tolist(), "high": spot.max(0).tolist(),
                            "cells": code(cells), "near": code(near),
                        }],
                        schema=_BLOCKS,
                    )

    packed = rows.mapInArrow(
        pack, "block long, label string, dim int, kinds binary, copies binary, raw binary, low array<double>, high array<double>, cells array<long>, near array<long>"
    )
    return stored(packed, "grid-blocks"), dim, axes


_BLOCKS = pa.schema(
    [("block", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("kinds", pa.binary()), ("copies", pa.binary()), ("raw", pa.binary()),
     ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("cells", pa.list_(pa.int64())), ("near", pa.list_(pa.int64()))]
)


def block_pairs(blocked: DataFrame, eps: float) -> DataFrame:
    """(a, b), a <= b: pairs of blocks of one label that may hold a link."""
    about = blocked.select("block", "label", "dim", "low", "high", "cells", "near")
    one = about.withColumn("cell", F.explode("cells"))
    two = about.withColumn("cell", F.explode("near"))
    gap = F.aggregate(
        F.zip_with(
            F.zip_with("o.low", "t.high", lambda lo, hi: lo - hi), F.zip_with("t.low", "o.high", lambda lo, hi: lo - hi),
            lambda x, y: F.pow(F.greatest(x, y, F.lit(0.0)), F.lit(2.0)),
        ),
        F.lit(0.0), lambda acc, x: acc + x,
    )
    touching = (
        (F.col("o.label") == F.col("t.label")) & (F.col("o.dim") == F.col("t.dim")) & (F.col("o.cell") == F.col("t.cell")) & (F.col("o.block") <= F.col("t.block"))
    )
    met = one.alias("o").join(two.alias("t"), touching).filter(gap <= eps * eps)
    return met.select(F.col("o.block").alias("a"), F.col("t.block").alias("b")).distinct()


def interval_links(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, least: float, eps: float, out: np.ndarray) -> None:
    """Mark in ``out`` the pairs of x and y with cosine >= ``least``, halving both sequences recursively."""
    gap = np.maximum(np.maximum(px.min(0) - py.max(0), py.min(0) - px.max(0)), 0)
    if (gap * gap).sum() > eps * eps:
        return
    if len(x) <= LEAF and len(y) <= LEAF:
        np.greater_equal(x @ y.T, least, out=out)
        return
    i, j = (len(x) + 1) // 2 if len(x) > LEAF else len(x), (len(y) + 1) // 2 if len(y) > LEAF else len(y)
    for r in (slice(0, i), slice(i, len(x))):
        for c in (slice(0, j), slice(j, len(y))):
            if r.start < r.stop and c.start < c.stop:
                interval_links(x[r], y[c], px[r], py[c], least, eps, out[r, c])


def classes_of(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of rows and columns of a link matrix: equal within a connected class, -1 without a link."""
    n = links.shape[0]
    rows = np.where(links.any(1), np.arange(n), n)
    while True:
        cols = np.where(links, rows[:, None], n).min(0)
        new = np.minimum(rows, np.where(links, cols[None, :], n).min(1))
        if np.array_equal(new, rows):
            return np.where(rows < n, rows, -1), np.where(cols < n, cols, -1)
        rows = new


def grid_join(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding, label)."""
    eps = float(np.sqrt(2 - 2 * least)) + 1e-6
    rows = stored(usable(vectors), "grid-rows")
    key = ["label", "dim", "raw"]
    kinds = rows.filter("raw IS NOT NULL").groupBy(*key).agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    kinds = stored(kinds.withColumn("kind", F.monotonically_increasing_id()), "grid-kinds")
    blocked, dim, axes = blocks(kinds, eps)
    pairs = block_pairs(blocked, eps)
    packed = blocked.select("block", "dim", "kinds", "copies", "raw")
    one, two = (packed.select(*[F.col(c).alias(f"{s}_{c}") for c in packed.columns]) for s in "ab")
    loaded = pairs.join(one, pairs["a"] == one["a_block"]).join(two, pairs["b"] == two["b_block"]).select(
        "a", "b", "a_dim", "a_kinds", "a_copies", "a_raw", "b_kinds", "b_copies", "b_raw"
    )

    def compare(batches):
        for batch in batches:
            for row in batch.to_pylist():
                d = row["a_dim"]
                ids, n = ([np.frombuffer(row[f"{s}_{c}"], "<i8") for s in "ab"] for c in ("kinds", "copies"))
                x, y = (units(pa.array([row[f"{s}_raw"]]), d) for s in "ab")
                links = np.zeros((len(x), len(y)), bool)
                interval_links(x, y, places(x, dim, axes), places(y, dim, axes), least, eps, links)
                same = row["a"] == row["b"]
                if same:
                    np.fill_diagonal(links, False)
                if not links.any():
                    continue
                r, c = classes_of(links)
                node = [ids[0][r >= 0], ids[1][c >= 0]]
                count = [(links @ n[1])[r >= 0], (n[0] @ links)[c >= 0] * (not same)]
                to = [ids[0][r[r >= 0]], ids[0][c[c >= 0]]]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in (node, count, to)], ["node", "links", "other"])

    found = stored(loaded.mapInArrow(compare, "node long, links long, other long"), "grid-links")
    roots = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = kinds.join(roots, kinds["kind"] == roots["node"], "left").select(*key, "kind", "copies", "first_id", F.coalesce("root", "kind").alias("root"))
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(ids, "root").join(degree, named["kind"] == degree["node"], "left").select(
        *key, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    )
    out = rows.join(named, key, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("raw").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
