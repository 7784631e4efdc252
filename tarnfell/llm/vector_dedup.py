"""Near-duplicate vectors by PCA-ordered tiled comparison.

Unit vectors are rotated to principal axes, which leaves cosines as they are and puts most of them into the leading coordinates. A cell is
a box of leading coordinates at least as wide as the largest distance two linked vectors can have, so links lie in the same or in adjacent cells.
Cells are dealt into tiles of bounded size, and every pair of tiles of adjacent cells is a task's input: it multiplies a block of leading
dimensions after the other, bounds what is missing by the product of the suffix norms, and drops the pairs of vectors that can no
longer reach the limit. Links are counted, and a spanning forest of them is kept: no pair is ever a row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, id_type, salted_join, spanning_roots, unclashed, written

TILE = 4096
BLOCK = 1024
#: Leading axes that make cells, and the least width of a cell: whatever the limit, there are at most (2 / CELL_WIDTH + 2) ** CELL_AXES = 1,000 cells.
CELL_AXES, CELL_WIDTH = 3, 0.25
#: Dimensions that are multiplied before the first two bounds.
STEPS = (16, 32)
_NEAR = 1e-9


def _valid(vec: str):
    return F.col(vec).isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(vec, lambda x: x != 0)


def _unit(column: pa.Array, dims: int) -> np.ndarray:
    x = np.asarray(column.flatten(), np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal_axes(vectors: DataFrame, dims: int) -> np.ndarray:
    """(dims, dims) orthonormal, leading axis first, from the second moments of all vectors; dims squared sums reach the driver."""

    def moments(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            x = _unit(batch.column(0), dims)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims)), pa.array(total.ravel())], ["cell", "value"])

    rows = vectors.select("embedding").mapInArrow(moments, "cell bigint, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(dims * dims)
    for r in rows:
        total[r["cell"]] = r["value"]
    _, axes = np.linalg.eigh(total.reshape(dims, dims))
    return np.ascontiguousarray(axes[:, ::-1])


def compare(a: np.ndarray, b: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of rotated unit rows with cosine >= least; i < j if a and b are the same rows."""
    suffix = lambda x: [np.sqrt((x[:, s:] ** 2).sum(1)) for s in STEPS]
    ra, rb = suffix(a), suffix(b)
    steps = [0, *(s for s in STEPS if s < a.shape[1]), a.shape[1]]
    out_i, out_j = [], []
    for i0 in range(0, len(a), BLOCK):
        for j0 in range(i0 if same else 0, len(b), BLOCK):
            p, q = a[i0 : i0 + BLOCK], b[j0 : j0 + BLOCK]
            sums = p[:, : steps[1]] @ q[:, : steps[1]].T
            alive = None
            for k in range(1, len(steps)):
                rest = np.outer(ra[k - 1][i0 : i0 + BLOCK], rb[k - 1][j0 : j0 + BLOCK]) if k < len(steps) - 1 else None
                if alive is None:
                    keep = sums >= least - _NEAR - rest if rest is not None else sums >= least - _NEAR
                    if k == len(steps) - 1:
                        alive = np.nonzero(keep)
                        sums = sums[alive]
                        break
                    if keep.mean() > 0.1:
                        sums += p[:, steps[k] : steps[k + 1]] @ q[:, steps[k] : steps[k + 1]].T
                        continue
                    alive = np.nonzero(keep)
                    sums = sums[alive]
                else:
                    limit = least - _NEAR - (rest[alive] if rest is not None else 0)
                    keep = sums >= limit
                    alive, sums = (alive[0][keep], alive[1][keep]), sums[keep]
                if not len(sums):
                    break
                if k < len(steps) - 1:
                    sums = sums + np.einsum("ij,ij->i", p[alive[0], steps[k] : steps[k + 1]], q[alive[1], steps[k] : steps[k + 1]])
            i, j = alive[0] + i0, alive[1] + j0
            if same:
                up = i < j
                i, j, sums = i[up], j[up], sums[up]
            out_i.append(i)
            out_j.append(j)
    return np.concatenate(out_i or [np.zeros(0, int)]), np.concatenate(out_j or [np.zeros(0, int)])


def linked_vectors(vectors: DataFrame, least: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do vectors of different lengths. Equal
    vectors are compared once and counted as often as they occur, so rows that repeat a vec_id count as vectors of their own under one name; rows without a vec_id link with nothing.
    Extra columns are left out."""
    own = unclashed(vectors, vec_id, embedding).toDF("vec_id", "embedding")
    spark = vectors.sparkSession
    kind = id_type(own, "vec_id")
    good = own.where(_valid("embedding") & F.col("vec_id").isNotNull())
    distinct = written(good.withColumn("embedding", F.col("embedding").cast("array<double>")).groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.size(F.first("embedding")).alias("dims")), "vectors")
    sizes = [r["dims"] for r in distinct.select("dims").distinct().collect()]
    found = [_linked(distinct.where(F.col("dims") == d), d, least, kind) for d in sizes]
    links = spark.createDataFrame([], f"vec_id {kind}, n bigint, root {kind}")
    for f in found:
        links = links.unionByName(f)
    links = written(links, "links")
    labels = components(links.select(F.col("vec_id").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy("vec_id").agg(F.sum("n").alias("n"))
    per = distinct.join(counts, "vec_id", "left").join(labels, distinct.vec_id == labels.node, "left")
    per = per.select("embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    all_links = salted_join(good.withColumn("embedding", F.col("embedding").cast("array<double>")), per, ["embedding"], "vec_id", counts=distinct.select("embedding", F.col("copies").alias("n"))).select("vec_id", "n_links", "component_id")
    out = all_links.unionByName(own.where(~(_valid("embedding") & F.col("vec_id").isNotNull()) | F.col("embedding").isNull()).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select("vec_id", F.col("n_links").cast("long"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def _linked(vectors: DataFrame, dims: int, least: float, kind: str) -> DataFrame:
    """(vec_id, n, root): links of a vector to other vectors (copies counted) and a vector that it is connected to, per pair of tiles."""
    spark = vectors.sparkSession
    axes = spark.sparkContext.broadcast(principal_axes(vectors, dims))
    width = max(math.sqrt(max(0.0, 2 - 2 * least)) + 1e-6, CELL_WIDTH)
    lead = min(CELL_AXES, dims)

    def celled(batches):
        for batch in batches:
            y = _unit(batch.column(1), dims) @ axes.value[:, :lead]
            c = np.floor(y / width).astype(np.int64)
            cell = np.zeros(len(c), np.int64)
            for k in range(CELL_AXES):
                cell = cell * 64 + (c[:, k] + 32 if k < lead else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(cell)], ["vec_id", "embedding", "copies", "cell"])

    rows = written(vectors.select("vec_id", "embedding", "copies").mapInArrow(celled, f"vec_id {kind}, embedding array<double>, copies bigint, cell bigint"), "cells")
    counts = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # as many rows as there are cells
    tiles = {c: -(-n // TILE) for c, n in counts.items()}
    near = []
    for c in counts:
        for d in counts:
            if all(abs((c >> s & 63) - (d >> s & 63)) <= 1 for s in (0, 6, 12)):
                near.append((c, d, tiles[c], tiles[d]))
    near = spark.createDataFrame(near, "cell bigint, other bigint, tiles int, others int")  # at most 27 rows a cell
    dealt = rows.join(F.broadcast(near.select("cell", "tiles").distinct()), "cell").withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.col("tiles")).cast("int"))

    def tiled(batches):
        key, ids, data, copies = None, [], [], []

        def row():
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([ids]), pa.array([np.concatenate(data).tobytes()], pa.binary()), pa.array([copies], pa.list_(pa.int64()))], ["cell", "tile", "ids", "data", "copies"])

        for batch in batches:
            cells, places = np.asarray(batch.column(3)), np.asarray(batch.column(4))
            cuts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (places[1:] != places[:-1])) + 1), batch.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if key is not None and key != (cells[i], places[i]):
                    yield row()
                    ids, data, copies = [], [], []
                key = (cells[i], places[i])
                ids += batch.column(0).slice(i, j - i).to_pylist()
                data.append(np.asarray(batch.column(1).slice(i, j - i).flatten(), np.float64))
                copies += batch.column(2).slice(i, j - i).to_pylist()
        if key is not None:
            yield row()

    packed = dealt.repartition("cell", "tile").sortWithinPartitions("cell", "tile").select("vec_id", "embedding", "copies", "cell", "tile").mapInArrow(tiled, f"cell bigint, tile int, ids array<{kind}>, data binary, copies array<bigint>")
    mates = packed.join(F.broadcast(near), "cell").withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    first = (F.col("cell") < F.col("other")) | ((F.col("cell") == F.col("other")) & (F.col("tile") <= F.col("mate")))
    c1, t1 = F.when(first, F.col("cell")).otherwise(F.col("other")), F.when(first, F.col("tile")).otherwise(F.col("mate"))
    c2, t2 = F.when(first, F.col("other")).otherwise(F.col("cell")), F.when(first, F.col("mate")).otherwise(F.col("tile"))
    pairs = mates.select(c1.alias("c1"), t1.cast("int").alias("t1"), c2.alias("c2"), t2.cast("int").alias("t2"), (~first).cast("int").alias("side"), "ids", "data", "copies")
    pairs = pairs.repartition("c1", "t1", "c2", "t2").sortWithinPartitions("c1", "t1", "c2", "t2", "side")

    def matched(batches):
        held = None
        for batch in batches:
            for r in range(batch.num_rows):
                c1, t1, c2, t2, side, ids, data, copies = (batch.column(k)[r].as_py() for k in range(8))
                key, same = (c1, t1, c2, t2), (c1, t1) == (c2, t2)
                x = np.frombuffer(data, np.float64).reshape(-1, dims)
                x = x / np.abs(x).max(1, keepdims=True)
                x = x / np.sqrt((x * x).sum(1, keepdims=True))
                now = (key, ids, x, x @ axes.value, np.array(copies, np.int64))
                if side == 0 and not same:
                    held = now
                    continue
                one = now if same else held
                if one is None or one[0] != key:
                    continue
                i, j = compare(one[3], now[3], least, same)
                if len(i):
                    exact = np.concatenate([np.einsum("ij,ij->i", one[2][i[k : k + 100_000]], now[2][j[k : k + 100_000]]) for k in range(0, len(i), 100_000)])
                    i, j = i[exact >= least], j[exact >= least]
                if not len(i):
                    continue
                n = len(one[1])
                both = ids if same else one[1] + ids
                shift = 0 if same else n
                counts = np.bincount(i, now[4][j], len(both)) + np.bincount(j + shift, one[4][i], len(both))
                order = np.argsort(np.array(both), kind="stable")
                rank = np.empty(len(both), np.int64)
                rank[order] = np.arange(len(both))
                root = order[spanning_roots(rank[i], rank[j + shift], len(both))][rank]
                some = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([both[k] for k in some], batch.schema.field("ids").type.value_type), pa.array(counts[some].astype(np.int64)), pa.array([both[root[k]] for k in some], batch.schema.field("ids").type.value_type)], ["vec_id", "n", "root"])

    return pairs.mapInArrow(matched, f"vec_id {kind}, n bigint, root {kind}")
