"""Embeddings: computing them by a user's function, exact nearest vectors by cosine, block against block, the evidence gate."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.stores import sized, written

#: Bytes of a block of vectors.
TILE_BYTES = 2 << 20


def embed(rows: DataFrame, function: Callable[[list[str]], np.ndarray], text: str = "embed_text", key: str = "chunk_id", dimensions: int | None = None, batch: int = 256) -> DataFrame:
    """key, embedding: function maps a list of texts to a matrix, whose width is checked if dimensions is given."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                out = np.asarray(function([t or "" for t in part.column(1).to_pylist()]), np.float32)
                if out.shape[0] != part.num_rows or dimensions is not None and out.shape[1] != dimensions:
                    raise ValueError(f"the embedding function gave {out.shape} for {part.num_rows} texts")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), out.shape[1]).cast(pa.list_(pa.float32()))], [key, "embedding"])

    return rows.select(key, text).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, embedding array<float>")


def _usable(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(whether each list is a vector with a direction: no null, finite, not zero; its length)."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
    flat = np.asarray(lists.flatten().cast(pa.float64()).fill_null(np.nan)).astype(np.float64)
    ends = np.cumsum(sizes)
    sums = np.concatenate([[0.0], np.cumsum(np.where(np.isfinite(flat), 0.0, 1.0))]), np.concatenate([[0], np.cumsum(flat != 0)])
    bad, some = (x[ends] - x[ends - sizes] for x in sums)
    return (sizes > 0) & (bad == 0) & (some > 0), sizes


def _tiles(rows: DataFrame, key: str, size: int) -> DataFrame:
    """tile, width, ids, matrix (unit vectors, doubles): the vectors of a partition in blocks of at most size bytes (one vector at least), one width each."""

    def run(batches):
        held: dict[int, tuple[list, list]] = {}
        total = 0

        def tile(width: int) -> pa.RecordBatch:
            ids, parts = held.pop(width)
            matrix = np.concatenate(parts)
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([width], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(matrix)], pa.int32()), pa.concat_arrays(ids)), pa.array([matrix.tobytes()], pa.binary())], ["tile", "width", "ids", "matrix"])

        for b in batches:
            own, lists = b.column(0), b.column(1)
            good, sizes = _usable(lists)
            for width in np.unique(sizes[good]).tolist():
                at = np.flatnonzero(good & (sizes == width))
                step = max(1, size // (8 * width))
                for i in range(0, len(at), step):
                    some = pa.array(at[i : i + step])
                    x = np.asarray(lists.take(some).flatten(), np.float64).reshape(-1, width)
                    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the norm
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    if total + x.nbytes > size:
                        yield from [tile(w) for w in list(held)]
                        total = 0
                    ids, parts = held.setdefault(width, ([], []))
                    ids.append(own.take(some))
                    parts.append(x)
                    total += x.nbytes
        yield from [tile(w) for w in list(held)]

    return rows.select(key, "embedding").mapInArrow(run, f"tile string, width int, ids array<{rows.schema[key].dataType.simpleString()}>, matrix binary")


class Best:
    """The k best of what a block of questions has met so far."""

    def __init__(self, ids: pa.Array, matrix: np.ndarray, k: int, kind: pa.DataType):
        self.ids, self.matrix, self.k = ids, matrix, k
        self.lead = max(1, matrix.shape[1] // 4)
        self.rest = np.linalg.norm(matrix[:, self.lead :], axis=1)
        self.row, self.score, self.known = np.zeros(0, np.int64), np.zeros(0), pa.array([], kind)
        self.needed = np.full(len(matrix), -np.inf)

    def meet(self, ids: pa.Array, x: np.ndarray) -> None:
        """Leading dimensions first: what the rest could add at most (the product of both rests' lengths) keeps most products of a later block from being finished."""
        part = self.matrix[:, : self.lead] @ x[:, : self.lead].T
        may = part + self.rest[:, None] * np.linalg.norm(x[:, self.lead :], axis=1) >= self.needed[:, None] - 1e-8
        q, v = np.nonzero(may)
        if len(q) * 4 > may.size:
            s = (self.matrix @ x.T).round(9)
            top = np.partition(s, max(0, s.shape[1] - self.k), axis=1)[:, max(0, s.shape[1] - self.k)]
            q, v = np.nonzero(s >= np.maximum(top, self.needed)[:, None])
            score = s[q, v]
        else:
            score = np.empty(len(q))
            for i in range(0, len(q), 1 << 16):
                a, b = q[i : i + (1 << 16)], v[i : i + (1 << 16)]
                score[i : i + (1 << 16)] = np.einsum("ij,ij->i", self.matrix[a], x[b]).round(9)
            on = score >= self.needed[q]
            q, v, score = q[on], v[on], score[on]
        row, score = np.concatenate([self.row, q]), np.concatenate([self.score, score])
        known = pa.concat_arrays([self.known, ids.take(pa.array(v))])
        order = np.empty(len(known), np.int64)
        order[np.asarray(pc.sort_indices(known))] = np.arange(len(known))
        by = np.lexsort((order, -score, row))
        row = row[by]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = by[place < self.k]
        self.row, self.score, self.known = row[place < self.k], score[keep], known.take(pa.array(keep))
        last = place == self.k - 1
        self.needed[row[last]] = score[by[last]]

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([self.ids.take(pa.array(self.row)), self.known, pa.array(self.score)], ["question_id", "chunk_id", "score"])


def vector_search(questions: DataFrame, vectors: DataFrame, k: int = 12, size: int = TILE_BYTES) -> DataFrame:
    """question_id, chunk_id, score, rank: the k vectors of highest cosine (9 decimals), exact; ties by chunk_id.

    questions (question_id, embedding), vectors (chunk_id, embedding), any number of both: each becomes blocks of bounded size, and every block of vectors meets every block of questions of its width, in
    one pass with the questions' blocks in all tasks where they prove small, else block by block over both. A task keeps the k best for each question it holds, and these k are ranked once more.
    Nothing is collected. Vectors that are null, zero, or hold null or non-finite numbers match nothing."""
    kind, qkind = (df.schema[c].dataType.simpleString() for df, c in ((vectors, "chunk_id"), (questions, "question_id")))
    asked = written(_tiles(questions, "question_id", size), "questions").toDF("q_tile", "q_width", "q_ids", "q_matrix")
    # a condition that is no key: blocks of one width, mostly all there are, must not meet in one task
    met = _tiles(vectors, "chunk_id", size).crossJoin(sized(asked, 1000, 64 << 20)).where("width <= q_width and width >= q_width")
    chunk_kind = to_arrow_type(vectors.schema["chunk_id"].dataType)

    def run(batches):
        held: dict[str, Best] = {}
        for b in batches:
            for i in range(b.num_rows):
                q, ids, matrix, own, x = (b.column(j) for j in range(5))
                width = b.column(5)[i].as_py()
                name = q[i].as_py()
                if name not in held:
                    held[name] = Best(ids.slice(i, 1).flatten(), np.frombuffer(matrix[i].as_py(), np.float64).reshape(-1, width), k, chunk_kind)
                held[name].meet(own.slice(i, 1).flatten(), np.frombuffer(x[i].as_py(), np.float64).reshape(-1, width))
        yield from (h.rows() for h in held.values())

    found = met.select("q_tile", "q_ids", "q_matrix", "ids", "matrix", "width").mapInArrow(run, f"question_id {qkind}, chunk_id {kind}, score double")
    best = Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def evidence_gate(questions: DataFrame, vector_hits: DataFrame, keyword_hits: DataFrame, min_score: float | None) -> DataFrame:
    """Adds passes: false for a semantic or hybrid question whose best vector score is below min_score and that has no keyword hit. None: the gate is off."""
    if min_score is None:
        return questions.withColumn("passes", F.lit(True))
    best = vector_hits.groupBy("question_id").agg(F.max("score").alias("_best"))
    some = keyword_hits.select("question_id").distinct().withColumn("_some", F.lit(True))
    joined = questions.join(best, "question_id", "left").join(some, "question_id", "left")
    weak = (F.coalesce("_best", F.lit(0.0)) < min_score) & F.col("_some").isNull() & F.col("mode").isin("semantic", "hybrid")
    return joined.withColumn("passes", ~weak).drop("_best", "_some")
