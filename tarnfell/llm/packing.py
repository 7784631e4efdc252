"""Best-fit packing with exact complements.

Documents become token pieces (one narrow pass), pieces a histogram of lengths, which has as many rows as a sequence has places however
large the corpus is. The plan is made on the histogram: for the longest length that is left, a single length, a pair or a triple that
fills the gap exactly is looked up in an index of such sums, and as many sequences of that pattern are closed as the counts allow; what has no exact complement
is packed best-fit. Pieces then take their places by their rank within their length, a sum of counts, so no length meets in one task.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import id_type, unclashed, written
from .words import give_back

#: Fixed value: the split pattern of byte-level BPE vocabularies of this kind.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with characters from here on go to the tokenizers library itself: two libraries' Unicode tables need not agree there.
SAFE_BELOW = "\u0530"


class Encoder:
    """Token ids of the tokenizer in a .json file. A byte-level BPE file whose merges rank in the order of their ids is run by tiktoken from
    the file's own vocabulary, which gives the same ids in a third of the time; every other file by tokenizers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        self.fast = _ranked(path)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and _safe(text):
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"))
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def _safe(text: str) -> bool:
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return max(text) < SAFE_BELOW


def _ranked(path: str):
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if spec.get("normalizer") or spec.get("post_processor") or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or model.get("type") != "BPE" or model.get("ignore_merges") or model.get("dropout"):
        return None
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or not t.get("special") for t in spec.get("added_tokens", [])):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies write as themselves
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    vocabulary = {k: v for k, v in model["vocab"].items() if k not in special}
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [vocabulary.get(m, -1) for m in merged]
    if len(vocabulary) != 256 + len(set(ids)) or any(b <= a for a, b in zip(ids, ids[1:], strict=False)) or ids and ids[0] < 256:
        return None
    return tiktoken.Encoding("ranked", pat_str=BYTE_PATTERN, mergeable_ranks={bytes(back[c] for c in k): v for k, v in vocabulary.items()}, special_tokens=special)


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids and end_id behind them. Only documents longer than size are cut: all
    pieces but the first have size tokens. Null text: empty, so one piece with end_id alone. Repeated rows give repeated pieces."""
    kind = id_type(docs, doc_id)

    def cut(batches):
        encode = Encoder(tokenizer_path)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                at, piece, start, length, crc = [], [], [], [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    ids = np.append(encode(t or ""), end_id).astype("<u4")
                    first = (len(ids) - 1) % size + 1
                    for p, s in enumerate([0, *range(first, len(ids), size)]):
                        n = first if p == 0 else size
                        at.append(i)
                        piece.append(p)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(ids[s : s + n].tobytes()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    return unclashed(docs, doc_id, text).mapInArrow(cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


class Sums:
    """Index of the sums of one, two and three available lengths. left[n]: pieces of length n; pairs[s]: unordered pairs of available lengths with sum s, where a
    length goes with itself only if there are two of it; triples[s]: lengths a for which s - a has a pair. Taking pieces away changes the index only when a length
    runs out or is down to one piece, by whole arrays."""

    def __init__(self, counts: dict[int, int], size: int):
        self.size = size
        self.left = np.zeros(size + 1, np.int64)
        self.free, self.twice = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
        self.pairs, self.triples = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
        for n, c in counts.items():
            self.change(n, c)

    def change(self, n: int, by: int) -> None:
        self.left[n] += by
        free, twice = bool(self.left[n] > 0), bool(self.left[n] > 1)
        had = self.pairs > 0
        if free != self.free[n]:
            step = 1 if free else -1
            self.free[n] = False
            self.pairs[n:] += step * self.free[: self.size + 1 - n]
            self.triples[n:] += step * had[: self.size + 1 - n]
            self.free[n] = free
        if twice != self.twice[n]:
            self.twice[n] = twice
            if 2 * n <= self.size:
                self.pairs[2 * n] += 1 if twice else -1
        now = self.pairs > 0
        for s in np.flatnonzero(now != had):
            self.triples[s:] += (1 if now[s] else -1) * self.free[: self.size + 1 - s]

    def exact(self, gap: int) -> list[int] | None:
        """One, two or three available lengths of sum gap, few before many, the longest first."""
        if self.free[gap]:
            return [gap]
        if self.pairs[gap]:
            return self._pair(gap)
        if self.triples[gap]:
            # a triple may need more of a length than there is, so those that the index names are tried
            for a in np.flatnonzero(self.free[:gap] & (self.pairs[gap - np.arange(gap)] > 0))[::-1]:
                self.change(int(a), -1)
                pair = self._pair(gap - int(a)) if self.pairs[gap - a] else None
                self.change(int(a), 1)
                if pair:
                    return [int(a), *pair]
        return None

    def _pair(self, total: int) -> list[int]:
        a = np.arange((total + 1) // 2, total)
        a = int(a[self.free[a] & self.free[total - a] & ((2 * a != total) | self.twice[a])][-1])
        return [a, total - a]


def plan(counts: dict[int, int], size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ([(length, times in one sequence), ...], sequences of it) that use up all counts. Work depends on size, not on the counts."""
    sums = Sums(counts, size)
    out: list[tuple[list[tuple[int, int]], int]] = []

    def take(lengths: list[int]) -> None:
        pattern = sorted({n: lengths.count(n) for n in lengths}.items(), reverse=True)
        k = min(int(sums.left[n]) // m for n, m in pattern)
        for n, m in pattern:
            sums.change(n, -k * m)
        out.append((pattern, k))

    if sums.left[size]:
        take([size])
    for n in range(size - 1, 0, -1):
        while sums.left[n]:
            sums.change(n, -1)
            found = sums.exact(size - n)
            sums.change(n, 1)
            if found is None:
                break
            take([n, *found])
    while sums.left.any():
        lengths = [int(np.flatnonzero(sums.left)[-1])]
        gap = size - lengths[0]
        free = sums.left.copy()
        free[lengths[0]] -= 1
        while gap:
            fits = np.flatnonzero(free[: gap + 1])
            if not len(fits):
                break
            n = int(fits[-1])
            m = min(int(free[n]), gap // n)
            lengths += [n] * m
            free[n] -= m
            gap -= n * m
        take(lengths)
    return out


def pack(pieces: DataFrame, size: int = 2048, rows_per_group: int = 50_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...). Written first: the histogram and the ranks must see the same rows."""
    spark = pieces.sparkSession
    pieces = written(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most size rows
    groups = max(1, min(65_536, -(-sum(counts.values()) // rows_per_group)))
    entries, base, used = [], 0, dict.fromkeys(counts, 0)
    for pattern, k in plan(counts, size):
        at = 0
        for n, m in pattern:
            entries.append((n, used[n], used[n] + k * m, base, at, m))
            used[n] += k * m
            at += n * m
        base += k
    places = spark.createDataFrame(entries, "length bigint, low bigint, high bigint, base bigint, at bigint, times bigint")  # bounded by size
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("length", "_group").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_group").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    ranked = ranked.join(sums, ["length", "_group"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    placed = ranked.join(F.broadcast(places), (ranked.length == places.length) & (F.col("_rank") >= F.col("low")) & (F.col("_rank") < F.col("high"))).drop(places.length)
    turn = F.col("_rank") - F.col("low")
    return placed.select(*pieces.columns, (F.col("base") + F.floor(turn / F.col("times"))).cast("long").alias("sequence_id"), (F.col("at") + F.col("length") * (turn % F.col("times"))).cast("long").alias("offset"))


def packed(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: all documents in nearly as few sequences as their tokens need.
    An empty table gives no rows; null and empty texts are one piece, the end id; repeated rows and rows without a doc_id are packed as often as they occur. Texts of any
    length are encoded whole; pieces of one length take their places by doc_id and piece, so that ties don't matter. Extra columns are left out."""
    return pack(token_pieces(docs, tokenizer_path, size, end_id), size)
