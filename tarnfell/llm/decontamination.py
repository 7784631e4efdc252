"""Benchmark decontamination by spaced seeds and verified diagonals.

A seed looks at two runs of three words and ignores what stands between them; the fixed masks differ in how far the second run is from the first.
Seeds of all test items and of the documents meet in a join on their hashes, and around every common seed the diagonal (document position less item position) is
verified word by word. A document overlaps with an item if some stretch of a diagonal has at least needed() equal words and a substituted word for every
MISS_COST equal ones at most. The masks are lossless for this: whatever words are substituted, every such stretch holds a seed of both sides (a test
goes through all patterns of substituted words). A document's seeds are looked up in a bit table of the items' seeds before the join, so that what is
shuffled are the few seeds that may be common; the table's size is bounded, the join decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import salted_join, unclashed, written
from .words import LOWER_VALUES, NOT_WORD, find_words, mix, phrase_hashes, slices, text_buffers, word_hashes

#: Words in a run of a mask, and words from the start of the first run to that of the second.
RUN, GAPS = 3, (3, 6, 9, 12, 15)
#: Equal words of a stretch for each substituted one; the least equal words that the masks are lossless for.
MISS_COST, LEAST = 4, 13
#: Share of an item's words that must be equal if those are fewer than the least; items under SHORT words must be there whole.
SHARE, SHORT = (5, 6), 12
#: Items under so many words have no room for two runs: their seed is the whole phrase, and documents are looked through for phrases of these lengths, if such items exist.
PHRASES = RUN + GAPS[0]
#: The bit table, where a seed sets two bits, has 2 ** TABLE_BITS bits at most (8 MiB); up to BROADCAST seeds (24 bytes each) are sent to every executor, more are joined by shuffle.
TABLE_BITS, BROADCAST = 26, 1_000_000


def needed(n_words, least: int):
    """Equal words that an overlap with an item of n_words words must have."""
    return np.where(n_words < SHORT, n_words, np.minimum(least, -(-n_words * SHARE[0] // SHARE[1])))


def best_stretch(same: np.ndarray) -> tuple[int, int, int]:
    """Start, end and equal words of the stretch with most equal words among those with MISS_COST equal words for each other one."""
    sums = np.concatenate([[0], np.cumsum(np.where(same, 1, -MISS_COST))])
    equal = np.concatenate([[0], np.cumsum(same)])
    start = np.searchsorted(-np.minimum.accumulate(sums), -sums, "left")  # the first place that is not above the end
    end = int((equal - equal[start]).argmax())
    at = int(start[end])
    return at + int(same[at:end].argmax()) if end > at else at, end, int(equal[end] - equal[at])


def seeds(words: np.ndarray, rows: np.ndarray, first: np.ndarray, phrases: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hash and word of every seed, words being numbered over all rows, in order of the words; phrases: the lengths of short phrases that are seeds too, wherever they stand."""
    at, hashes = [], []
    h, _ = phrase_hashes(words, rows, RUN)
    for g in GAPS:
        n = len(h) - g
        if n > 0:
            whole = np.flatnonzero(rows[:n] == rows[g + RUN - 1 : g + RUN - 1 + n])
            at.append(whole)
            hashes.append(mix(h[whole] + mix(h[whole + g] + np.uint64(g))))
    for n in phrases:
        own, whole = phrase_hashes(words, rows, n)
        at.append(np.flatnonzero(whole))
        hashes.append(mix(own[whole] + np.uint64(n << 32)))
    if not at:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at, hashes = np.concatenate(at), np.concatenate(hashes)
    order = np.argsort(at, kind="stable")
    return hashes[order], at[order]


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their rows, and the first word of each row."""
    ws, we, rows = find_words(data, offsets, NOT_WORD)
    return word_hashes(data, ws, we, LOWER_VALUES), rows, np.searchsorted(rows, np.arange(len(offsets)))


def _item_seeds(batches):
    for part, data, offsets in slices(batches):
        words, rows, first = _words(data, offsets)
        h, at = seeds(words, rows, first)
        sizes = np.diff(first)
        for n in range(1, PHRASES):
            own = np.flatnonzero(sizes == n)
            whole, _ = phrase_hashes(words, rows, n)
            h, at = np.append(h, mix(whole[first[own]] + np.uint64(n << 32)) if len(own) else h[:0]), np.append(at, first[own])
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), part.column(0).take(pa.array(rows[at])), pa.array((at - first[rows[at]]).astype(np.int32)), pa.array(np.where(sizes < PHRASES, sizes, 0)[rows[at]].astype(np.int32))], ["hash", "item", "item_place", "phrase"])


class Benchmark:
    """The items (item, item_id, text) and their seeds (hash, item, item_place) as tables, and the bit table of the seeds. What reaches the driver is bounded by TABLE_BITS."""

    def __init__(self, benchmark: DataFrame, least: int, item_id: str, text: str):
        if least < LEAST:
            raise ValueError(f"the masks find every overlap of {LEAST} equal words or more, not of {least}")
        spark = benchmark.sparkSession
        items = unclashed(benchmark, item_id, text).toDF("item_id", "text").where("text is not null")
        self.least = least
        self.items = written(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
        self.seeds = written(self.items.select("item", "text").mapInArrow(_item_seeds, "hash bigint, item bigint, item_place int, phrase int"), "seeds")
        lengths = self.seeds.groupBy("phrase").agg(F.count("*").alias("n")).collect()  # at most PHRASES rows
        self.n_seeds = sum(r["n"] for r in lengths)
        self.phrases = tuple(sorted(r["phrase"] for r in lengths if r["phrase"]))
        self.bits = min(max(16, self.n_seeds.bit_length() + 10), TABLE_BITS)
        slots = F.explode(F.array(F.shiftrightunsigned("hash", 64 - self.bits), F.col("hash").bitwiseAND(F.lit((1 << self.bits) - 1))))
        cells = self.seeds.select(slots.alias("slot")).select(F.shiftright("slot", 6).alias("cell"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("slot").bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
        cells = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
        table = np.zeros(1 << (self.bits - 6), np.int64)
        table[np.asarray(cells["cell"])] = np.asarray(cells["bits"])
        self.table = spark.sparkContext.broadcast(table.view(np.uint8))

    def looked(self, docs: DataFrame, text: str) -> DataFrame:
        """row, own (the row of docs), hits: the rows with seeds that may be an item's; written."""
        table, bits, phrases = self.table, self.bits, self.phrases

        def found(batches):
            for part, data, offsets in slices(batches, text):
                words, rows, first = _words(data, offsets)
                h, at = _maybe(words, rows, first, table.value, bits, phrases)
                owner = rows[at]
                some = np.unique(owner)
                ends = np.append(np.searchsorted(owner, some), len(owner)).astype(np.int32)
                hits = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array((at - first[owner]).astype(np.int32))], ["hash", "place"])
                kept = part.take(pa.array(some))
                own = pa.StructArray.from_arrays(kept.columns, fields=list(kept.schema))
                yield pa.RecordBatch.from_arrays([own, pa.ListArray.from_arrays(pa.array(ends), hits)], ["own", "hits"])

        hits = T.ArrayType(T.StructType([T.StructField("hash", T.LongType()), T.StructField("place", T.IntegerType())]))
        rows = docs.mapInArrow(found, T.StructType([T.StructField("own", docs.schema), T.StructField("hits", hits)]))
        return written(rows.withColumn("row", F.monotonically_increasing_id()), "looked")

    def unlike(self, docs: DataFrame, text: str) -> DataFrame:
        """The rows of docs that share no seed with an item; narrow."""
        table, bits, phrases = self.table, self.bits, self.phrases

        def clean(batches):
            for part, data, offsets in slices(batches, text):
                words, rows, first = _words(data, offsets)
                keep = np.ones(part.num_rows, bool)
                keep[rows[_maybe(words, rows, first, table.value, bits, phrases)[1]]] = False
                yield part.filter(pa.array(keep))

        return docs.mapInArrow(clean, docs.schema)

    def overlaps(self, looked: DataFrame, text: str) -> DataFrame:
        """row, item, doc_word, item_word, n_words, n_equal, whole (the text has just the item's number of words) of every verified overlap of looked() rows."""
        hits = looked.select("row", F.inline("hits"))
        joined = hits.join(F.broadcast(self.seeds.drop("phrase")), "hash") if self.n_seeds <= BROADCAST else salted_join(hits, self.seeds.drop("phrase"), ["hash"], "row")
        pairs = joined.select("row", "item", (F.col("place") - F.col("item_place")).alias("diagonal")).distinct()
        # diagonals of one text and item: fewer than both have words
        wanted = pairs.groupBy("row", "item").agg(F.sort_array(F.collect_list("diagonal")).alias("diagonals"))
        rows = wanted.join(looked.select("row", F.col(f"own.`{text}`").alias("text")), "row").join(self.items.select("item", F.col("text").alias("item_text")), "item")
        least = self.least

        def verified(batches):
            for part, data, offsets in slices(batches):
                words, _, first = _words(data, offsets)
                ends, data = text_buffers(part.column("item_text"))
                theirs, _, start = _words(data[ends[0] : ends[-1]], ends - ends[0])
                need = needed(np.diff(start), least)
                out = []
                for i, diagonals in enumerate(part.column("diagonals").to_pylist()):
                    own, item = words[first[i] : first[i + 1]], theirs[start[i] : start[i + 1]]
                    for d in diagonals:
                        a, b = max(0, -d), min(len(item), len(own) - d)
                        low, high, equal = best_stretch(item[a:b] == own[a + d : b + d])
                        if equal >= need[i]:
                            out.append((i, a + low + d, a + low, high - low, equal, int(len(item) == len(own))))
                columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] or [pa.array([], pa.int64())] * 6
                columns[5] = columns[5].cast(pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(c).take(columns[0]) for c in ("row", "item")] + columns[1:], ["row", "item", "doc_word", "item_word", "n_words", "n_equal", "whole"])

        return rows.select("row", "item", "text", "item_text", "diagonals").mapInArrow(verified, "row bigint, item bigint, doc_word bigint, item_word bigint, n_words bigint, n_equal bigint, whole boolean")


def _maybe(words: np.ndarray, rows: np.ndarray, first: np.ndarray, table: np.ndarray, bits: int, phrases: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The seeds whose two bits are set."""
    h, at = seeds(words, rows, first, phrases)
    for slot in (lambda x: x >> np.uint64(64 - bits), lambda x: x & np.uint64((1 << bits) - 1)):
        own = slot(h)
        maybe = np.flatnonzero((table[own >> np.uint64(3)] >> (own & np.uint64(7)).astype(np.uint8)) & 1)
        h, at = h[maybe], at[maybe]
    return h, at


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """doc_id, item_id, doc_word, item_word, n_words, n_equal: one row for each document, item and diagonal with an overlap, by its stretch with most
    equal words: least of them, or five sixths of the item's words if those are fewer, and at most one substituted word for four equal ones. Every such
    overlap is found, wherever its substituted words stand. Words are compared without ASCII case and punctuation. Items under 12 words must stand in the text
    whole; very short ones stand in many texts, so drop those that say little by n_words, the words of the stretch.

    Null and empty texts overlap with nothing; an empty benchmark or table gives no rows; repeated rows of either table are reported as often as they occur, rows
    without an id under the id null. Texts of any length are searched whole. Of equally good stretches of a diagonal the first counts. Extra columns are left out."""
    own = unclashed(docs, doc_id, text).toDF("doc_id", "text")
    bench = Benchmark(benchmark, least, item_id, text)
    looked = bench.looked(own, "text")
    found = bench.overlaps(looked, "text").join(looked.select("row", "own.doc_id"), "row").join(bench.items.select("item", "item_id"), "item")
    return found.select("doc_id", "item_id", "doc_word", "item_word", "n_words", "n_equal")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, shortest: int = PHRASES) -> DataFrame:
    """The rows of docs that overlap with no item, as contaminated() defines it; all columns as they are. An item under shortest words, such as a bare number or a yes, counts only where it is the
    whole text. Rows without a common seed pass a narrow step and are never shuffled; null texts and repeated rows stay."""
    bench = Benchmark(benchmark, least, "item_id", "text")
    looked = bench.looked(docs, "text")
    bad = bench.overlaps(looked, "text").where((F.col("n_words") >= shortest) | F.col("whole")).select("row").distinct()
    rest = looked.join(bad, "row", "left_anti").select("own.*")
    return bench.unlike(docs, "text").union(rest)
