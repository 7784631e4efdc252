"""Removal of repeated passages with sharded automata of confirmed phrases.

A window is WINDOW consecutive words. Every window holds an anchor, the smallest hash among its short phrases, and equal windows have equal
anchors, so windows that occur in two documents have anchors that do: one word in twenty is an anchor, and only documents with a recurring one
are looked at again. Their windows are grouped by hash with the first document that holds each (confirmation). A first document's confirmed windows form
passages; they are compiled into an Aho-Corasick automaton of half-window pieces, since every window of a passage holds a piece that starts at a multiple of
half a window. Automata are sharded by first document and, where a passage is shared by many, by salt; the confirmed stretches of all
documents stream through the automata of their passages, and every piece that is found is extended word by word, so that what is removed is equal in
its words and not only in a hash.

Documents with the same words need no windows to be found: all but the smallest doc_id of such a group stream through the automaton of that one's whole text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_type, salted_join, unclashed, written
from .words import find_words, mix, phrase_hashes, powers, slices, word_hashes

WINDOW = 50
PHRASE = 12
#: Documents that meet one copy of a passage's automaton.
SHARE = 512
_TO_SPACE = bytes(32 if i in (9, 10, 11, 12, 13) else i for i in range(256))


def anchors(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of the window from each word on, and whether the window lies in one row."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    low, _ = phrase_hashes(words, rows, PHRASE)
    width, span = WINDOW - PHRASE + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:n], low[width - span : width - span + n])
    return low, rows[:n] == rows[WINDOW - 1 :]


def plain_words(text: bytes) -> bytes:
    """The words joined by one space."""
    text = text.translate(_TO_SPACE).strip(b" ")
    return b" ".join(text.split()) if b"  " in text else text


def _surveyed(docs: DataFrame) -> DataFrame:
    """doc_id, t, n_words, whole_sha256, key1, key2 (equal for equal words; null without), anchors (distinct, of all windows); narrow."""

    def survey(batches):
        for part, data, offsets in slices(batches):
            ws, we, rows = find_words(data, offsets)
            words = word_hashes(data, ws, we)
            first = np.searchsorted(rows, np.arange(part.num_rows + 1))
            n = np.diff(first)
            keys = []
            for k, base in enumerate((0x9FB21C651E98DF25, 0xBF58476D1CE4E5B9)):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words + np.uint64(k)) * powers(base, len(words)))])
                keys.append(mix((sums[first[1:]] - sums[first[:-1]]) * powers(base, len(words) + 1, True)[first[:-1]] + n.astype(np.uint64)).view(np.int64))
            low, whole = anchors(words, rows)
            at = np.flatnonzero(whole)
            at = at[np.append(True, (low[at][1:] != low[at][:-1]) | (rows[at][1:] != rows[at][:-1]))] if len(at) else at
            pairs = np.unique(np.stack([rows[at].astype(np.uint64), low[at]], 1), axis=0) if len(at) else np.zeros((0, 2), np.uint64)
            cuts = np.searchsorted(pairs[:, 0], np.arange(part.num_rows + 1, dtype=np.uint64))
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.ascontiguousarray(pairs[:, 1]).view(np.int64)))
            raw = data.tobytes()
            shas = [hashlib.sha256(plain_words(raw[a:b])).hexdigest() for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n.astype(np.int64)), pa.array(shas), *(pa.array(k, mask=n == 0) for k in keys), lists], ["doc_id", "t", "n_words", "whole_sha256", "key1", "key2", "anchors"])

    return docs.select("doc_id", "t", "text").mapInArrow(survey, f"doc_id {id_type(docs)}, t bigint, n_words bigint, whole_sha256 string, key1 bigint, key2 bigint, anchors array<bigint>")


def _windows(candidates: DataFrame) -> DataFrame:
    """(window, doc_id, t, low, high) of the windows whose anchor recurs, with their first and last place in the text; narrow."""

    def emitted(batches):
        for part, data, offsets in slices(batches):
            ws, we, rows = find_words(data, offsets)
            words = word_hashes(data, ws, we)
            low, whole = anchors(words, rows)
            first = np.searchsorted(rows, np.arange(part.num_rows + 1))
            mine = part.column("anchors")
            sizes = np.diff(np.asarray(mine.offsets))
            known = np.asarray(mine.flatten()).view(np.uint64)
            owner = np.repeat(np.arange(part.num_rows, dtype=np.uint64), sizes)
            have = np.unique(mix(known ^ mix(owner + np.uint64(1))))
            mark = mix(low ^ mix(rows[: len(low)].astype(np.uint64) + np.uint64(1)))
            at = np.flatnonzero(whole & np.isin(mark, have))
            h = phrase_hashes(words, rows, WINDOW)[0][at]
            order = np.lexsort((h, rows[at]))
            at, h = at[order], h[order]
            new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (rows[at][1:] != rows[at][:-1]))) if len(at) else np.zeros(0, np.int64)
            places = (at - first[rows[at]]).astype(np.int32)
            own = pa.array(rows[at[new]])
            yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), part.column(0).take(own), part.column(1).take(own), pa.array(places[new]), pa.array(places[np.append(new[1:], len(at)) - 1] if len(new) else places)], ["window", "doc_id", "t", "low", "high"])

    return candidates.select("doc_id", "t", "text", "anchors").mapInArrow(emitted, f"window bigint, doc_id {id_type(candidates)}, t bigint, low int, high int")


class Passages:
    """The automaton of one first document's passages."""

    def __init__(self, texts: list[str]):
        import ahocorasick

        self.passages = [t.split(" ") for t in texts]
        half = WINDOW // 2
        values: dict[str, list[tuple[int, int]]] = {}
        for p, words in enumerate(self.passages):
            for o in range(0, len(words) - half + 1, half):
                values.setdefault(f" {' '.join(words[o : o + half])} ", []).append((p, o))
        self.automaton = ahocorasick.Automaton()
        for key, places in values.items():
            self.automaton.add_word(key, (len(key), places))
        self.automaton.make_automaton()

    def stretches(self, text: str) -> list[tuple[int, int]]:
        """Disjoint (first word, end) of all that is covered by windows of the passages in a text of words joined by a space."""
        words, half = text.split(" "), WINDOW // 2
        n = len(words)
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])
        covered: list[tuple[int, int]] = []
        done: dict[tuple[int, int], int] = {}
        for end, (size, places) in self.automaton.iter(f" {text} "):
            at = int(np.searchsorted(starts, end - size + 1))
            if covered and covered[-1][0] <= max(0, at - half) and covered[-1][1] >= min(n, at + WINDOW):
                continue
            for p, o in places:
                if covered and covered[-1][0] <= max(0, at - half) and covered[-1][1] >= min(n, at + WINDOW):
                    break  # every window over this piece is: the other places of a repetitive passage add nothing
                if done.get((p, at - o), -1) >= at:
                    continue
                own = self.passages[p]
                a, b = 0, half
                while at - a > 0 and o - a > 0 and words[at - a - 1] == own[o - a - 1]:
                    a += 1
                while at + b < n and o + b < len(own) and words[at + b] == own[o + b]:
                    b += 1
                done[p, at - o] = at + b - 1
                if a + b >= WINDOW:
                    covered = _joined(covered, (at - a, at + b))
        return covered


def _joined(covered: list[tuple[int, int]], new: tuple[int, int]) -> list[tuple[int, int]]:
    out = []
    for c in sorted([*covered, new]):
        if out and c[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], c[1]))
        else:
            out.append(c)
    return out


def repeated_passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the words kept, joined by one space), n_stretches, one row for every row.

    A word goes if a window over it also starts in a row with a smaller doc_id. Null, empty and short texts lose nothing. Rows that share a doc_id don't remove each other's
    words, whether their texts are equal or not; rows without a doc_id lose nothing and remove nothing. Texts of any length are taken whole; extra columns are left out."""
    docs = unclashed(docs, doc_id, text).toDF("doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    docs = docs.withColumn("t", F.xxhash64("text"))  # tells rows of one doc_id apart
    kind = id_type(docs)
    surveyed = written(_surveyed(docs), "survey")
    some = surveyed.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= WINDOW))
    groups = some.groupBy("key1", "key2").agg(F.min("doc_id").alias("first_doc"), F.min_by("t", "doc_id").alias("first_t"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n")).where("first_doc < last_doc").drop("last_doc")
    groups = written(groups, "groups")
    copies = salted_join(some.select("doc_id", "t", "key1", "key2", "n_words"), groups.drop("n"), ["key1", "key2"], "doc_id", counts=groups.select("key1", "key2", "n"))
    copies = written(copies.where("doc_id > first_doc").select("doc_id", "t", "first_doc", "first_t", F.array(F.lit(0), (F.col("n_words") - WINDOW).cast("int")).alias("places")).distinct(), "copies")
    unique = some.join(copies.select("doc_id", "t"), ["doc_id", "t"], "left_anti").select("doc_id", "t", F.explode("anchors").alias("anchor"))
    recurring = written(unique.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).where("a < b").select("anchor", "n"), "anchors")
    marked = salted_join(unique, recurring.select("anchor"), ["anchor"], "doc_id", counts=recurring)
    copied = copies.select("doc_id", "t").unionByName(copies.select(F.col("first_doc").alias("doc_id"), F.col("first_t").alias("t"))).withColumn("anchor", F.lit(None).cast("bigint"))
    keys = marked.unionByName(copied).groupBy("doc_id", "t").agg(F.collect_set("anchor").alias("anchors"))
    candidates = written(docs.join(keys, ["doc_id", "t"]), "candidates")
    windows = _windows(candidates)
    confirmed = written(windows.groupBy("window").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n")).where("first_doc < last_doc").drop("last_doc"), "confirmed")
    owned = salted_join(windows, confirmed.drop("n"), ["window"], "doc_id", counts=confirmed.select("window", "n"))
    own = F.col("doc_id") == F.col("first_doc")
    placed = owned.groupBy("doc_id", "t", "first_doc").agg(F.when(own, F.array_sort(F.collect_set(F.when(own, F.col("low"))))).otherwise(F.array(F.min("low"), F.max("high"))).alias("places")).withColumn("whole", F.lit(False))
    firsts = copies.groupBy("first_doc", "first_t").agg(F.first("places").alias("places")).select(F.col("first_doc").alias("doc_id"), F.col("first_t").alias("t"), "first_doc", "places", F.lit(True).alias("whole"))
    placed = written(placed.unionByName(copies.select("doc_id", "t", "first_doc", "places", F.lit(True).alias("whole"))).unionByName(firsts), "places")
    others = placed.where("doc_id > first_doc")
    shares = others.groupBy("first_doc").agg(F.count("*").alias("n"))
    salted = salted_join(placed, shares.select("first_doc", F.ceil(F.col("n") / SHARE).cast("int").alias("salts")), ["first_doc"], "doc_id", counts=shares).withColumn("salt", F.explode(F.when(own, F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")))))
    cut = salted.join(candidates.select("doc_id", "t", "text"), ["doc_id", "t"]).select("doc_id", "t", "first_doc", "salt", "whole", "places", "text")

    def stretches(batches):
        for batch in batches:
            columns = [batch.column(k) for k in range(6)]
            for i in range(batch.num_rows):
                doc, t, first, salt, whole, places = (c[i].as_py() for c in columns)
                words = plain_words(batch.column(6)[i].as_py().encode()).decode().split(" ")
                if whole or doc != first:
                    runs = [(places[0], places[1])]
                else:
                    p = np.array(places)
                    breaks = np.flatnonzero(np.diff(p) > 1)
                    runs = list(zip(p[np.append(0, breaks + 1)].tolist(), p[np.append(breaks, len(p) - 1)].tolist(), strict=True))
                texts = [" ".join(words[a : b + WINDOW]) for a, b in runs]
                n = len(runs)
                yield pa.RecordBatch.from_arrays([pa.array([first] * n, columns[2].type), pa.array([salt] * n, pa.int32()), pa.array([int(doc != first)] * n, pa.int32()), pa.array([doc] * n, columns[0].type), pa.array([t] * n, pa.int64()), pa.array([a for a, _ in runs], pa.int32()), pa.array(texts)], ["first_doc", "salt", "kind", "doc_id", "t", "place", "stretch"])

    pieces = cut.mapInArrow(stretches, f"first_doc {kind}, salt int, kind int, doc_id {kind}, t bigint, place int, stretch string")
    dealt = pieces.repartition("first_doc", "salt").sortWithinPartitions("first_doc", "salt", "kind", "doc_id")

    def located(batches):
        key, texts, passages = None, [], None
        for batch in batches:
            ids, ts, low, high = [], [], [], []
            for first, salt, which, doc, t, place, stretch in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if (first, salt) != key:
                    key, texts, passages = (first, salt), [], None
                if which == 0:
                    texts.append(stretch)
                    continue
                if passages is None:
                    passages = Passages(texts)
                for a, b in passages.stretches(stretch):
                    ids.append(doc)
                    ts.append(t)
                    low.append(place + a)
                    high.append(place + b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(3).type), pa.array(ts, pa.int64()), pa.array(low, pa.int32()), pa.array(high, pa.int32())], ["doc_id", "t", "low", "high"])

    found = dealt.mapInArrow(located, f"doc_id {kind}, t bigint, low int, high int").groupBy("doc_id", "t").agg(F.collect_set(F.struct("low", "high")).alias("gone"))

    def removed(batches):
        for batch in batches:
            n_removed, shas, count = [], [], []
            for text_, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = plain_words(text_.encode()).split(b" ")
                keep = np.ones(len(words), bool)
                for g in gone:
                    keep[g["low"] : g["high"]] = False
                n_removed.append(int((~keep).sum()))
                count.append(len(gone))
                shas.append(hashlib.sha256(b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_removed, pa.int64()), pa.array(shas), pa.array(count, pa.int64())], ["doc_id", "t", "n", "sha", "stretches"])

    cleaned = candidates.select("doc_id", "t", "text").join(found, ["doc_id", "t"]).mapInArrow(removed, f"doc_id {kind}, t bigint, n bigint, sha string, stretches bigint").dropDuplicates(["doc_id", "t"])
    return surveyed.select("doc_id", "t", "n_words", "whole_sha256").join(cleaned, ["doc_id", "t"], "left").select("doc_id", "n_words", F.coalesce("n", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("sha", "whole_sha256").alias("kept_sha256"), F.coalesce("stretches", F.lit(0)).cast("long").alias("n_stretches"))
