"""Removal of byte strings that stand anywhere else, by suffix arrays of shards.

A window is LENGTH consecutive bytes of one text; it goes if the same bytes also start at another place, in the same text or another one.

Equal windows must meet. A window's anchor is the smallest hash among its phrases of GRAM bytes (the leftmost of equal ones), so equal windows have equal anchors in the same place; windows
side by side share one, and only those whose anchor stands at two places can recur. The bytes of such windows are dealt to shards by their anchor. A shard sorts all suffixes of its pieces:
Larsson and Sadakane's refinement (only groups that are still unsorted are sorted again, by the ranks twice as far on), then Kasai's common prefixes, taken along all pieces at once. Windows
that share LENGTH bytes stand side by side in that order. Equal pieces are sorted once and counted.

An anchor with more than SHARE places lies over several shards. Each hands on its distinct windows as a sorted list (two sums of 64 bits and a place), and the lists of an anchor are merged by
binary search: a window that two shards hold recurs. Lists are dealt by window again, so that what is merged in one task does not grow with the anchor.

Equal texts are one text with a count: all copies go whole, and one of them stands for all in the shards."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_type, salted_join, unclashed, written
from .words import BYTE_VALUES, give_back, mix, phrase_hashes, slices, text_buffers

LENGTH = 400
GRAM = 64
#: Phrases of a window, and windows that share an anchor at most.
SPAN = LENGTH - GRAM + 1
#: Places of an anchor in one shard, bytes that a task sorts at once, windows of a piece at most.
SHARE, SHARD_BYTES, PIECE = 2048, 1 << 20, 8 * SPAN
#: Shards of an anchor for each task that merges their lists.
LISTS = 4
_BLOCK, _PLACE = 1 << 20, np.uint64((1 << 21) - 1)
_OTHER_VALUES = mix(BYTE_VALUES + np.uint64(1))


def anchored(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor, whether it stands at several places) of the stretches of windows with one anchor, in order. Blocks bound what a long text needs."""
    starts, counts, hashes, near, far = ([np.zeros(0, np.int64)] for _ in range(5))
    hashes = [np.zeros(0, np.uint64)]
    ends = np.maximum(offsets[1:] - LENGTH + 1, offsets[:-1])  # windows of a text start before
    for low in range(0, len(data) - LENGTH + 1, _BLOCK):
        block = BYTE_VALUES[data[low : low + _BLOCK + LENGTH - 1]]
        h, _ = phrase_hashes(block, np.zeros(len(block), np.int8), GRAM)
        best = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        n, span = len(block) - LENGTH + 1, 1
        while 2 * span <= SPAN:
            best = np.minimum(best[:-span], best[span:])
            span *= 2
        at = (np.minimum(best[:n], best[SPAN - span : SPAN - span + n]) & _PLACE).astype(np.int64)
        own = h[at]
        inside = np.zeros(n + 1, np.int32)
        np.add.at(inside, np.clip(offsets[:-1] - low, 0, n), 1)
        np.add.at(inside, np.clip(ends - low, 0, n), -1)
        inside = np.cumsum(inside[:n]) > 0
        first = inside.copy()
        first[1:] &= ~inside[:-1] | (own[1:] != own[:-1])
        last = inside.copy()
        last[:-1] &= ~inside[1:] | (own[1:] != own[:-1])
        s, e = np.flatnonzero(first), np.flatnonzero(last)
        starts.append(s + low)
        counts.append(e - s + 1)
        hashes.append(own[s])
        near.append(at[s] + low)
        far.append(at[e] + low)
    start, count, h, a, b = (np.concatenate(v) for v in (starts, counts, hashes, near, far))
    if len(start) > 1:  # a stretch may go on in the next block
        new = np.append(True, (start[1:] != start[:-1] + count[:-1]) | (h[1:] != h[:-1]))
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(start)) - 1
        start, count, h, a, b = start[at], start[end] + count[end] - start[at], h[at], a[at], b[end]
    return start, count, h, a != b


def suffix_array(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, rank, quads) of the suffixes of x, whose values are below 65,536 and whose last value is unique; quads are four values each."""
    n = len(x)
    y = np.concatenate([x.astype(np.uint64), np.zeros(3, np.uint64)])
    quads = (y[:n] << np.uint64(48)) | (y[1 : n + 1] << np.uint64(32)) | (y[2 : n + 2] << np.uint64(16)) | y[3 : n + 3]
    order = np.argsort(quads)
    key, at, h = quads[order], np.arange(n), 4
    rank = np.empty(n, np.int64)
    while True:
        new = np.append(True, key[1:] != key[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        rank[order[at]] = np.repeat(at[first], size)  # a group's rank is the place of its first suffix
        at = at[np.repeat(size > 1, size)]
        if not len(at):
            return order, rank, quads
        i = order[at]
        key = rank[i] * n + rank[i + h]
        sub = np.argsort(key)
        order[at], key, h = i[sub], key[sub], 2 * h


def common_prefixes(order: np.ndarray, rank: np.ndarray, quads: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """By rank: how far a suffix agrees with the one before it, for the first counts suffixes of each piece (0 for others). A suffix agrees with its neighbour at least as far as the one that
    starts a value earlier, less one; all pieces take their next suffix at once."""
    out = np.zeros(len(order), np.int64)
    padded = np.append(quads, np.zeros(4, np.uint64))
    by = np.argsort(-counts, kind="stable")
    starts, counts = starts[by], counts[by]
    h = np.zeros(len(starts), np.int64)
    for t in range(int(counts.max(initial=0))):
        m = int(np.searchsorted(-counts, -t, "left"))  # pieces with more than t
        i = starts[:m] + t
        r = rank[i]
        on = np.flatnonzero(r > 0)
        h = np.maximum(h[:m] - 1, 0)
        h[r == 0] = 0
        j = order[r - 1]
        while len(on):
            a, b = padded[i[on] + h[on]], padded[j[on] + h[on]]
            same = a == b
            rest = on[~same]
            if len(rest):
                differ = a[~same] ^ b[~same]
                h[rest] += (differ < np.uint64(1 << 48)).astype(np.int64) + (differ < np.uint64(1 << 32)) + (differ < np.uint64(1 << 16))
            on = on[same]
            h[on] += 4
        out[r] = h
    return out


def repeated(pieces: list[bytes], weights: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, piece, class, recurs) of all windows of distinct pieces, by class: a class is one string of `length` bytes, and recurs if it stands at two places; pieces stand weights times."""
    sizes = np.array([len(p) for p in pieces])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    x = np.empty(int((sizes + 1).sum()), np.uint16)
    own = np.repeat(np.arange(len(pieces)), sizes + 1)
    x[starts + sizes] = 256 + np.arange(len(pieces))  # no two ends are equal, so no suffixes agree beyond a piece
    text = np.ones(len(x), bool)
    text[starts + sizes] = False
    x[text] = np.frombuffer(b"".join(pieces), np.uint8)
    order, rank, quads = suffix_array(x)
    prefixes = common_prefixes(order, rank, quads, starts, sizes - length + 1)
    at = order - starts[own[order]]
    windows = np.flatnonzero(at + length <= sizes[own[order]])
    cls = np.cumsum(prefixes[windows] < length) - 1
    total = np.bincount(cls, weights[own[order[windows]]])
    return at[windows], own[order[windows]], cls, total[cls] > 1


#: A shard's distinct windows of an anchor, as a sorted list.
_WINDOWS = "array<struct<h1:bigint,h2:bigint,u:binary,low:bigint,recurs:boolean>>"
_FOUND = f"kind int, u binary, low bigint, high bigint, g bigint, part int, salt int, windows {_WINDOWS}"
_FOUND_TYPES = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("u", pa.binary()), ("low", pa.int64()), ("recurs", pa.bool_())]))]
_FOUND_NAMES = ["kind", "u", "low", "high", "g", "part", "salt", "windows"]


def _settled(g, salt, salts, u, start, pieces) -> pa.RecordBatch:
    """The rows of one buffer of pieces: kind 0, stretches of bytes that go; kind 1, the lists of distinct windows of anchors that other shards hold too."""
    known: dict[tuple[int, bytes], int] = {}
    which = np.array([known.setdefault((k, p), len(known)) for k, p in zip(salt, pieces, strict=True)])
    distinct = [p for _, p in known]
    place, piece, cls, recurs = repeated(distinct, np.bincount(which)) if len({s for s, _ in known}) == 1 else _by_salt(known, which)
    sizes = np.array([len(p) - LENGTH + 1 for p in distinct])
    base = np.concatenate([[0], np.cumsum(sizes + 1)])
    mark = np.zeros(base[-1] + 1, np.int8)  # a gap behind each piece
    mark[base[piece] + place] = recurs
    step = np.diff(np.concatenate([[0], mark, [0]]))
    low, high = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    first = np.searchsorted(low, base[:-1])
    n = np.searchsorted(low, base[1:]) - first
    mine = np.repeat(np.arange(len(which)), n[which])
    at = first[which][np.repeat(np.arange(len(which)), n[which])] + (np.arange(len(mine)) - np.repeat(np.cumsum(n[which]) - n[which], n[which]))
    start = np.array(start, np.int64)
    offset = start[mine] - base[which[mine]]
    columns = [[0] * len(mine), [u[i] for i in mine.tolist()], (low[at] + offset).tolist(), (high[at] - 1 + LENGTH + offset).tolist(), *[[None] * len(mine)] * 4]
    member = np.empty(len(distinct), np.int64)
    member[which[::-1]] = np.arange(len(which))[::-1]  # its first place
    split = np.array([salts[m] > 1 for m in member.tolist()])
    once = np.flatnonzero(np.append(True, cls[1:] != cls[:-1]) & split[piece]) if len(cls) else np.zeros(0, np.int64)
    if len(once):
        sums = [np.concatenate([phrase_hashes(values[np.frombuffer(distinct[p], np.uint8)], np.zeros(len(distinct[p]), np.int8), LENGTH)[0] if split[p] else np.zeros(sizes[p], np.uint64) for p in range(len(distinct))]).view(np.int64) for values in (BYTE_VALUES, _OTHER_VALUES)]
        spot = np.concatenate([[0], np.cumsum(sizes)])[piece[once]] + place[once]
        owner = member[piece[once]]
        h1, h2, key, shard = sums[0][spot], sums[1][spot], np.array(g)[owner], np.array(salt)[owner]
        part = h1 % -(-np.array(salts)[owner] // LISTS)
        order = np.lexsort((h2, h1, shard, part, key))
        cuts = np.flatnonzero(np.append(True, (np.diff(key[order]) != 0) | (np.diff(part[order]) != 0) | (np.diff(shard[order]) != 0)))
        heads, ends = order[cuts], np.append(cuts, len(order)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(h1[order]), pa.array(h2[order]), pa.array([u[i] for i in owner[order].tolist()], pa.binary()), pa.array((start[owner] + place[once])[order]), pa.array(recurs[once][order])], ["h1", "h2", "u", "low", "recurs"]))
        n = len(heads)
        columns = [[*a, *b] for a, b in zip(columns, [[1] * n, *[[None] * n] * 3, key[heads].tolist(), part[heads].tolist(), shard[heads].tolist()], strict=False)]
        held = pa.concat_arrays([pa.nulls(len(mine), _FOUND_TYPES[-1]), lists.cast(_FOUND_TYPES[-1])])
    else:
        columns, held = columns[:7], pa.nulls(len(mine), _FOUND_TYPES[-1])
    return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, _FOUND_TYPES, strict=False)), held], _FOUND_NAMES)


def _by_salt(known: dict[tuple[int, bytes], int], which: np.ndarray):
    """repeated() shard by shard where a buffer holds several shards of one anchor, which must not know of each other: their windows meet in the merge."""
    weights = np.bincount(which)
    parts, shift = [], 0
    for s in sorted({s for s, _ in known}):
        mine = [i for (k, _), i in known.items() if k == s]
        place, piece, cls, recurs = repeated([p for (k, p), _ in known.items() if k == s], weights[mine])
        parts.append((place, np.array(mine)[piece], cls + shift, recurs))
        shift += int(cls.max(initial=-1)) + 1
    return tuple(np.concatenate(v) for v in zip(*parts, strict=True))


def merged(shards: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For each shard's windows (h1 rising, h2), whether another shard holds them too."""
    out = [np.zeros(len(h), bool) for h, _ in shards]
    key = np.zeros(0, [("h1", np.int64), ("h2", np.int64)])
    owner = np.zeros((0, 2), np.int64)
    for s, (h1, h2) in enumerate(shards):
        new = np.zeros(len(h1), key.dtype)
        new["h1"], new["h2"] = h1, h2
        order = np.lexsort((h2, h1))
        new = new[order]
        low, high = np.searchsorted(key["h1"], new["h1"], "left"), np.searchsorted(key["h1"], new["h1"], "right")
        seen = np.zeros(len(new), bool)
        for shift in range(int((high - low).max(initial=0))):  # windows that share h1: hardly ever more than one
            at = low + shift
            on = np.flatnonzero(at < high)
            on = on[key["h2"][at[on]] == new["h2"][on]]
            seen[on] = True
            for a, b in np.unique(owner[at[on]], axis=0).tolist():
                out[a][b] = True
        out[s][order[seen]] = True
        fresh = np.flatnonzero(~seen)
        key = np.concatenate([key, new[fresh]])
        owner = np.concatenate([owner, np.stack([np.full(len(fresh), s), order[fresh]], 1)])
        by = np.lexsort((key["h2"], key["h1"]))
        key, owner = key[by], owner[by]
    return out


def _surveyed(docs: DataFrame) -> DataFrame:
    """doc_id, sha (of the text), n_bytes, anchors; an anchor is listed once for every SPAN windows, and twice at least if it stands at several places."""

    def run(batches):
        for part, data, offsets in slices(batches):
            start, count, h, several = anchored(data, offsets)
            times = np.maximum(1 + several, -(-count // SPAN))
            row = np.searchsorted(offsets, start, "right") - 1
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, times, part.num_rows).astype(np.int64))])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.repeat(h, times).view(np.int64)))
            raw = memoryview(np.ascontiguousarray(data))
            shas = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shas, pa.string()), pa.array(np.diff(offsets)), lists], ["doc_id", "sha", "n_bytes", "anchors"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs)}, sha string, n_bytes bigint, anchors array<bigint>")


def _pieces(candidates: DataFrame) -> DataFrame:
    """g, salt, salts, u, start, piece: the bytes of the windows whose anchor stands at two places."""

    def run(batches):
        for part, data, offsets in slices(batches):
            start, count, h, _ = anchored(data, offsets)
            row = np.searchsorted(offsets, start, "right") - 1
            lists = part.column("marks")
            sizes = np.diff(np.asarray(lists.offsets))
            flat = lists.flatten()
            known, many = np.asarray(flat.field("g")).view(np.uint64), np.asarray(flat.field("salts"))
            mark = mix(known ^ mix(np.repeat(np.arange(part.num_rows, dtype=np.uint64), sizes) + np.uint64(1)))
            order = np.argsort(mark)
            mine = mix(h ^ mix(row.astype(np.uint64) + np.uint64(1)))
            at = np.minimum(np.searchsorted(mark[order], mine), max(len(mark) - 1, 0))
            on = np.flatnonzero(mark[order][at] == mine) if len(mark) else np.zeros(0, np.int64)
            cuts = -(-count[on] // PIECE)
            of = np.repeat(on, cuts)
            first = (np.arange(len(of)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * PIECE
            n = np.minimum(PIECE, count[of] - first)
            low = start[of] + first
            salts = many[order][at[of]]
            place = low - offsets[row[of]]
            salt = (mix(place.astype(np.uint64) ^ mix(h[of] + row[of].astype(np.uint64))) % salts.astype(np.uint64)).astype(np.int32)
            raw = data.tobytes()
            for x in range(0, len(of), 2000):
                y = slice(x, x + 2000)
                yield pa.RecordBatch.from_arrays([pa.array(h[of[y]].view(np.int64)), pa.array(salt[y]), pa.array(salts[y].astype(np.int32)), part.column("u").take(pa.array(row[of[y]])), pa.array(place[y]), pa.array([raw[a:b] for a, b in zip(low[y].tolist(), (low + n + LENGTH - 1)[y].tolist(), strict=True)], pa.binary())], ["g", "salt", "salts", "u", "start", "piece"])

    return candidates.select("u", "marks", "text").mapInArrow(run, "g bigint, salt int, salts int, u binary, start bigint, piece binary")


def _located(batches):
    """Pieces in order of (g, salt): buffers of whole shards of about SHARD_BYTES are sorted."""
    held: list[list] = [[] for _ in range(6)]
    size, last = 0, None
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(6)]
        for row in zip(*columns, strict=True):
            if size >= SHARD_BYTES and (row[0], row[1]) != last:
                yield _settled(held[0], held[1], held[2], held[3], held[4], held[5])
                held, size = [[] for _ in range(6)], 0
            last = (row[0], row[1])
            for h, v in zip(held, row, strict=True):
                h.append(v)
            size += len(row[5])
    if held[0]:
        yield _settled(held[0], held[1], held[2], held[3], held[4], held[5])
    give_back()


def _across(batches):
    """Lists in order of (g, part, salt) to the windows that were alone in their shard and stand in another: u, low, high."""
    key, lists = None, []

    def done():
        flat = [x.flatten() for x in lists]
        met = np.concatenate(merged([(np.asarray(f.field("h1")), np.asarray(f.field("h2"))) for f in flat]))
        alone = ~np.concatenate([np.asarray(f.field("recurs")) for f in flat])
        on = pa.array(np.flatnonzero(met & alone))
        low = pa.concat_arrays([f.field("low") for f in flat]).take(on)
        return pa.RecordBatch.from_arrays([pa.concat_arrays([f.field("u") for f in flat]).take(on), low, pa.array(np.asarray(low) + LENGTH)], ["u", "low", "high"])

    for batch in batches:
        for i, now in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if lists and now != key:
                yield done()
                lists = []
            key = now
            lists.append(batch.column(3).slice(i, 1))
    if lists:
        yield done()
    give_back()


def _cleaned(batches):
    """u, n_removed, n_spans, kept_sha256 of texts (u, gone, text)."""
    for batch in batches:
        offsets, data = text_buffers(batch.column(2))
        raw = memoryview(np.ascontiguousarray(data))
        lists = batch.column(1)
        bounds = np.asarray(lists.offsets)
        flat = lists.flatten()
        base = bounds[0]
        low, high = np.asarray(flat.field("low")), np.asarray(flat.field("high"))
        n_removed, n_spans, shas = [], [], []
        for i in range(batch.num_rows):
            a, b = low[bounds[i] - base : bounds[i + 1] - base], high[bounds[i] - base : bounds[i + 1] - base]
            by = np.argsort(a)
            a, b = a[by], np.maximum.accumulate(b[by])
            new = np.append(True, a[1:] > b[:-1])
            first = np.flatnonzero(new)
            a, b = a[first], b[np.append(first[1:], len(b)) - 1]
            own = raw[offsets[i] : offsets[i + 1]]
            kept, at = hashlib.sha256(), 0
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                kept.update(own[at:x])
                at = y
            kept.update(own[at:])
            n_removed.append(int((b - a).sum()))
            n_spans.append(len(a))
            shas.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(shas, pa.string())], ["u", "n_removed", "n_spans", "kept_sha256"])
    give_back()


def repeated_bytes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (stretches that go), kept_sha256 (of what is left), one row for every row.

    A byte goes if a string of LENGTH bytes over it also starts elsewhere: in another row, whatever its doc_id, or in the same one. Rows with equal texts of LENGTH bytes and more go whole, repeated
    rows and rows without doc_id included. Null and empty texts have no bytes, shorter texts lose nothing; texts of any length are taken whole; extra columns are left out."""
    docs = unclashed(docs, doc_id, text).toDF("doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    surveyed = written(_surveyed(docs), "survey")
    texts = surveyed.where(F.col("n_bytes") >= LENGTH).groupBy("sha").agg(F.count("*").alias("n"), F.min("doc_id").alias("owner"), F.first("anchors").alias("anchors"))
    texts = written(texts, "texts")
    each = texts.select("sha", "owner", F.explode("anchors").alias("g"))
    recurring = written(each.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    marks = salted_join(each.distinct(), recurring.select("g", F.ceil(F.col("n") / SHARE).cast("int").alias("salts")), ["g"], "sha", counts=recurring)
    marks = marks.groupBy("sha", "owner").agg(F.collect_list(F.struct("g", "salts")).alias("marks"))
    keyed = marks.select(F.col("sha").alias("_sha"), F.col("owner").alias("_owner"), F.unhex(F.substring("sha", 1, 32)).alias("u"), "marks")
    candidates = docs.join(keyed, (F.sha2("text", 256) == F.col("_sha")) & F.col("doc_id").eqNullSafe(F.col("_owner"))).select("u", "marks", "text")
    candidates = written(candidates, "candidates")
    dealt = _pieces(candidates).repartition("g", "salt").sortWithinPartitions("g", "salt")
    found = written(dealt.mapInArrow(_located, _FOUND), "found")
    gone = found.where("kind = 0").select("u", "low", "high")
    if recurring.where(F.col("n") > SHARE).limit(1).count():
        lists = found.where("kind = 1").select("g", "part", "salt", "windows")
        gone = gone.unionByName(lists.repartition("g", "part").sortWithinPartitions("g", "part", "salt").mapInArrow(_across, "u binary, low bigint, high bigint"))
    gone = gone.groupBy("u").agg(F.collect_list(F.struct("low", "high")).alias("gone"))
    cleaned = candidates.select("u", "text").join(gone, "u").select("u", "gone", "text").mapInArrow(_cleaned, "u binary, n_removed bigint, n_spans bigint, kept_sha256 string")
    copied = texts.where("n > 1").select("sha", "n")
    rows = written(salted_join(surveyed.select("doc_id", "sha", "n_bytes"), copied.withColumnRenamed("n", "copies"), ["sha"], "doc_id", "left", copied), "rows")
    empty = hashlib.sha256(b"").hexdigest()
    whole = rows.where("copies is not null").select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(empty).alias("kept_sha256"))
    rest = rows.where("copies is null").withColumn("u", F.unhex(F.substring("sha", 1, 32))).join(cleaned.dropDuplicates(["u"]), "u", "left")
    return whole.unionByName(rest.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")))
