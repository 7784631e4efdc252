"""Stretches of words that repeat with a period, found in a grammar of the text instead of the text itself.

Re-Pair replaces the commonest pair of neighbouring symbols by a new one until no pair recurs. A stretch that lies over the border of a symbol's two halves is the same wherever the symbol
stands, so it is looked for once for each symbol, and once for each border of what is left at the top (halved again and again), and its places are carried to all derivations of the
symbol. Every run has a lowest symbol that holds it whole and whose border it crosses; what a symbol shows of a run that goes on outside of it lies inside the run that is found higher up,
so the longest interval of each period stays.

At a border, a run of four periods has two on one side: the words on that side begin (or end) with the same word sequence twice, which sums of word values tell for all periods at once.

Most texts hold no run. A run of period q repeats each of its phrases of PHRASE words after q words at most, so only stretches whose phrases all come again that soon are turned into
grammars; this leaves out nothing. A document's words are in one task."""

from __future__ import annotations

import hashlib
import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_type, unclashed
from .substring_dedup import plain_words
from .words import find_words, give_back, mix, phrase_hashes, powers, slices, word_hashes

POWER, LEAST = 4, 6
PHRASE = 4
_BASE = 0xD6E8FEB86659FD93


def grammar(ids: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
    """(rules, top): Re-Pair over symbols 0..k-1. Rule i stands for symbol k + i, k the number of distinct ids; ids must be 0..k-1."""
    n, k = len(ids), max(ids, default=-1) + 1
    symbol, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], set[int]] = {}
    for i in range(n - 1):
        places.setdefault((symbol[i], symbol[i + 1]), set()).add(i)
    heap = [(-len(v), p) for p, v in places.items() if len(v) > 1]
    heapq.heapify(heap)
    rules: list[tuple[int, int]] = []
    while heap:
        count, pair = heapq.heappop(heap)
        found = places.get(pair)
        if found is None or len(found) < 2:
            continue
        if len(found) != -count:
            heapq.heappush(heap, (-len(found), pair))
            continue
        del places[pair]
        a, b = pair
        new, fresh = k + len(rules), set()
        taken = 0
        for i in sorted(found):
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:  # its half went into the pair before, as in a a a
                continue
            left, right = before[i], after[j]
            if left >= 0:
                old = places.get((symbol[left], a))
                if old is not None:
                    old.discard(left)
                places.setdefault((symbol[left], new), set()).add(left)
                fresh.add((symbol[left], new))
            if right < n:
                old = places.get((b, symbol[right]))
                if old is not None:
                    old.discard(j)
                places.setdefault((new, symbol[right]), set()).add(i)
                fresh.add((new, symbol[right]))
                before[right] = i
            symbol[i], symbol[j], after[i] = new, -1, right
            taken += 1
        if taken:
            rules.append(pair)
        for p in fresh:
            if len(places.get(p, ())) > 1:
                heapq.heappush(heap, (-len(places[p]), p))
    top, i = [], 0
    while i < n:
        top.append(symbol[i])
        i = after[i]
    return rules, top


def _agreeing(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two arrays have in common from the start."""
    n, done, step = min(len(x), len(y)), 0, 32
    while done < n:
        differ = np.flatnonzero(x[done : done + step][: n - done] != y[done : done + step][: n - done])
        if len(differ):
            return done + int(differ[0])
        done, step = done + step, 4 * step
    return n


def crossing(words: np.ndarray, sums: np.ndarray, low: int, border: int, high: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs in words[low:high] that lie over the border. sums: running sums of the words' values times powers of _BASE."""
    if high - low < LEAST:
        return []
    found: set[tuple[int, int, int]] = set()

    def twice(first: np.ndarray, second: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether q words from each place first are those q words later, by their sums."""
        return (sums[second] - sums[first]) * powers(_BASE, len(q) + 1)[q] == sums[second + q] - sums[second]

    for right in (True, False):
        q = np.arange(1, ((high - border) if right else (border - low)) // 2 + 1)
        if not len(q):
            continue
        first = np.full(len(q), border) if right else border - 2 * q
        reach = 0  # words on this side that a smaller period explains
        for p in q[twice(first, first + q, q)].tolist():
            if 2 * p <= reach:
                continue
            end = border + _agreeing(words[border:high], words[border + p : high]) + p if right else border + _agreeing(words[border - p : high - p], words[border:high])
            start = border - _agreeing(words[low:border][::-1], words[low + p : border + p][::-1]) if right else border - p - _agreeing(words[low : border - p][::-1], words[low + p : border][::-1])
            side = end - border if right else border - start
            if side < 2 * p or side <= reach:
                continue
            reach = side
            if start < border < end and end - start >= max(LEAST, POWER * p):
                found.add((start, end, p))
    return list(found)


def _longest(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of intervals (start, end, period), those that none of the same period contains."""
    out: list[tuple[int, int, int]] = []
    for start, end, q in sorted(set(found), key=lambda r: (r[2], r[0], -r[1])):
        if not (out and out[-1][2] == q and out[-1][1] >= end):
            out.append((start, end, q))
    return sorted(out)


def runs_of(ids: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of the symbols, by start: smallest period q, at least max(LEAST, POWER * q) long, longer on no side."""
    n, k = len(ids), max(ids, default=-1) + 1
    if n < LEAST:
        return []
    rules, top = grammar(ids)
    size = [1] * k
    for a, b in rules:
        size.append(size[a] + size[b])
    place: dict[int, int] = {}  # one derivation of each symbol
    ends = np.concatenate([[0], np.cumsum([size[s] for s in top])]).tolist()
    for s, at in zip(top, ends, strict=False):
        place.setdefault(s, at)
    for i in range(len(rules) - 1, -1, -1):
        if k + i in place:
            a, b = rules[i]
            place.setdefault(a, place[k + i])
            place.setdefault(b, place[k + i] + size[a])
    words = np.array(ids, np.int64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n))])
    own: dict[int, list[tuple[int, int, int]]] = {}
    holds = [False] * (k + len(rules))
    for i, (a, b) in enumerate(rules):
        s = k + i
        at = place[s]
        found = crossing(words, sums, at, at + size[a], at + size[s])
        if found:
            own[s] = [(x - at, y - at, q) for x, y, q in found]
        holds[s] = bool(found) or holds[a] or holds[b]
    out: list[tuple[int, int, int]] = []
    todo = [(s, at) for s, at in zip(top, ends, strict=False) if holds[s]]
    while todo:
        s, at = todo.pop()
        out += [(at + x, at + y, q) for x, y, q in own.get(s, ())]
        a, b = rules[s - k]
        if holds[a]:
            todo.append((a, at))
        if holds[b]:
            todo.append((b, at + size[a]))
    halves = [(0, len(top))]
    while halves:
        x, y = halves.pop()
        if y - x > 1 and ends[y] - ends[x] >= LEAST:
            middle = (x + y) // 2
            out += crossing(words, sums, ends[x], ends[middle], ends[y])
            halves += [(x, middle), (middle, y)]
    return _longest(out)


def stretches(words: np.ndarray, rows: np.ndarray) -> list[tuple[int, int]]:
    """(start, end), disjoint and rising, of the words of each row outside of which no run lies."""
    phrases, whole = phrase_hashes(words, rows, PHRASE)
    n = len(phrases)
    if not n:
        return []
    key = mix(phrases ^ mix(rows[:n].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    again = np.full(n, 1 << 60, np.int64)
    same = key[order[1:]] == key[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    again[~whole] = 1 << 60
    found = []
    near = np.flatnonzero(again < 1 << 60)
    reach = int(again[near].max(initial=0))
    span = 1
    while span // 2 < reach:
        least = LEAST - PHRASE if span == 1 else (POWER - 1) * (span // 2 + 1) - PHRASE + 1
        at = near[again[near] <= span]
        if len(at) >= least:
            cut = np.flatnonzero(np.diff(at) > 1)
            starts, ends = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)] + 1
            long = ends - starts >= least
            found += zip(starts[long].tolist(), (ends[long] + span + PHRASE - 1).tolist(), strict=True)
        span *= 2
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        b = min(b, int(np.searchsorted(rows, rows[a], "right")))
        if out and a <= out[-1][1] and rows[out[-1][0]] == rows[a]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeating(n: int, h: int) -> np.ndarray:
    """For each of n words the word that stands there: its own, or from word g % n on the first 1 + (n - a) // (3 + g % 8) words again and again, in every tenth document by h."""
    g, at = h // 10, np.arange(n)
    if h % 10 or not n:
        return at
    a = g % n
    at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


_COLUMNS = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string, n_words bigint, n_dropped bigint"


def periodic_runs(docs: DataFrame, planted: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli (of the longest run; ties: smallest start, then period; null without), runs_sha256 (all runs), collapsed_sha256 (the words left when
    each run keeps its first period), n_words, n_dropped; one row for every row, repeated rows and rows without doc_id included.

    planted: every tenth document by its doc_id's checksum gets a repeating end first (none without a doc_id). Null, empty and short texts have no runs; texts of any length are
    taken whole; extra columns are left out. Words are told apart by their bytes."""
    docs = unclashed(docs, doc_id, text).toDF("doc_id", "text")
    kind = id_type(docs)

    def run(batches):
        for part, data, offsets in slices(batches):
            ws, we, rows = find_words(data, offsets)
            words = word_hashes(data, ws, we)
            first = np.searchsorted(rows, np.arange(part.num_rows + 1))
            at = np.arange(len(ws))
            if planted:
                for r, own in enumerate(part.column(0).to_pylist()):
                    if own is not None and zlib.crc32(str(own).encode()) % 10 == 0:
                        at[first[r] : first[r + 1]] = first[r] + repeating(int(first[r + 1] - first[r]), zlib.crc32(str(own).encode()))
            raw = data.tobytes()
            runs: list[list[tuple[int, int, int]]] = [[] for _ in range(part.num_rows)]
            for a, b in stretches(words[at], rows):
                known: dict[bytes, int] = {}
                ids = [known.setdefault(raw[ws[i] : we[i]], len(known)) for i in at[a:b].tolist()]
                r = int(rows[a])
                runs[r] += [(a + x - int(first[r]), a + y - int(first[r]), q) for x, y, q in runs_of(ids)]
            out: list[list] = [[] for _ in range(9)]
            for r in range(part.num_rows):
                low, n = int(first[r]), int(first[r + 1] - first[r])
                found = sorted(runs[r])
                keep = np.ones(n, bool)
                for x, y, q in found:
                    keep[x + q : y] = False
                best = min(found, key=lambda v: (v[0] - v[1], v[0], v[2]), default=None)
                row = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
                left = at[low : low + n][keep]
                as_is = not found and (at[low : low + n] == np.arange(low, low + n)).all()
                listed = "".join(f"{x},{y - x},{q}\n" for x, y, q in sorted(found, key=lambda v: (v[0], v[2])))
                kept = plain_words(raw[offsets[r] : offsets[r + 1]]) if as_is else b" ".join([raw[x:y] for x, y in zip(ws[left].tolist(), we[left].tolist(), strict=True)])
                for column, v in zip(out, (len(found), *row, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), n, n - len(left)), strict=True):
                    column.append(v)
            types = [pa.string() if i in (5, 6) else pa.int64() for i in range(9)]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], ["doc_id", *(c.split(" ")[0] for c in _COLUMNS.split(", "))])
        give_back()

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, {_COLUMNS}")
