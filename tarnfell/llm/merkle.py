"""A hash tree over a dataset whose nodes keep the states of their hash, so that a changed row is folded up to the root without hashing what stands left of it.

A leaf is the hash of a row's columns; the leaves of a group (a source) in order of their key are hashed in runs of ARITY into parents, those again, until one node is left, and the groups'
last nodes in the same way into the root. A child enters its parent's hash as 64 hex digits, which is one block of SHA-256: the state before a child's slot is therefore eight words after
a whole number of blocks. A parent keeps a copy of that state for each slot. Folding resumes the state of the slot with the replacement and hashes the right siblings only. States are plain
bytes in a table, so they are computed for many nodes at once and go with the rows to whatever task folds.

The tree is built by level: a task sees runs of ARITY nodes, never a group. Going down, a run gets the path of its parent (slot, state, siblings of each level), so that all leaves of a run
share one path and no leaf is joined to its ancestors one by one."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import ranked
from .shared import id_type, unclashed, written
from .words import give_back

ARITY = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _cube_root(x: int) -> int:
    low, high = 0, 1 << (x.bit_length() // 3 + 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid**3 <= x else (low, mid - 1)
    return low


#: SHA-256 (FIPS 180-4): fractional bits of the square roots and cube roots of the first primes.
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
_ROUNDS = [np.uint32(_cube_root(p << 96) & 0xFFFFFFFF) for p in _primes(64)]
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """One block (16, n) of big-endian words into the states (8, n) of n hashes."""
    w = list(block)
    for i in range(16, 64):
        x, y = w[i - 15], w[i - 2]
        w.append(w[i - 16] + (_turned(x, 7) ^ _turned(x, 18) ^ (x >> np.uint32(3))) + w[i - 7] + (_turned(y, 17) ^ _turned(y, 19) ^ (y >> np.uint32(10))))
    a, b, c, d, e, f, g, h = state
    for i in range(64):
        up = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + ((e & f) ^ (~e & g)) + _ROUNDS[i] + w[i]
        a, b, c, d, e, f, g, h = up + (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + ((a & b) ^ (a & c) ^ (b & c)), a, b, c, d + up, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def _block(digests: np.ndarray) -> np.ndarray:
    """(n, 32) bytes as their hex text: one block each, (16, n) words."""
    text = np.empty((len(digests), 64), np.uint8)
    text[:, 0::2], text[:, 1::2] = _HEX[digests >> 4], _HEX[digests & 15]
    return np.ascontiguousarray(text.view(">u4").astype(np.uint32).T)


def _closed(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """(n, 32): the digests of hashes that took so many whole blocks."""
    last = np.zeros((16, len(blocks)), np.uint32)
    last[0] = 0x80000000
    bits = blocks.astype(np.uint64) * np.uint64(512)
    last[14], last[15] = (bits >> np.uint64(32)).astype(np.uint32), bits.astype(np.uint32)
    return np.ascontiguousarray(compress(state, last).T.astype(">u4")).view(np.uint8)


def _resumed(state: np.ndarray, children: np.ndarray, count: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(n, 32) digests: states (8, n) before slot `first` take the children (n, arity, 32) from there to count."""
    state = state.copy()
    for slot in range(int(first.min(initial=0)), int(count.max(initial=0))):
        on = np.flatnonzero((first <= slot) & (slot < count))
        if len(on):
            state[:, on] = compress(state[:, on], _block(children[on, slot]))
    return _closed(state, count)


def hashed(children: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(digests, states): hashes of runs of children (n, arity, 32), and the copies of each hash's state before each slot, (n, arity, 8)."""
    n, arity, _ = children.shape
    state = np.repeat(START[:, None], n, 1)
    kept = np.zeros((n, arity, 8), np.uint32)
    for slot in range(int(count.max(initial=0))):
        kept[:, slot] = state.T
        on = np.flatnonzero(slot < count)
        state[:, on] = compress(state[:, on], _block(children[on, slot]))
    return _closed(state, count), kept


def _padded(texts: list[bytes], arity: int) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated digests as (n, arity, 32), and how many each has."""
    count = np.array([len(t) // 32 for t in texts], np.int64)
    out = np.zeros((len(texts), arity, 32), np.uint8)
    out[np.arange(arity)[None, :] < count[:, None]] = np.frombuffer(b"".join(texts), np.uint8).reshape(-1, 32)
    return out, count


def leaf_hash(columns: dict[str, Column]) -> Column:
    """32 bytes: the hash of the values in their order, each as `-` if null, else its UTF-8 length, a colon, and itself."""
    part = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")))
    return F.unhex(F.sha2(F.concat(*[part(c) for c in columns.values()]).cast("binary"), 256))


@dataclass
class Tree:
    """runs: the runs of leaves with the steps above them; levels: the tables of each group's nodes; root: hex, null for an empty dataset."""

    runs: DataFrame
    levels: list[DataFrame]
    root: str | None


def _hash_runs(runs: DataFrame, arity: int, name: str) -> DataFrame:
    """k, place, lone, digest, states, kids of runs (k, place, children array<binary>). A run that is its level's only node and has one child is that child's end: lone, with its digest."""

    def run(batches):
        for b in batches:
            lists = b.column(2)
            sizes = np.diff(np.asarray(lists.offsets))
            flat = np.frombuffer(b"".join(lists.flatten().to_pylist()), np.uint8).reshape(-1, 32)
            ends = np.cumsum(sizes)
            kids = [flat[e - s : e].tobytes() for s, e in zip(sizes, ends, strict=True)]
            children, count = _padded(kids, arity)
            lone = (np.asarray(b.column(1)) == 0) & (count == 1)
            digests, states = hashed(children, count)
            digests[lone] = children[lone, 0]
            kept = [states[i, : count[i]].tobytes() for i in range(len(kids))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lone), pa.array([d.tobytes() for d in digests], pa.binary()), pa.array(kept, pa.binary()), pa.array(kids, pa.binary())], ["k", "place", "lone", "digest", "states", "kids"])
        give_back()

    return written(runs.select("k", "place", "children").mapInArrow(run, "k string, place bigint, lone boolean, digest binary, states binary, kids binary"), name)


def _upward(first: DataFrame, arity: int, name: str) -> list[DataFrame]:
    """All levels above runs (k, place, children); the last has only lone nodes. One number a level reaches the driver."""
    levels = [_hash_runs(first, arity, name)]
    while levels[-1].where("not lone").limit(1).count():
        nodes = levels[-1].where("not lone").select("k", F.expr(f"place div {arity}").alias("run"), "place", "digest")
        runs = nodes.groupBy("k", "run").agg(F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("m")).select("k", F.col("run").alias("place"), F.col("m.digest").alias("children"))
        levels.append(_hash_runs(runs, arity, name))
    return levels


_STEPS = "array<struct<slot:int,state:binary,kids:binary>>"


def _downward(levels: list[DataFrame], ends: DataFrame, arity: int) -> DataFrame:
    """k, place, lone, states, kids, steps, subroot of the runs of the lowest level. ends (k, steps, subroot): what stands above the last node of each k. Steps rise from a run's own
    node; those of a lone run are its end's."""
    above = None
    for level in reversed(levels):
        tops = level.where("lone").join(ends, "k")
        whole = tops if above is None else tops.unionByName(level.where("not lone").join(above, ["k", "place"]))
        # a lone run's child is the same node one level below: it stands at place 0 with the same steps
        slots = F.when(F.col("lone"), F.array(F.struct(F.lit(0).alias("slot"), F.lit(True).alias("same")))).otherwise(F.transform(F.sequence(F.lit(0), (F.length("kids") / 32).cast("int") - 1), lambda i: F.struct(i.alias("slot"), F.lit(False).alias("same"))))
        each = whole.withColumn("s", F.explode(slots))
        step = F.struct(F.col("s.slot").alias("slot"), F.expr("substring(states, s.slot * 32 + 1, 32)").alias("state"), F.col("kids").alias("kids"))
        above = each.select("k", (F.col("place") * arity + F.col("s.slot")).alias("place"), F.when(F.col("s.same"), F.col("steps")).otherwise(F.concat(F.array(step), F.col("steps"))).cast(_STEPS).alias("steps"), "subroot")
        lowest = whole
    return lowest


def build(leaves: DataFrame, arity: int = ARITY) -> Tree:
    """The tree over leaves (k, doc_id, leaf, replacement): k is the group as a string that is never null; replacement is the leaf to fold, usually the leaf itself.

    Leaves ascend by doc_id, null first, rows of one doc_id by their leaf. Ranks come from ranges of the order, so a group of any size lies over many tasks."""
    placed, _ = ranked(unclashed(leaves, "k", "doc_id", "leaf", "replacement"), ["k"], ["doc_id", "leaf"], "leaves")
    runs = placed.groupBy("k", F.expr(f"place div {arity}").alias("run")).agg(F.sort_array(F.collect_list(F.struct("place", "doc_id", "leaf", "replacement"))).alias("members"))
    runs = written(runs.select("k", F.col("run").alias("place"), "members"), "runs")
    levels = _upward(runs.select("k", "place", F.col("members.leaf").alias("children")), arity, "nodes")
    ends = levels[0].where("lone")
    for level in levels[1:]:
        ends = ends.unionByName(level.where("lone"))
    ends, _ = ranked(ends.select("k", "digest").withColumn("all", F.lit("")), ["all"], ["k"], "ends")
    ends = written(ends.select("k", "digest", "place"), "ends")
    top_runs = ends.groupBy(F.expr(f"place div {arity}").alias("run")).agg(F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("m")).select(F.lit("").alias("k"), F.col("run").alias("place"), F.col("m.digest").alias("children"))
    tops = _upward(top_runs, arity, "tops")
    last = tops[-1].select(F.lower(F.hex("digest"))).first()
    nothing = ends.sparkSession.range(1).select(F.lit("").alias("k"), F.array().cast(_STEPS).alias("steps"), F.lit(None).cast("binary").alias("subroot"))
    lowest = _downward(tops, nothing, arity)
    slots = F.transform(F.sequence(F.lit(0), (F.length("kids") / 32).cast("int") - 1), lambda i: F.struct(i.alias("slot"), F.substring(F.col("states"), i * 32 + 1, F.lit(32)).alias("state")))
    each = lowest.withColumn("s", F.explode(slots))
    step = F.struct(F.col("s.slot").alias("slot"), F.col("s.state").alias("state"), F.col("kids").alias("kids"))
    paths = each.select((F.col("place") * arity + F.col("s.slot")).alias("place"), F.when(F.col("lone"), F.col("steps")).otherwise(F.concat(F.array(step), F.col("steps"))).cast(_STEPS).alias("steps"))
    ends = written(ends.join(paths, "place").select("k", "steps", F.col("digest").alias("subroot")), "paths")
    below = _downward(levels, ends, arity)
    return Tree(below.join(runs, ["k", "place"]), [*levels, *tops], last[0] if last else None)


def folded(tree: Tree, arity: int = ARITY) -> DataFrame:
    """doc_id, leaf, subroot, proof_sha256, folded_root, one row a leaf: the hash of all siblings up to the root, left to right, and the root that the leaf's replacement gives."""
    members = tree.runs.schema["members"].dataType
    kind = members.elementType["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                b = batch.slice(start, 512)
                lone, states, kids, steps, subroots, rows = (b.column(i).to_pylist() for i in range(6))
                n = [len(r) for r in rows]
                ids = b.column(5).flatten().field("doc_id")
                leaves = [m["leaf"] for r in rows for m in r]
                owner = np.repeat(np.arange(b.num_rows), n)
                slot = np.concatenate([np.arange(k) for k in n])
                own = [[] if alone else [(None, s, k)] for alone, s, k in zip(lone, states, kids, strict=True)]
                ways = [o + [(s["slot"], s["state"], s["kids"]) for s in w] for o, w in zip(own, steps, strict=True)]
                value = np.frombuffer(b"".join(m["replacement"] for r in rows for m in r), np.uint8).reshape(-1, 32).copy()
                proofs = [hashlib.sha256() for _ in leaves]
                for level in range(max(map(len, ways))):
                    on = np.flatnonzero(np.array([len(w) > level for w in ways])[owner])
                    steps_here = [ways[i][level] for i in owner[on]]
                    at = np.array([slot[r] if s[0] is None else s[0] for r, s in zip(on, steps_here, strict=True)])
                    # the states of a run of leaves are all there, those of a path are cut to the slot
                    before = b"".join(s[1][32 * a : 32 * a + 32] if s[0] is None else s[1] for a, s in zip(at, steps_here, strict=True))
                    children, count = _padded([s[2] for s in steps_here], arity)
                    children[np.arange(len(on)), at] = value[on]
                    value[on] = _resumed(np.ascontiguousarray(np.frombuffer(before, np.uint32).reshape(-1, 8).T), children, count, at)
                    for r, a, s in zip(on.tolist(), at.tolist(), steps_here, strict=True):
                        text = s[2].hex()
                        proofs[r].update((text[: 64 * a] + text[64 * a + 64 :]).encode())
                yield pa.RecordBatch.from_arrays([ids, pa.array([x.hex() for x in leaves]), pa.array([subroots[i].hex() for i in owner]), pa.array([p.hexdigest() for p in proofs]), pa.array([v.tobytes().hex() for v in value])], ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])
        give_back()

    return tree.runs.select("lone", "states", "kids", "steps", "subroot", "members").mapInArrow(run, f"doc_id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string")


def dataset_manifest(docs: DataFrame, altered: Column | None = None, columns: tuple[str, ...] = COLUMNS, by: str = "source", arity: int = ARITY) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, one row for every row of docs.

    altered: the text that is folded instead of the one that was sealed; verified says whether the root is still the same. Rows of a null source are a group of their own, before the
    others; a null doc_id comes first in its group; rows with one doc_id follow by their leaves, and equal rows are leaves of their own. Null and empty values differ (`-`, `0:`). An empty
    table gives no rows. Texts are hashed whole where they are read; extra columns are left out."""
    docs = unclashed(docs, *dict.fromkeys([*columns, by]))
    parts = {c: F.col(f"`{c}`") for c in columns}
    other = parts | {"text": altered} if altered is not None else parts
    key = F.when(F.col(by).isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col(by).cast("string")))
    leaf = leaf_hash(parts)
    leaves = docs.select(key.alias("k"), F.col(columns[0]).alias("doc_id"), leaf.alias("leaf"), *([leaf_hash(other).alias("replacement")] if altered is not None else [leaf.alias("replacement")]))
    tree = build(written(leaves, "hashes"), arity)  # ordering by range looks at the leaves twice
    return folded(tree, arity).withColumn("root", F.lit(tree.root)).withColumn("verified", F.col("folded_root") == F.col("root")).select(F.col("doc_id").cast(id_type(docs, columns[0])).alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def tampered(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text, with A-Z in lower case where 5 divides the checksum of the decimal doc_id."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, low).otherwise(F.col(text))
