"""Near-duplicate documents by ProbMinHash signatures of weighted word shingles.

A document is a bag of five-word shingles weighted by their counts. Each shingle starts a Poisson process whose rate is its weight; every
arrival falls on a random component of the signature, which keeps the shingle of its first arrival. A process ends once its next arrival is
later than all components' first, so most shingles cost one or two arrivals. Two signatures agree in a component with the probability
Jaccard similarity J_P of the bags, which is plain Jaccard where no shingle repeats. Bands of components give buckets, and candidates
are verified with the exact J_P.

Hot buckets never become all their pairs as rows. Exact copies are one representative. In a bucket, everyone is first compared with its most
connected member only. Buckets whose members then lie in several components are compared whole, each distinct set of members once: tiles of a bucket meet in
pairs in a task, which finds the shared weight of all its pairs by matrix products, verifies what can reach the limit, and returns a spanning forest of
the links. So every pair of a bucket that could join two components is verified, and the classes are those of comparing all pairs of all buckets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, few, id_type, salted_join, spanning_roots, unclashed, written
from .words import LOWER_VALUES, find_words, mix, phrase_hashes, powers, slices, word_hashes

WORDS = 5
SIMILARITY = 0.8
#: 32 bands of 6: a pair at the limit shares no bucket once in 16,000 pairs, one at 0.85 once in 4 million.
BANDS, ROWS = 32, 6
#: Members that meet one copy of a pivot's text; members of a bucket in one tile, and characters of their texts, both on average; shingles of a matrix product.
CHUNK, TILE, TILE_CHARS, COLUMNS = 256, 256, 1 << 22, 4096
#: Rows of a file of signatures or of members that meet many tiles, and of one of texts.
WIDE_ROWS, TEXT_ROWS = 1 << 14, 1 << 11
_LOW52 = np.uint64((1 << 52) - 1)
_STEP = 0xD6E8FEB86659FD93


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, 52-bit hash and count of every distinct shingle, ordered by row and hash; two 64-bit hashes of each row's words (n, 2), 0 without
    words. A text of fewer than five words has one shingle, all its words."""
    rows = len(offsets) - 1
    ws, we, wr = find_words(data, offsets)
    words = word_hashes(data, ws, we, LOWER_VALUES)
    first = np.searchsorted(wr, np.arange(rows + 1))
    n = np.diff(first)
    keys = np.zeros((rows, 2), np.uint64)
    for k, base in enumerate((0xC6A4A7935BD1E995, 0xFF51AFD7ED558CCD)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words + np.uint64(k)) * powers(base, len(words)))])
        keys[:, k] = mix((sums[first[1:]] - sums[first[:-1]]) * powers(base, len(words) + 1, True)[first[:-1]] + n.astype(np.uint64))
    keys[n == 0] = 0
    h, whole = phrase_hashes(words, wr, WORDS)
    at, h = wr[: len(h)][whole], h[whole]
    short = np.flatnonzero((n > 0) & (n < WORDS))
    packed = np.sort(np.concatenate([(at.astype(np.uint64) << np.uint64(52)) | (h >> np.uint64(12)), (short.astype(np.uint64) << np.uint64(52)) | (keys[short, 0] >> np.uint64(12))]))
    new = np.flatnonzero(np.append(True, packed[1:] != packed[:-1])) if len(packed) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(packed)))
    packed = packed[new]
    return (packed >> np.uint64(52)).astype(np.int64), packed & _LOW52, count, keys


def signatures(row: np.ndarray, shingle: np.ndarray, count: np.ndarray, rows: int, size: int) -> np.ndarray:
    """(rows, size): for each component the shingle of its first arrival. 11 bits choose the component, so size is 2048 at most."""
    if size > 2048:
        raise ValueError("a signature has 2048 components at most")
    first, kept = np.full(rows * size, np.inf), np.zeros(rows * size, np.uint64)
    limit = np.full(rows, np.inf)
    time, weight, seed = np.zeros(len(row)), count.astype(float), mix(shingle + np.uint64(1))
    step = 0
    while len(row):
        step += 1
        r = mix(seed + np.uint64(step * _STEP % 2**64))
        time = time - np.log(((r >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weight
        early = time < limit[row]
        if not early.all():
            row, shingle, weight, seed, time, r = (x[early] for x in (row, shingle, weight, seed, time, r))
            if not len(row):
                break
        at = row * size + (((r & np.uint64(2047)).astype(np.int64) * size) >> 11)
        np.minimum.at(first, at, time)
        won = first[at] == time
        kept[at[won]] = shingle[won]
        live = row[np.append(True, row[1:] != row[:-1])]
        limit[live] = first.reshape(rows, size)[live].max(1)
    return kept.reshape(rows, size)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Exact J_P of two bags: sorted distinct shingles a with counts x, b with counts y."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    p, q = x[i].astype(float), y[j].astype(float)
    only_x, only_y = float(x.sum() - x[i].sum()), float(y.sum() - y[j].sum())
    out = 0.0
    ratios, which = np.unique(p / q, return_inverse=True)
    for k, ratio in enumerate(ratios):
        out += p[which == k].sum() / (only_x + ratio * only_y + np.maximum(p, q * ratio).sum())
    return float(out)


def prepared(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, key1, key2 (equal for equal word sequences, null without words), bands; narrow."""

    def signed(batches):
        salts = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        q = powers(_STEP, ROWS)
        for part, data, offsets in slices(batches, text):
            row, shingle, count, keys = shingles(data, offsets)
            kept = signatures(row, shingle, count, part.num_rows, BANDS * ROWS)
            bands = mix((mix(kept.reshape(-1, BANDS, ROWS)) * q).sum(2, dtype=np.uint64) + salts).view(np.int64)
            blank = pa.array(keys[:, 0] == 0)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel()), BANDS).cast(pa.list_(pa.int64()))
            hashes = [pa.array(keys[:, k].view(np.int64), mask=np.asarray(blank)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column(0), *hashes, lists], ["doc_id", "key1", "key2", "bands"])

    return unclashed(docs, doc_id, text).where(F.col(doc_id).isNotNull()).mapInArrow(signed, f"doc_id {id_type(docs, doc_id)}, key1 bigint, key2 bigint, bands array<bigint>")


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(u, v) of the pairs (pivot, member) with J_P >= least. A pivot's text is sent once for CHUNK members, a member's once for its pivot;
    rows of one chunk meet in a task that reads them as a stream, the pivot first."""
    sizes = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = pairs.join(sizes, "pivot").withColumn("chunk", F.pmod(F.xxhash64("member"), F.col("chunks")).cast("int"))
    wanted = dealt.select("pivot", "chunk", F.lit(1).alias("kind"), F.col("member").alias("doc_id")).unionByName(
        sizes.select("pivot", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("kind"), F.col("pivot").alias("doc_id"))
    )
    rows = wanted.join(texts, "doc_id").repartition("pivot", "chunk").sortWithinPartitions("pivot", "chunk", "kind")

    def compared(batches):
        held = own = None
        for part, data, offsets in slices(batches, "text"):
            row, shingle, count, _ = shingles(data, offsets)
            cut = np.searchsorted(row, np.arange(part.num_rows + 1))
            u, v = [], []
            for i, (pivot, chunk, kind, doc) in enumerate(zip(*(part.column(c).to_pylist() for c in ("pivot", "chunk", "kind", "doc_id")), strict=True)):
                bag = shingle[cut[i] : cut[i + 1]], count[cut[i] : cut[i + 1]]
                if kind == 0:
                    held, own = (pivot, chunk), (bag[0].copy(), bag[1].copy())
                elif held == (pivot, chunk) and probability_jaccard(*own, *bag) >= least - 1e-12:
                    u.append(pivot)
                    v.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(u, part.column(0).type), pa.array(v, part.column(0).type)], ["u", "v"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "pivot", "chunk", "kind", "text").mapInArrow(compared, f"u {kind}, v {kind}")


def _links(bags: list[tuple[np.ndarray, np.ndarray]], side: np.ndarray, known: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with J_P >= least between sides (or inside the one side there is) whose known roots differ. The weight of a bag on the shingles that it shares
    with another bounds their J_P, whichever of the two is weighed, so only pairs above that are compared by themselves."""
    n = len(bags)
    shingle, count = np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags]).astype(float)
    owner = np.repeat(np.arange(n), [len(b[0]) for b in bags])
    total = np.bincount(owner, count, n)
    values, column, times = np.unique(shingle, return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    use = times[column] > 1
    owner, column, count = owner[use], place[column[use]], count[use]
    order = np.argsort(column, kind="stable")
    owner, column, count = owner[order], column[order], count[order]
    shared = np.zeros((n, n))
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        i, j = np.searchsorted(column, [low, low + COLUMNS])
        has, weighs = np.zeros((n, COLUMNS), np.float32), np.zeros((n, COLUMNS), np.float32)
        has[owner[i:j], column[i:j] - low] = 1
        weighs[owner[i:j], column[i:j] - low] = count[i:j]
        shared += weighs @ has.T
    mass = shared / np.maximum(total, 1)[:, None]
    may = np.minimum(mass, mass.T) >= least - 1e-6
    may &= known[:, None] != known[None, :]
    may &= side[:, None] < side[None, :] if side.any() else np.triu(np.ones((n, n), bool), 1)
    a, b = np.nonzero(may)
    plain = np.array([bool((c == 1).all()) for _, c in bags])
    simple = plain[a] & plain[b]
    both = shared[a, b]
    good = simple & (both >= (least - 1e-12) * (total[a] + total[b] - both))
    root = spanning_roots(a[good], b[good], n)
    for k in np.flatnonzero(~simple):
        if root[a[k]] != root[b[k]] and probability_jaccard(*bags[a[k]], *bags[b[k]]) >= least - 1e-12:
            good[k] = True
            root[root == root[b[k]]] = root[a[k]]
    return a[good], b[good]


def _across(open_buckets: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(u, v): roots of components between which the buckets (bucket, doc_id, root, chars) hold a link, a spanning forest for each pair of tiles. A text that is longer than a
    tile's share has a tile nearly to itself, so a task holds two tiles' texts and not a number of texts of any length."""
    sets = open_buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.bit_xor(F.xxhash64("doc_id")).alias("s"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("x"))
    once = sets.groupBy("n", "s", "x").agg(F.min("bucket").alias("bucket"), F.max("chars").alias("chars")).select("bucket", F.ceil(F.greatest(F.col("n") / TILE, F.col("chars") / TILE_CHARS)).cast("int").alias("tiles"))
    rows = open_buckets.join(once, "bucket").withColumn("tile", F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int")).withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("bucket", F.least("tile", "mate").alias("low"), F.greatest("tile", "mate").alias("high"), (F.col("tile") > F.col("mate")).cast("int").alias("side"), "doc_id", "root")
    rows = rows.join(texts, "doc_id").repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "doc_id")

    def compared(batches):
        key, held = None, []

        def emit(kind):
            roots = np.array([h[2] for h in held])
            a, b = _links([h[3] for h in held], np.array([h[1] for h in held]), np.array([h[2] for h in held]), least) if len(held) > 1 else ((), ())
            root = spanning_roots(np.asarray(a, np.int64), np.asarray(b, np.int64), len(held))
            some = np.flatnonzero(root != np.arange(len(held)))
            return pa.RecordBatch.from_arrays([pa.array(roots[root[some]], kind), pa.array(roots[some], kind)], ["u", "v"])

        kind = None
        for part, data, offsets in slices(batches, "text"):
            kind = part.column(0).type
            row, shingle, count, _ = shingles(data, offsets)
            cut = np.searchsorted(row, np.arange(part.num_rows + 1))
            for i, (doc, bucket, low, high, side, root) in enumerate(zip(*(part.column(c).to_pylist() for c in ("doc_id", "bucket", "low", "high", "side", "root")), strict=True)):
                if (bucket, low, high) != key:
                    if held:
                        yield emit(kind)
                    key, held = (bucket, low, high), []
                held.append((doc, side, root, (shingle[cut[i] : cut[i + 1]].copy(), count[cut[i] : cut[i + 1]].copy())))
        if held:
            yield emit(kind)

    kind = texts.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "bucket", "low", "high", "side", "root", "text").mapInArrow(compared, f"u {kind}, v {kind}")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, representative (the smallest doc_id with the same words), class_id (the smallest doc_id reachable over links), kept (it is the class').

    One row for every row with a doc_id. Null, empty and blank texts link with nothing. Rows that share a doc_id count as one document, whose text is that of any of them
    if they differ. A text of fewer than five words has one shingle, all of them. Long texts are taken whole; extra columns are left out. Any type of
    doc_id that has an order will do."""
    docs = unclashed(docs, doc_id, text).toDF("doc_id", "text")
    signed = written(prepared(docs), "signatures")
    n_docs = signed.count()
    same = written(few(signed.where("key1 is not null").groupBy("key1", "key2").agg(F.min("doc_id").alias("representative"), F.min_by("bands", "doc_id").alias("bands"), F.count("*").alias("n")), n_docs, WIDE_ROWS), "unique")
    buckets = same.select(F.col("representative").alias("doc_id"), F.explode("bands").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(few(buckets.join(sizes, "bucket"), BANDS * n_docs), "buckets")
    n_shared = shared.count()
    degrees = shared.groupBy("doc_id").agg(F.sum("n").alias("degree"))
    texts = written(few(docs.join(degrees.select("doc_id"), "doc_id").dropDuplicates(["doc_id"]), n_docs, TEXT_ROWS), "texts")
    pivots = shared.join(degrees, "doc_id").groupBy("bucket").agg(F.min(F.struct((-F.col("degree")).alias("degree"), "doc_id")).alias("top")).select("bucket", F.col("top.doc_id").alias("pivot"))
    star = shared.join(pivots, "bucket").where("doc_id <> pivot").select("pivot", F.col("doc_id").alias("member")).distinct()
    first = written(few(components(_verified(star, texts, least), most=n_shared), n_shared), "roots")
    labelled = shared.join(first, F.col("doc_id") == F.col("node"), "left").select("bucket", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    several = labelled.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("bucket")
    opened = written(few(labelled.join(several, "bucket").join(texts.select("doc_id", F.length("text").alias("chars")), "doc_id"), n_shared, WIDE_ROWS), "open")
    # only roots are joined anew: their classes are few
    second = components(_across(opened, texts, least), most=n_shared).toDF("root", "top")
    labels = first.join(second, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(second.join(first, second.root == first.node, "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root")))
    classes = same.select("key1", "key2", "representative").join(labels, F.col("representative") == F.col("node"), "left").select("key1", "key2", "representative", F.coalesce("root", "representative").alias("class_id"))
    told = signed.select("doc_id", "key1", "key2")
    out = salted_join(told.where("key1 is not null"), classes, ["key1", "key2"], "doc_id", counts=same.select("key1", "key2", "n")).select("doc_id", "representative", "class_id")
    out = out.unionByName(told.where("key1 is null").select("doc_id", F.col("doc_id").alias("representative"), F.col("doc_id").alias("class_id")))
    return out.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def one_of_each(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of docs whose document is the one kept of its class, and rows without a doc_id; all columns as they are."""
    gone = near_duplicates(docs, least).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
