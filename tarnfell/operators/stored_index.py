"""The inverted index as a stored table: postings in blocks by bucket of the term, changed by signed segments, searched with upper bounds.

Layout below a folder, each table by segment and bucket, so that a read of some terms lists some files only:
forward  chunk_id, dl, counts (term, tf of each chunk), sign; by bucket of chunk_id
terms    term, df (signed), n, bits, max_tf, min_dl; by bucket of the term
blocks   term, slot, n, max_tf, min_dl, postings (chunk_id, tf, dl, sign); by bucket of the term
vectors  chunk_id, embedding, sign; by bucket of chunk_id
Numbers of chunks and tokens stand in the segment's entry of the published pointer.

A change of documents is a segment of its own: the new postings with sign 1 and those of the chunks that go with sign -1, taken from their forward rows, so that no old text is read and nothing but
changed chunks is tokenized. Scores, document frequencies and lengths are sums, so signs cancel when they are added up. Compaction adds them up once for all.

A block holds the postings of a term whose chunks fall in one slot, about BLOCK of them, and the best tf and dl among them: no chunk in it can score more. Search is exact: the rarest terms of a
question give a score that its pool must reach; common terms that cannot reach it together are not read through (MaxScore), but looked up for the chunks that may still make it, after their blocks'
bounds have been tried (block-max)."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import tokens
from ..sources import log
from ..sources.stores import free_shuffles, sized, written
from .lexical import B, K1, LexicalIndex, query_terms, searchable_text

BLOCK = 64
#: Postings of all questions together up to which they are simply read.
FULL = 1 << 24
#: Postings that a task puts together, about.
DEALT = 1 << 19
#: Postings of a term above which its slots are dealt over several tasks, by their first bits.
HOT, HOT_BITS = 1 << 22, 10
#: Changed chunks whose ids are sent to all tasks, so that the forward rows of others are not shuffled.
CHANGED = 2_000_000
#: Number of the layout, for those who look for an index by what it is made of.
LAYOUT = 1
#: Share of the score that a pool must reach which the common terms together may make up: the smaller, the fewer chunks are looked up and the more terms are read through.
COMMON = 0.5
#: Postings of a question's rarest terms that are read to find a score its pool must reach, for each place of the pool.
SEEDS = 32
#: Below a threshold by less than this counts as reaching it: scores are sums in no fixed order.
_SLACK = 1e-6
_TABLES = ["forward", "terms", "blocks", "vectors"]


def counted(chunks: DataFrame) -> DataFrame:
    """chunk_id, dl, counts (term, tf): tokens are sorted and counted within the row, so that nothing is shuffled."""
    rows = chunks.select("chunk_id", F.array_sort(tokens(searchable_text(chunks))).alias("t"))
    first = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1)))
    rows = rows.select("chunk_id", "t", F.when(F.size("t") > 0, first).otherwise(F.array().cast("array<int>")).alias("first"))
    counts = F.transform("first", lambda i, k: F.struct(F.get("t", i).alias("term"), (F.coalesce(F.get("first", k + 1), F.size("t")) - i).alias("tf")))
    return rows.select("chunk_id", F.greatest(F.size("t"), F.lit(0)).alias("dl"), counts.alias("counts"))


def bucket(key: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _impact(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    length = F.when(dl > 0, dl).otherwise(1)
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avgdl))


@dataclass
class StoredIndex:
    """One published version of the index below a folder."""

    spark: SparkSession
    folder: str
    pointer: log.Pointer
    chunk_type: str
    buckets: int

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The live segments of a table, of the given buckets only."""
        fields = {
            "forward": f"chunk_id {self.chunk_type}, dl int, counts array<struct<term:string,tf:int>>, sign int",
            "terms": "term string, df bigint, n bigint, bits int, max_tf int, min_dl int",
            "blocks": f"term string, slot bigint, n bigint, max_tf int, min_dl int, postings array<struct<chunk_id:{self.chunk_type},tf:int,dl:int,sign:int>>",
            "vectors": f"chunk_id {self.chunk_type}, embedding array<float>, sign int",
        }[name]
        if name == "vectors" and not any(s.get("vectors") for s in self.pointer.segments) or not self.pointer.segments:
            return self.spark.createDataFrame([], f"{fields}, segment string, bucket int")
        rows = self.spark.read.schema(f"{fields}, segment string, bucket int").parquet(f"{self.folder}/{name}").where(F.col("segment").isin(self.pointer.names))
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    @property
    def chunks(self) -> int:
        return sum(s["n"] for s in self.pointer.segments)

    @property
    def avgdl(self) -> float:
        """Mean tokens of a chunk; 1.0 if there is nothing."""
        return (sum(s["total"] for s in self.pointer.segments) / self.chunks if self.chunks else 0.0) or 1.0

    def lexical(self) -> LexicalIndex:
        """postings, term_stats, corpus_stats as plain tables, signs added up."""
        rows = self.table("blocks").select("term", F.explode("postings").alias("p")).select("term", "p.*")
        postings = rows.groupBy("term", "chunk_id", "tf", "dl").agg(F.sum("sign").alias("s")).where("s > 0").drop("s")
        stats = self.table("terms").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        return LexicalIndex(postings, stats, self.spark.range(1).select(F.lit(self.chunks).cast("long").alias("n"), F.lit(self.avgdl).alias("avgdl")))

    def by_term(self) -> DataFrame:
        """term, df, tf, dl: sums over the postings that are there. Signed postings are added up as they are, so no posting is shuffled."""
        rows = self.table("blocks").select("term", F.explode("postings").alias("p"))
        sums = rows.groupBy("term").agg(*[F.sum(x).alias(n) for n, x in (("df", F.col("p.sign")), ("tf", F.col("p.sign") * F.col("p.tf")), ("dl", F.col("p.sign") * F.col("p.dl")))])
        return sums.where("df > 0")

    def vectors(self) -> DataFrame:
        """chunk_id, embedding of the chunks that are there."""
        rows = self.table("vectors").groupBy("chunk_id", "embedding").agg(F.sum("sign").alias("s"))
        return rows.where("s > 0").drop("s")

    def pool(self, questions: DataFrame, k: int) -> DataFrame:
        return search(self, questions, k).hits


def open_index(spark: SparkSession, folder: str) -> StoredIndex | None:
    """The version that was published last; null if there is none."""
    pointer = log.latest(spark, folder)
    if not pointer.version:
        return None
    first = pointer.segments[0] if pointer.segments else {"chunk_type": "string", "buckets": 16}
    return StoredIndex(spark, folder, pointer, first["chunk_type"], first["buckets"])


def write_index(chunks: DataFrame, folder: str, vectors: DataFrame | None = None, buckets: int = 16, files: int = 1) -> StoredIndex:
    """A new index over chunks (chunk_id, text, searched metadata) and vectors (chunk_id, embedding), published as the next version. Choose buckets so that a bucket of a table is read by a few tasks,
    and files (of each bucket) so that a task writes a bounded part of it."""
    spark = chunks.sparkSession
    version = log.latest(spark, folder).version + 1
    forward = counted(chunks).withColumn("sign", F.lit(1))
    signed = None if vectors is None else vectors.select("chunk_id", "embedding", F.lit(1).alias("sign"))
    segment = _segment(spark, folder, forward, signed, buckets, files, chunks.schema["chunk_id"].dataType.simpleString(), narrow=True)
    log.publish(spark, folder, log.Pointer(version, [segment]))
    return open_index(spark, folder)


def update_index(index: StoredIndex, gone: DataFrame, came: DataFrame, vectors: DataFrame | None = None, files: int = 1) -> StoredIndex:
    """The index without the chunks whose chunk_id gone has, and with the chunks of came, whose older versions go too. Reads the forward rows of changed chunks' buckets, tokenizes came. Raises
    WriteConflict if another writer was faster."""
    spark = index.spark
    ids = written(gone.select("chunk_id").unionByName(came.select("chunk_id")).distinct(), "changed")
    touched = [r[0] for r in ids.select(bucket("chunk_id", index.buckets)).distinct().collect()]  # at most as many as buckets
    some = sized(ids, CHANGED)
    old = index.table("forward", touched).join(some, "chunk_id", "left_semi").groupBy("chunk_id", "dl", "counts").agg(F.sum("sign").alias("s")).where("s > 0")
    forward = old.select("chunk_id", "dl", "counts", F.lit(-1).alias("sign")).unionByName(counted(came).withColumn("sign", F.lit(1)))
    past = index.table("vectors", touched).join(some, "chunk_id", "left_semi").groupBy("chunk_id", "embedding").agg(F.sum("sign").alias("s")).where("s > 0").select("chunk_id", "embedding", F.lit(-1).alias("sign"))
    signed = past if vectors is None else past.unionByName(vectors.select("chunk_id", "embedding", F.lit(1).alias("sign")))
    had = vectors is not None or any(s.get("vectors") for s in index.pointer.segments)
    segment = _segment(spark, index.folder, forward, signed if had else None, index.buckets, files, index.chunk_type)
    log.publish(spark, index.folder, log.Pointer(index.pointer.version + 1, [*index.pointer.segments, segment]))
    return open_index(spark, index.folder)


def compact(index: StoredIndex, files: int = 1) -> StoredIndex:
    """All segments as one, signs added up; no text is read. Segments that are not needed any more stay until log.sweep()."""
    forward = index.table("forward").groupBy("chunk_id", "dl", "counts").agg(F.sum("sign").alias("s")).where("s > 0").select("chunk_id", "dl", "counts", F.lit(1).alias("sign"))
    had = any(s.get("vectors") for s in index.pointer.segments)
    signed = index.vectors().withColumn("sign", F.lit(1)) if had else None
    segment = _segment(index.spark, index.folder, forward, signed, index.buckets, files, index.chunk_type)
    log.publish(index.spark, index.folder, log.Pointer(index.pointer.version + 1, [segment]))
    return open_index(index.spark, index.folder)


def sweep(index: StoredIndex) -> int:
    return log.sweep(index.spark, index.folder, _TABLES, index.pointer.names)


def _segment(spark, folder, forward: DataFrame, vectors: DataFrame | None, buckets: int, files: int, chunk_type: str, narrow: bool = False) -> dict:
    """Write a segment's tables. narrow: forward rows are many, so that each task writes its own share of every bucket; else they are brought together by bucket first."""
    name = uuid.uuid4().hex
    at = lambda table: f"{folder}/{table}/segment={name}"

    def save(rows: DataFrame, table: str) -> None:
        rows.write.option("compression", "zstd").partitionBy("bucket").parquet(at(table))
        free_shuffles(spark)

    def put(rows: DataFrame, table: str) -> None:
        save(rows.withColumn("bucket", bucket("chunk_id", buckets)).repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(files))), table)

    if narrow:
        save(forward.withColumn("bucket", bucket("chunk_id", buckets)), "forward")
    else:
        put(forward, "forward")
    fields = f"chunk_id {chunk_type}, dl int, counts array<struct<term:string,tf:int>>, sign int"
    forward = spark.read.schema(fields).parquet(at("forward"))
    rows, n, total, postings = forward.agg(F.count("*"), *[F.coalesce(F.sum(x), F.lit(0)) for x in (F.col("sign"), F.col("sign") * F.col("dl"), F.size("counts"))]).first()
    hot = _hot(forward, max(HOT, postings // 1000)) if rows > HOT else {}
    parts = max(files, math.ceil(postings / (buckets * DEALT)))
    tasks = max(parts * buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))) if parts > files else None
    read = max(math.ceil(postings / (4 * DEALT)), spark.sparkContext.defaultParallelism)
    runs = _runs(forward.coalesce(read), chunk_type, list(hot)).withColumns({"bucket": bucket("term", buckets), "part": F.pmod(F.xxhash64("spread", "term"), F.lit(parts))})
    runs = runs.repartition(tasks, "bucket", "part") if tasks else runs.repartition("bucket", "part")
    whole = F.sum(F.size("numbers")).over(Window.partitionBy("bucket", "part", "term"))
    known = F.create_map(*[F.lit(x) for pair in hot.items() for x in pair])[F.col("term")] if hot else F.lit(None)
    placed = runs.withColumn("bits", _bits(F.coalesce(known.cast("bigint"), whole))).select("bucket", "part", "term", "bits", F.explode(F.arrays_zip("chunk_id", "numbers")).alias("p")).select("bucket", "part", "term", "bits", "p.*")
    fields = {"tf": F.shiftright("numbers", 33), "dl": F.shiftright("numbers", 1).bitwiseAND(0xFFFFFFFF), "sign": F.col("numbers").bitwiseAND(1) * 2 - 1}
    placed = placed.withColumns({c: x.cast("int") for c, x in fields.items()})
    placed = placed.withColumn("slot", F.when(F.col("bits") > 0, _slot(F.col("bits"))).otherwise(0))
    most, least = F.max(F.when(F.col("sign") > 0, F.col("tf"))), F.min(F.when(F.col("sign") > 0, F.col("dl")))
    blocks = placed.groupBy("bucket", "part", "term", "slot").agg(F.count("*").alias("n"), most.alias("max_tf"), least.alias("min_dl"), F.collect_list(F.struct("chunk_id", "tf", "dl", "sign")).alias("postings"))
    save(blocks.drop("part").sortWithinPartitions("bucket", "term", "slot"), "blocks")
    blocks = spark.read.schema("term string, n bigint, max_tf int, min_dl int, postings array<struct<sign:int>>, bucket int").parquet(at("blocks"))
    blocks = blocks.withColumns({"df": F.aggregate("postings.sign", F.lit(0).cast("bigint"), lambda a, x: a + x), "part": F.pmod(F.xxhash64("term"), F.lit(files))}).drop("postings")
    terms = blocks.repartition("bucket", "part").groupBy("bucket", "part", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"))
    save(terms.select("term", "df", "n", _bits(F.col("n")).alias("bits"), "max_tf", "min_dl", "bucket"), "terms")
    if vectors is not None:
        put(vectors, "vectors")
    return {"name": name, "n": n, "total": total, "chunk_type": chunk_type, "buckets": buckets, "vectors": vectors is not None}


def _hot(forward: DataFrame, above: int) -> dict[str, int]:
    """The postings of the terms that have more than that many: fewer than 1,000 terms, as above is a thousandth of all postings at least."""
    return {r["term"]: r["n"] for r in forward.select(F.explode("counts.term").alias("term")).groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") > above).collect()}


def _runs(forward: DataFrame, chunk_type: str, hot: list[str]) -> DataFrame:
    """term, spread, and lists of chunk_id and numbers (tf, 32 bits of dl, one that says sign 1) of a term in some forward rows, so that the term is shuffled once for all of them. spread: the first bits of the slots of a hot term, else 0."""
    key = to_arrow_type(forward.schema["chunk_id"].dataType)
    schema = pa.schema([("term", pa.string()), ("spread", pa.int64()), ("chunk_id", pa.list_(key)), ("numbers", pa.list_(pa.int64()))])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column("counts")
            row, found = pc.list_parent_indices(counts), pc.list_flatten(counts)
            if not len(found):
                continue
            term = found.field("term")
            spread = pc.if_else(pc.is_in(term, pa.array(hot, term.type)), batch.column("spread").take(row), 0)
            flat = pa.table({"term": term, "spread": spread, "row": row, "tf": found.field("tf")}).sort_by([(c, "ascending") for c in ("term", "spread", "row")]).combine_chunks()
            term, spread, row, tf = (flat[c].chunk(0) for c in ("term", "spread", "row", "tf"))
            new = pc.or_(pc.not_equal(term[1:], term[:-1]), pc.not_equal(spread[1:], spread[:-1])).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(new) + 1])
            ends = pa.array(np.append(starts, len(term)).astype(np.int32))
            numbers = [x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (tf, batch.column("dl").take(row), pc.greater(batch.column("sign").take(row), 0))]
            packed = pa.array(numbers[0] << 33 | numbers[1] << 1 | numbers[2])
            runs = [term.take(pa.array(starts)), spread.take(pa.array(starts)), pa.ListArray.from_arrays(ends, batch.column("chunk_id").take(row)), pa.ListArray.from_arrays(ends, packed)]
            yield from pa.table(runs, schema=schema).to_batches(max_chunksize=10_000)

    rows = forward.select("chunk_id", "dl", "sign", "counts", F.call_function("shiftrightunsigned", F.xxhash64("chunk_id"), F.lit(64 - HOT_BITS)).alias("spread"))
    return rows.mapInArrow(together, f"term string, spread bigint, chunk_id array<{chunk_type}>, numbers array<bigint>")


def _bits(n: Column) -> Column:
    """Bits of the slots of a term with n postings."""
    return F.greatest(F.ceil(F.log2(n / BLOCK)), F.lit(0)).cast("int")


def _slot(bits: Column) -> Column:
    """The first bits of the chunk's hash: a slot of more bits lies in one of fewer."""
    return F.call_function("shiftrightunsigned", F.xxhash64("chunk_id"), F.lit(64) - bits)


@dataclass
class Found:
    """hits: question_id, chunk_id, score, place. reads: question_id, postings (of its terms), scored (of them: terms read through, and places looked up)."""

    hits: DataFrame
    reads: DataFrame


def search(index: StoredIndex, questions: DataFrame, k: int, k1: float = K1, b: float = B, full: int = FULL) -> Found:
    """The k best chunks of each question by BM25 (score to 9 decimals, ties by chunk_id), those of the full sums. What is small is joined by broadcast, as Spark finds it from the size of the
    written tables. Where all questions together have at most `full` postings, reading them all is quicker than finding out which can be left; the rows are the same."""
    asked = written(query_terms(questions).withColumn("bucket", bucket("term", index.buckets)), "asked")
    touched = [r[0] for r in asked.select("bucket").distinct().collect()]  # at most as many as buckets
    held = index.table("terms", touched).join(asked.select("term").distinct(), "term", "left_semi")
    known = held.groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"), F.collect_list(F.struct("segment", "bits")).alias("parts")).where("df > 0")
    n, avgdl = F.lit(index.chunks), F.lit(float(index.avgdl))
    idf = F.log(1.0 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    each = asked.join(known, "term").select("question_id", "term", "n", "parts", idf.alias("idf"), (idf * _impact(F.col("max_tf"), F.col("min_dl"), avgdl, k1, b)).alias("bound"))
    rising = Window.partitionBy("question_id").orderBy("n", "term").rowsBetween(Window.unboundedPreceding, -1)
    weights = written(each.withColumn("before", F.coalesce(F.sum("n").over(rising), F.lit(0))), "weights")  # windows over a question's own terms
    blocks = index.table("blocks", touched)

    def part(posting: str) -> Column:
        return F.col("idf") * F.col(f"{posting}.sign") * _impact(F.col(f"{posting}.tf"), F.col(f"{posting}.dl"), avgdl, k1, b)

    def through(terms: DataFrame) -> DataFrame:
        """question_id, chunk_id, part: what all postings of the given terms add to the scores."""
        rows = blocks.join(terms.select("question_id", "term", "idf"), "term").select("question_id", "idf", F.explode("postings").alias("p"))
        return rows.groupBy("question_id", F.col("p.chunk_id").alias("chunk_id")).agg(F.sum(part("p")).alias("part"), F.sum("p.sign").alias("live")).where("live > 0").drop("live")

    def seats(pairs: DataFrame, terms: DataFrame) -> DataFrame:
        """pairs (question_id, chunk_id, ...) with each of the question's given terms, and the block in which such a posting would be."""
        rows = pairs.join(terms.select("question_id", "term", "idf", F.explode("parts").alias("of")), "question_id")
        return rows.withColumns({"segment": F.col("of.segment"), "slot": F.when(F.col("of.bits") > 0, _slot(F.col("of.bits"))).otherwise(0)}).drop("of")

    def looked_up(places: DataFrame) -> DataFrame:
        """question_id, chunk_id, part of the postings that stand in these blocks."""
        rows = blocks.select("term", "segment", "slot", "postings").join(places.withColumnRenamed("chunk_id", "own"), ["term", "segment", "slot"])
        rows = rows.select("question_id", F.col("own").alias("chunk_id"), "idf", F.explode(F.filter("postings", lambda p: p["chunk_id"] == F.col("own"))).alias("p"))
        return rows.select("question_id", "chunk_id", part("p").alias("part"))

    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")
    if (weights.agg(F.sum("n")).first()[0] or 0) <= full:
        total = through(weights).select("question_id", "chunk_id", F.round("part", 9).alias("score"))
        reads = weights.groupBy("question_id").agg(F.sum("n").alias("postings")).withColumn("scored", F.col("postings"))
        return Found(total.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k), reads)
    best = Window.partitionBy("question_id").orderBy(F.desc("part"), "chunk_id")
    seeds = through(weights.where(F.col("before") < SEEDS * k)).withColumn("r", F.row_number().over(best)).where(F.col("r") <= 4 * k).select("question_id", "chunk_id")
    seeds = looked_up(seats(seeds, weights)).groupBy("question_id", "chunk_id").agg(F.sum("part").alias("part")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    needed = seeds.groupBy("question_id").agg(F.when(F.count("*") >= k, F.min("part")).otherwise(0.0).alias("needed"))
    lowest = Window.partitionBy("question_id").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    parted = weights.join(needed, "question_id", "left").withColumn("needed", F.coalesce("needed", F.lit(0.0)))
    parted = parted.withColumn("common", F.sum("bound").over(lowest) < COMMON * F.col("needed") - _SLACK)
    rest = F.sum(F.when(F.col("common"), F.col("bound")).otherwise(0.0)).over(Window.partitionBy("question_id"))
    parted = written(parted.withColumn("rest", rest), "parted")
    limits = parted.select("question_id", "needed", "rest").distinct()
    may = written(through(parted.where("not common")).join(limits, "question_id").where(F.col("part") + F.col("rest") >= F.col("needed") - _SLACK).drop("rest"), "may")
    outline = blocks.select("term", "segment", "slot", "max_tf", "min_dl")
    bounded = seats(may, parted.where("common")).join(outline, ["term", "segment", "slot"])
    most = F.when(F.col("max_tf").isNull(), 0.0).otherwise(F.col("idf") * _impact(F.col("max_tf"), F.col("min_dl"), avgdl, k1, b))
    bounded = written(bounded.select("question_id", "chunk_id", "part", "needed", "term", "segment", "slot", "idf", most.alias("most")), "bounded")
    strong = bounded.groupBy("question_id", "chunk_id").agg((F.first("part") + F.sum("most")).alias("most"), F.first("needed").alias("needed")).where(F.col("most") >= F.col("needed") - _SLACK).select("question_id", "chunk_id")
    left = bounded.select("question_id", "chunk_id", "term", "segment", "slot", "idf").join(strong, ["question_id", "chunk_id"], "left_semi")
    total = may.select("question_id", "chunk_id", "part").unionByName(looked_up(left)).groupBy("question_id", "chunk_id").agg(F.round(F.sum("part"), 9).alias("score"))
    hits = total.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    whole = parted.groupBy("question_id").agg(F.sum("n").alias("postings"), F.sum(F.when(F.col("common"), 0).otherwise(F.col("n"))).alias("through"))
    looked = left.groupBy("question_id").agg(F.count("*").alias("looked"))
    reads = whole.join(looked, "question_id", "left").select("question_id", "postings", (F.col("through") + F.coalesce("looked", F.lit(0))).alias("scored"))
    return Found(hits, reads)
