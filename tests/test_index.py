"""The stored index: deltas against rebuilding, bounded search against full sums, pruned reads, two writers."""

import random

import pytest
from pyspark.sql import functions as F

from tarnfell.operators import lexical, stored_index
from tarnfell.sources import log

SCHEMA = "chunk_id bigint, text string"


def text(rng, n=30):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(n))


def postings(index):
    return sorted(map(tuple, index.lexical().postings.select("term", "chunk_id", "tf", "dl").collect()))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    return {i: text(rng, rng.randrange(60)) for i in range(400)} | {400: "", 401: None, 402: "w1 " * 200}


def frame(spark, rows):
    return spark.createDataFrame(list(rows.items()), SCHEMA)


def test_counts(spark):
    got = {r.chunk_id: (r.dl, [tuple(c) for c in r.counts]) for r in stored_index.counted(frame(spark, {1: "b a b a_c", 2: "", 3: None})).collect()}
    assert got[1] == (6, [("a", 2), ("a_c", 1), ("b", 2), ("c", 1)])
    assert got[2] == got[3] == (0, [])


def test_update_equals_rebuild(spark, texts, tmp_path):
    rng = random.Random(8)
    index = stored_index.write_index(frame(spark, texts), str(tmp_path / "a"), buckets=4)
    now = dict(texts)
    for _ in range(3):
        gone = rng.sample(sorted(now), 15)
        came = {i: text(rng) for i in [*rng.sample(sorted(now), 10), *range(1000, 1005)]}
        for i in gone:
            now.pop(i, None)
        came = {i: t for i, t in came.items() if i not in gone}
        now |= came
        index = stored_index.update_index(index, spark.createDataFrame([(i,) for i in gone], "chunk_id bigint"), frame(spark, came))
    whole = stored_index.write_index(frame(spark, now), str(tmp_path / "b"), buckets=4)
    assert postings(index) == postings(whole) == postings(stored_index.compact(index))
    assert (index.chunks, index.avgdl) == (whole.chunks, whole.avgdl)
    stats = lambda x: sorted(map(tuple, x.lexical().term_stats.collect()))
    assert stats(index) == stats(whole)
    last = stored_index.open_index(spark, str(tmp_path / "a"))
    assert len(last.pointer.segments) == 1 and stored_index.sweep(last) == 3 * 4 and postings(last) == postings(whole)


@pytest.mark.parametrize("block", [2, 64])
def test_bounded_search_is_exact(spark, texts, tmp_path, monkeypatch, block):
    monkeypatch.setattr(stored_index, "BLOCK", block)
    monkeypatch.setattr(stored_index, "SEEDS", 2)
    rng = random.Random(9)
    asked = {i: text(rng, rng.randrange(1, 12)) for i in range(40)} | {40: "unknown words", 41: "the", 42: ""}
    questions = spark.createDataFrame(list(asked.items()), "question_id bigint, question string")
    index = stored_index.write_index(frame(spark, texts), str(tmp_path / "a"), buckets=4)
    index = stored_index.update_index(index, spark.createDataFrame([(3,), (5,)], "chunk_id bigint"), frame(spark, {7: "w1 w2 w3", 2000: "w1 w1 w9"}))
    found = stored_index.search(index, questions, 5, full=0)
    want = sorted(map(tuple, lexical.build_index(frame(spark, {i: t for i, t in texts.items() if i not in (3, 5, 7)} | {7: "w1 w2 w3", 2000: "w1 w1 w9"})).pool(questions, 5).collect()))
    assert sorted((r.question_id, r.chunk_id, pytest.approx(r.score, abs=2e-9), r.place) for r in found.hits.collect()) == want
    assert sorted((r.question_id, r.chunk_id, pytest.approx(r.score, abs=2e-9), r.place) for r in stored_index.search(index, questions, 5).hits.collect()) == want
    reads = found.reads.collect()
    assert all(0 <= r.scored <= r.postings for r in reads if r.postings)
    assert sum(r.scored for r in reads) < 0.9 * sum(r.postings for r in reads)


def test_reads_are_pruned(spark, texts, tmp_path):
    index = stored_index.write_index(frame(spark, texts), str(tmp_path / "a"), buckets=8)
    plan = index.table("blocks", [1, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1]
    files = index.table("blocks", [1, 5]).select("_metadata.file_path").distinct().collect()
    assert {r[0].split("bucket=")[1][0] for r in files} == {"1", "5"}


def test_vectors_and_writers(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "chunk_id bigint, embedding array<float>")
    index = stored_index.write_index(frame(spark, {i: f"w{i}" for i in range(5)}), str(tmp_path / "a"), rows, buckets=2)
    came = rows.where("chunk_id = 2").withColumn("embedding", F.expr("array(cast(9 as float), cast(9 as float))"))
    gone = spark.createDataFrame([(4,)], "chunk_id bigint")
    one = stored_index.update_index(index, gone, frame(spark, {2: "new"}), came)
    assert sorted((r.chunk_id, r.embedding[0]) for r in one.vectors().collect()) == [(0, 0.0), (1, 1.0), (2, 9.0), (3, 3.0)]
    with pytest.raises(log.WriteConflict):
        stored_index.update_index(index, gone, frame(spark, {3: "late"}))
    assert stored_index.open_index(spark, str(tmp_path / "a")).pointer.version == 2
    assert stored_index.open_index(spark, str(tmp_path / "none")) is None
    empty = stored_index.write_index(frame(spark, {1: "x"}).limit(0), str(tmp_path / "e"))
    assert empty.lexical().postings.count() == 0 and empty.avgdl == 1.0


def test_many_parts_and_hot_terms(spark, texts, tmp_path, monkeypatch):
    """Parts of buckets and hot terms dealt by slot: the blocks of one task for each bucket. What is brought together for a build is a row for each term and batch, not one for each posting."""
    outline = lambda index: sorted(map(tuple, index.table("blocks").select("bucket", "term", "slot", "n", "max_tf", "min_dl", F.array_sort("postings").cast("string")).collect()))
    terms = lambda index: sorted(map(tuple, index.table("terms").drop("segment").collect()))
    one = stored_index.write_index(frame(spark, texts), str(tmp_path / "a"), buckets=2)
    for name, value in (("DEALT", 500), ("HOT", 130), ("HOT_BITS", 2)):
        monkeypatch.setattr(stored_index, name, value)
    found = []
    monkeypatch.setattr(stored_index, "_hot", lambda *a, f=stored_index._hot: found.append(f(*a)) or found[-1])
    many = stored_index.write_index(frame(spark, texts), str(tmp_path / "b"), buckets=2)
    assert found[0] and outline(many) == outline(one) and terms(many) == terms(one)
    assert len({(r.term) for r in one.table("blocks").where("slot > 0").collect()} & set(found[0])) > 0
    runs = stored_index._runs(one.table("forward").coalesce(1), "bigint", [])
    assert runs.count() == one.table("terms").count() < one.table("blocks").agg(F.sum("n")).first()[0] / 5
    sums = {r.term: (r.df, r.tf, r.dl) for r in one.by_term().collect()}
    plain = one.lexical().postings.groupBy("term").agg(F.count("*"), F.sum("tf"), F.sum("dl")).collect()
    assert sums == {r[0]: tuple(r[1:]) for r in plain}


def test_many_changes(spark, texts, tmp_path, monkeypatch):
    """The ids of a million changed chunks are sent to the tasks, so that the forward table is not shuffled; sums by term after a change are those of a rebuild."""
    limits = []
    monkeypatch.setattr(stored_index, "sized", lambda df, rows=200_000: limits.append(rows) or F.broadcast(df))
    index = stored_index.write_index(frame(spark, texts), str(tmp_path / "a"), buckets=2)
    index = stored_index.update_index(index, frame(spark, {3: ""}).select("chunk_id"), frame(spark, {7: "w1 w2", 900: "w3"}))
    assert max(limits) >= 1_000_000
    whole = stored_index.write_index(frame(spark, {i: t for i, t in texts.items() if i != 3} | {7: "w1 w2", 900: "w3"}), str(tmp_path / "b"), buckets=2)
    assert sorted(map(tuple, index.by_term().collect())) == sorted(map(tuple, whole.by_term().collect()))
