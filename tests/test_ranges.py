"""Ranks, neighbours, samples and names in groups that lie over several tasks."""

import random

import pytest
from pyspark.sql import functions as F

from tarnfell.operators import chunks, ranges, sampling


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def rows(spark):
    rng = random.Random(1)
    out = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), i, f"t{i}") for i in rng.sample(range(10_000), 600)] + [("one", 5, "x"), ("last", 1, "y")]
    return spark.createDataFrame(out, "g string, i int, v string"), out


def test_ranks(spark, many_ranges):
    df, out = rows(spark)
    placed, groups = ranges.ranked(df, ["g"], ["i"])
    got = {(r.g, r.i): r.place for r in placed.collect()}
    want = {(g, i): sorted(j for h, j, _ in out if h == g).index(i) for g, i, _ in out}
    assert got == want
    assert {r.g: r.length for r in groups.collect()} == {g: sum(h == g for h, _, _ in out) for g, _, _ in out}
    assert ranges.in_ranges(df.where("g = 'hot'"), ["g", "i"], "x").select("_range").distinct().count() > 4


def test_neighbours(spark, many_ranges):
    df, out = rows(spark)
    got = {(r.g, r.i): (r.before, r.after) for r in ranges.neighbours(df, ["g"], ["i"], "v").collect()}
    for g in {g for g, _, _ in out}:
        mine = sorted((i, v) for h, i, v in out if h == g)
        for n, (i, _) in enumerate(mine):
            assert got[g, i] == (mine[n - 1][1] if n else None, mine[n + 1][1] if n + 1 < len(mine) else None)


def test_links(spark, many_ranges):
    df = spark.range(500).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.when(F.col("id") < 300, "book").otherwise("note").alias("document_id"), F.lit(0).alias("part_index"), F.col("id").alias("chunk_index"), F.lit("text").alias("text"))
    got = {r.chunk_id: (r.prev_chunk_id, r.next_chunk_id) for r in chunks.link_neighbours(df).collect()}
    assert got == {f"c{i}": (f"c{i - 1}" if i not in (0, 300) else None, f"c{i + 1}" if i not in (299, 499) else None) for i in range(500)}
    assert "text" not in chunks.neighbour_links(df).columns


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1000])
def test_samples(spark, many_ranges, n):
    df, out = rows(spark)
    got = {}
    for r in sampling.even_sample(df, ["g"], ["i"], n).collect():
        got.setdefault(r.g, {})[r.place] = r.i
    for g in {g for g, _, _ in out}:
        mine = sorted(i for h, i, _ in out if h == g)
        m = len(mine)
        places = [] if n == 0 else range(m) if m <= n else [m // 2] if n == 1 else [round(k * (m - 1) / (n - 1)) for k in range(n)]
        assert got.get(g, {}) == {p: mine[p] for p in places}


def test_names_with_a_common_word(spark):
    """Ten thousand files begin with the same word; a question that says it meets none of them but those it names."""
    files = spark.range(10_000).select(F.concat(F.lit("in/report "), "id", F.lit(".md")).alias("relative_path"), F.col("id").cast("string").alias("document_id"), F.lit("indexed").alias("status"))
    files = files.unionByName(spark.createDataFrame([("x/report.txt", "r1", None), ("y/report.txt", "r2", "indexed"), ("z/report.txt", "r3", "failed"), ("a/ab.md", "s", None), ("", "e", None)], "relative_path string, document_id string, status string"))
    asked = spark.createDataFrame([(1, "what does report 77 say?"), (2, "the REPORT txt, please"), (3, "report report"), (4, "ab or ab.md"), (5, None), (6, "report 12 and report 4711.md")], "question_id int, question string")
    got = {}
    for r in sampling.documents_mentioned(asked, files, least=100).collect():
        got.setdefault(r.question_id, set()).add(r.document_id)
    assert got == {1: {"77"} | {"r1", "r2"}, 2: {"r1", "r2"}, 3: {"r1", "r2"}, 4: {"s"}, 6: {"12", "4711", "r1", "r2"}}
