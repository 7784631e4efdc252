"""Queries over files against their SQL where documents are blank, null, repeated, of no source, or hold odd blanks and line ends."""

import duckdb
import pytest

from tarnfell.operators import splitting
from tarnfell.plans import corpus
from tarnfell.plans.registry import ORACLE_SQL, QUERIES
from tarnfell.sources import files as loaders

ODD = ["", " ", None, "\t\n", "x\r# no heading\r\ny\x85## none\u2028### none", "a|b\r\n---|---\r\nc", "a\r2.1 Part\n3.4.5 Part", "# \x0bx", "a\xa0b. " * 900, "Text. " * 900]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Each text in files of every kind; two files of no source, and two that are repeated."""
    rows = [(i * 56 + k, t, f"src{k % 3}") for i, t in enumerate(ODD) for k in range(56)]
    rows += [(9001, "no source", None), (9002, "no source. " * 900, None), *[r for r in rows if r[0] in (6 * 56 + 1, 9 * 56 + 1)]]
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "'en' AS lang", "length(text) AS n_chars").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["chunk_limits", "structure_profile"])
def test_odd_documents(spark, odd, name):
    df = QUERIES[name](spark, odd)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{odd}/documents.parquet/*.parquet')")
    want = con.execute(ORACLE_SQL[name])
    got = df.select([c[0] for c in want.description]).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want.fetchall()))


def test_counters_agree(spark):
    from tarnfell.functions.text import count_tokens

    texts = ["a\xa0b", "a\x0bb\x0cc\rd", "a\x1cb\x85c\u2028d\u3000e", "snake_case 1,2"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", count_tokens("text").alias("n")).collect()
    assert [splitting.count_default(r.text) for r in rows] == [r.n for r in rows] == [3, 4, 9, 4]


@pytest.mark.parametrize("direct", [True, False])
def test_files_of_documents(spark, folder, tmp_path, monkeypatch, direct):
    """Many small files: few folders to list, few tasks to read them, the same rows where only Spark reaches the store."""
    monkeypatch.setattr(loaders, "direct", lambda path: direct)
    monkeypatch.setattr(corpus.given, "new_folder", lambda spark, name: f"file://{tmp_path}/{name}")
    monkeypatch.setattr(loaders, "TASKS", 2)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id", "octet_length(text) + 1 AS size")
        df = QUERIES["files_discovered"](spark, folder)
        assert df.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, docs.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    if direct:
        folders = [p for p in tmp_path.rglob("*") if p.is_dir()]
        assert len(folders) < 10 and len(list(tmp_path.rglob(".old/*/*.txt"))) == docs.where("doc_id % 10 = 0").count()


def test_no_files(spark, tmp_path):
    loaders.write_files(spark.createDataFrame([], "relative_path string, content binary"), f"file://{tmp_path}/none")
    assert loaders.discover_files(spark, f"file://{tmp_path}/none").count() == 0


def test_loading_small_files(spark, folder, tmp_path, monkeypatch):
    """Contents of many small files are read by few tasks, whatever Spark counts for opening a file."""
    monkeypatch.setattr(loaders, "TASKS", 2)
    monkeypatch.setattr(corpus.given, "new_folder", lambda spark, name: f"file://{tmp_path}/{name}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        df = QUERIES["files_loaded"](spark, folder)
        assert df.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism and df.count() == 200
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
