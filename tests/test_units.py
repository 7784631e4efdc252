"""Rules with a boundary, on a few rows each."""

import uuid
from collections import deque

import pytest
from pyspark.sql import functions as F

from tarnfell.functions import names, text
from tarnfell.operators import changes, chunks, lexical, ranking, splitting, verify
from tarnfell.operators.usage import decide
from tarnfell.sources import files, stores


def test_clean_names(spark):
    """One case for each rule: folders of both kinds go, signs that file systems refuse become underscores, other scripts stay; hidden and blank names are none."""
    kept = {"plans/2024/budget.xlsx": "budget.xlsx", "D:\\work\\notes final.md": "notes final.md", "mixed/up\\down.json": "down.json", "what*is:this.log": "what_is_this.log", "résumé Ελλάδα.html": "résumé Ελλάδα.html", "no_suffix": "no_suffix", "folder/": "folder", "\ta.txt\n": "a.txt"}
    none = ["\t \u00a0", "a/b/.gitignore", ".", "x\\..", "/"]
    rows = [*kept.items(), *((n, None) for n in none)]
    got = spark.createDataFrame(rows, "raw string, want string").withColumn("got", names.clean_name("raw")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    long = spark.createDataFrame([("ü" * 400 + ".tables.csv",)], "raw string").select(names.clean_name("raw").alias("n")).first().n
    assert len(long) <= 150 and long.endswith(".csv")


def test_admission(spark):
    rows = [("a.exe", 5, "unsupported"), ("none", 5, "unsupported"), (".env", 5, "bad_name"), ("a.txt", 0, "empty"), ("a.txt", 104857601, "too_large"), ("a.txt", 1, None)]
    got = files.admit_files(spark.createDataFrame(rows, "name string, size bigint, want string")).collect()
    assert [r.reject_reason for r in got] == [r.want for r in got]


def test_limiter():
    held = deque()
    got = decide([0, 1, 2, 3, 310_000], held, 3, 0.3)
    assert [a for a, _ in got] == [True, True, True, False, True]
    assert got[3][1] == pytest.approx(0.3 - 3e-6)


def test_uuid5(spark):
    name = "abc|0|1|é"
    assert spark.range(1).select(text.uuid5(F.lit(name)).alias("u")).first().u == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_lines_and_tokens(spark):
    cases = ["", "a", "a\n", "a\r\nb", "a\x0bb\u2028c", "\n\n"]
    got = spark.createDataFrame([(c,) for c in cases], "t string").select(F.size(text.lines("t")).alias("n")).collect()
    assert [r.n for r in got] == [len(c.splitlines()) for c in cases]
    t = spark.createDataFrame([("Q3_report.xlsx _ a_",)], "t string").select(text.tokens("t").alias("t")).first().t
    assert t == ["q3_report", "q3", "report", "xlsx", "_", "a_"]


def test_bm25_phrase(spark):
    c = spark.createDataFrame([(1, "red fox"), (2, "fox red"), (3, "blue")], "chunk_id bigint, text string")
    q = spark.createDataFrame([(1, "Fox Red"), (2, "the what")], "question_id bigint, question string")
    got = lexical.keyword_search(q, c, k=2).collect()
    assert [(r.chunk_id, r.rank) for r in sorted(got, key=lambda r: r.rank)] == [(2, 1), (1, 2)]
    assert got[0].score - got[1].score == pytest.approx(1.0) or got[1].score - got[0].score == pytest.approx(1.0)


def test_rrf_tie(spark):
    h = "question_id bigint, chunk_id bigint, score double, rank int"
    got = ranking.fuse_rrf(spark.createDataFrame([(1, 5, 1.0, 1)], h), spark.createDataFrame([(1, 6, 9.0, 1)], h)).collect()
    assert [(r.chunk_id, r.rank) for r in got] == [(5, 1), (6, 2)]


def test_judgement(spark):
    rows = [('{"relevant": true, "faithful": true, "complete": true, "verdict": "x", "issues": "one"}', "ok [Context 9]", 2), ("{", "", 2), ("{}", "", 0)]
    got = [r.evaluation for r in verify.normalize_judgement(spark.createDataFrame(rows, "judgement string, answer string, n_blocks int")).collect()]
    assert (got[0].verdict, got[0].faithful, got[0].issues) == ("FAIL", False, ["one", "Cited blocks do not exist: [Context 9]."])
    assert got[1].evaluation_error and not got[2].evaluation_error


def test_splitters_lose_nothing():
    count = splitting.count_default
    long = "\n".join(f"{i},value {i}" for i in range(300))
    pieces = splitting.split_lines(long, 40, count, header="id,name")
    assert all(p.startswith("id,name\n") and count(p) <= 40 for p in pieces)
    assert [x for p in pieces for x in p.split("\n")[1:]] == long.split("\n")
    sections = splitting.split_markdown("intro\n# A\ntext\n```\n# no\n```\n## B\nmore\n# C\nend")
    assert [p for _, p in sections] == ["", "", "A", ""]
    assert all(count(p) <= 30 for p in splitting.split_sentences("word " * 200 + "%" * 100, 30, 5, count))
    code = "\n".join(f"line {i}" for i in range(200))
    assert {x for p in splitting.split_code(code, 40, 2000) for x in p.split("\n")} == set(code.split("\n"))


def test_chunks_do_not_depend_on_partitions(spark):
    rows = [(f"d{i}", 0, f"# T{i}\n" + "Sentence one. " * 300, "markdown" if i % 2 else "text", None) for i in range(6)]
    df = spark.createDataFrame(rows, "document_id string, part_index int, text string, document_type string, language string")
    ids = [sorted(r.chunk_id for r in chunks.chunk_documents(df.repartition(n)).collect()) for n in (1, 5)]
    assert ids[0] == ids[1] and len(set(ids[0])) == len(ids[0])


def test_manifest_round_trip(spark, tmp_path):
    own = [("a\\b.txt", "id", "h", ".txt", 1, 1, "indexed", 2, None)]
    stores.write_manifest(spark.createDataFrame(own, stores.MANIFEST_SCHEMA), str(tmp_path), 1)
    assert [r.relative_path for r in stores.read_manifest(spark, str(tmp_path)).collect()] == ["a/b.txt"]
    # a reader between snapshot and pointer, and one beside an unfinished pointer, see the version before
    spark.createDataFrame([("new.txt", "n", "h", ".txt", 1, 1, "indexed", 2, None)], stores.MANIFEST_SCHEMA).write.parquet(str(tmp_path / "v=2"))
    (tmp_path / "published" / "n=2" / "_temporary").mkdir(parents=True)
    assert stores.latest_version(spark, str(tmp_path)) == 1
    assert [r.relative_path for r in stores.read_manifest(spark, str(tmp_path)).collect()] == ["a/b.txt"]
    stores.write_manifest(spark.createDataFrame([*own, ("a/b.txt", "x", "h", "", 1, 1, "indexed", 1, None)], stores.MANIFEST_SCHEMA), str(tmp_path), 2)
    assert stores.read_manifest(spark, str(tmp_path)).count() == 0
    assert stores.read_manifest(spark, str(tmp_path / "none")).count() == 0


def test_loaders(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.txt").write_bytes(b"ok \xff bytes")
    (tmp_path / ".hidden").write_text("no")
    (tmp_path / "blank.txt").write_text(" ")
    found = files.discover_files(spark, str(tmp_path))
    assert sorted(r.relative_path for r in found.select("relative_path").collect()) == ["blank.txt", "s/a.txt"]
    assert [r.text for r in files.load_text(found).collect()] == ["ok  bytes"]
    t = spark.createDataFrame([('{"b":1,"a":[2]}',), ("{bad",)], "text string")
    assert [r.text for r in files.load_json(t).collect()] == ['{\n  "b": 1,\n  "a": [\n    2\n  ]\n}', "{bad"]
    d = spark.createDataFrame([('x,"a,\nb",c\n1,2,3',)], "text string")
    assert files.load_delimited(d).first().text == "x | a,\nb | c\n1 | 2 | 3"
    assert files.html_parts("<body>x<script>no</script><section>a <b>b</b></section><section> </section></body>", "section") == ["a b"]
    assert changes.MAX_ATTEMPTS == 3


def test_splitters():
    """Exact pieces of small texts, worked out by hand from the rules."""
    from tarnfell.operators.splitting import count_default, enforce_limit, merge_small, split_code, split_lines, split_markdown, split_sentences

    text = "intro\n# One\na\n## Two\nb\n```\n# no\n```\n# Three\nc"
    assert split_markdown(text) == [("intro", ""), ("# One\na", ""), ("## Two\nb\n```\n# no\n```", "One"), ("# Three\nc", "")]
    assert merge_small([("a b", ""), ("c d", "x"), ("e " * 70, "y")], 10, count_default, 3) == [("a b\n\nc d", ""), ("e " * 70, "y")]
    assert split_sentences("One two. Three four. Five six. Seven.", 6, 3, count_default) == ["One two. Three four.", "Three four. Five six.", "Five six. Seven."]
    assert split_sentences("a b c d e", 2, 0, count_default) == ["a b", "c", "d e"]
    rows = [f"{c} {c} {c} {c} {c}" for c in "pqrst"]
    assert split_lines("\n".join(rows), 20, count_default, "id | v") == ["id | v\n" + "\n".join(rows[i : i + 2]) for i in (0, 2, 4)]
    assert split_lines("\n".join(rows), 20, count_default, "id | v", 1) == ["id | v\n" + "\n".join(rows[i : i + 2]) for i in range(4)]
    assert split_lines("\n".join(rows[:2]), 20, count_default, "a header of far more than half of all tokens there") == ["\n".join(rows[:2])]
    assert split_code("def a():\n x\n\ndef b():\n y\n z", 4, 1000) == ["def a():\n x\n", "\ndef b():\n y\n z"]
    assert enforce_limit([(" ", None), ("a b c d e", "p")], 2, 0, count_default) == [("a b", "p"), ("c", "p"), ("d e", "p")]


def test_html_parts():
    from tarnfell.sources.files import html_parts

    assert html_parts("<html><body><section>a <b>c</b></section><section> </section><section>d</section></body></html>", "section") == ["a c", "d"]
    assert html_parts("<body><script>x</script>hi <p>there</p></body>", "section") == ["hi there"]
    assert html_parts(None, "section") == []


def test_prompts_and_code_hints(spark):
    from tarnfell.operators import profiling, verify

    row = spark.createDataFrame([('why """x"""', "[1] block", "because", "check 5")], "question string, blocks string, answer string, hints string")
    answer, judge = (verify.build_prompts(row, kind).first().prompt.split("\n\n")[1:] for kind in ("answer", "judge"))
    assert answer == ["QUESTION:\nwhy '''x'''", "[BEGIN CONTEXT]\n[1] block\n[END CONTEXT]"]
    assert judge == ["QUESTION:\nwhy '''x'''", "ANSWER:\nbecause", "HINTS:\ncheck 5", "[BEGIN CONTEXT]\n[1] block\n[END CONTEXT]"]
    texts = ["def run(x)", "def the thing", "import os", "import the goods", "a => b", "x := 1", "plain words", "from a.b import c", "#!/bin/sh"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", F.col("text").rlike(profiling.CODE_HINT).alias("code")).collect()
    assert [r.code for r in sorted(got)] == [True, False, True, False, True, True, False, True, True]
    assert [r.code for r in spark.createDataFrame([("drop table x",), ("select * from",), ("update from",), ("select tablex",)], "t string").select(F.col("t").rlike(profiling.SQL_HINT).alias("code")).collect()] == [True, False, True, False]
