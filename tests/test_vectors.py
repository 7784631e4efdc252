"""Embedding by a user's function and exact nearest vectors."""

import numpy as np
import pytest

from tarnfell.operators.vectors import embed, vector_search


def test_embed(spark):
    def lengths(texts):
        return np.array([[len(t), 1.0] for t in texts])

    rows = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "chunk_id bigint, embed_text string")
    got = {r.chunk_id: list(r.embedding) for r in embed(rows, lengths, dimensions=2, batch=2).collect()}
    assert got == {1: [3.0, 1.0], 2: [0.0, 1.0], 3: [0.0, 1.0]}
    assert embed(rows.limit(0), lengths).count() == 0
    for wrong, width in ((lengths, 3), (lambda t: lengths(t)[:-1], 2)):
        with pytest.raises(Exception, match="the embedding function gave"):
            embed(rows, wrong, dimensions=width).collect()


@pytest.mark.parametrize("size", [1, 3000, 2 << 20])
def test_nearest(spark, size):
    rng = np.random.default_rng(size)
    x = rng.normal(size=(300, 8)) * np.array([5, 4, 1, 1, 1, 1, 1, 1])
    x[50:60] = x[40:50] * 3  # equal directions: ties by id
    x[60] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0]), (902, [float("nan")] * 8), (903, [None] + [1.0] * 7), (904, []), (905, [2.0])]
    df = spark.createDataFrame(rows, "chunk_id bigint, embedding array<double>").repartition(5)
    asked = df.where("chunk_id % 4 = 0 or chunk_id > 899").withColumnRenamed("chunk_id", "question_id")
    got = {}
    for r in vector_search(asked, df, 7, size).collect():
        got.setdefault(r.question_id, []).append((r.rank, r.chunk_id, r.score))
    u = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    want = {}
    for q in (i for i in u if i % 4 == 0 or i > 899):
        best = sorted((-round(float(u[q] @ u[i]), 9), i) for i in u if len(u[i]) == len(u[q]))[:7]
        want[q] = [(n + 1, i) for n, (_, i) in enumerate(best)]
    assert {q: [h[:2] for h in sorted(hits)] for q, hits in got.items()} == want


def test_one_pass(spark):
    """However many questions there are, the vectors stand in the plan once."""
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5000)], "chunk_id bigint, embedding array<float>")
    plan = vector_search(df.withColumnRenamed("chunk_id", "question_id"), df, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 0 and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    assert vector_search(df.limit(0).withColumnRenamed("chunk_id", "question_id"), df, 3).count() == 0
