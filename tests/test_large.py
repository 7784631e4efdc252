"""Large parts cut by several tasks: the same chunks as by one."""

import random

import numpy as np
import pytest

from tarnfell.operators import chunks, splitting


def test_piece_ends():
    rng = np.random.default_rng(2)
    for _ in range(50):
        costs, room = rng.integers(1, 30, rng.integers(0, 60)), 25
        got = chunks.piece_ends(costs, room)
        for i in range(len(costs)):
            end, total = i, 0
            while end < len(costs) and costs[end] <= room and total + costs[end] <= room:
                total += costs[end]
                end += 1
            assert got[i] == max(end, i + 1)


@pytest.mark.parametrize("partitions", [1, 8])
def test_same_chunks(spark, monkeypatch, partitions):
    monkeypatch.setattr(chunks, "RANGE", 700)
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(1000)}"
    log = "\n".join(" ".join(word() for _ in range(rng.choice([0, 1, 3, 9, 30, 600 if rng.random() < 0.02 else 5]))) for _ in range(4000))
    table = "id,name,value\n" + "\n".join(f"{i},{word()},{rng.random()}" for i in range(3000))
    rows = [("d1", 0, log, "json", None), ("d1", 1, table, "tabular", None), ("d2", 0, "same line\n" * 2500, "json", None), ("d3", 0, "a,b\n1,2", "tabular", None), ("d4", 0, "Text. " * 3000, "text", None), ("d5", 0, "\n \n" * 900 + "x", "json", None)]
    parts = spark.createDataFrame(rows, "document_id string, part_index int, text string, document_type string, language string").repartition(partitions)
    columns = ["document_id", "part_index", "chunk_index", "chunk_total", "chunk_strategy", "chunk_id", "text", "prev_chunk_id", "next_chunk_id", "error"]
    of = lambda df: sorted(map(tuple, df.select(columns).collect()))
    one, many = chunks.chunk_documents(parts), chunks.chunk_documents(parts, large=5000)
    assert one.columns == many.columns
    want = of(one)
    assert of(many) == want and len(want) > 100
    assert all(splitting.count_default(r[6]) <= chunks.budgets()[1] for r in want)
