"""Repeated bytes against a dictionary of all windows; suffix arrays and common prefixes against sorting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfell.llm import shared, suffix_dedup
from tarnfell.llm.suffix_dedup import LENGTH


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + LENGTH] for d in data for i in range(len(d) - LENGTH + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - LENGTH + 1):
            if seen[d[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = True
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        out.append((len(d), int(gone.sum()), int((np.diff(np.append(False, gone).astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, texts):
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, sha string, n int")
    rows = sorted(suffix_dedup.repeated_bytes(df).collect())
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows]


def letters(rng, n):
    return "".join(rng.choice("abcdefgh éß") for _ in range(n))


def made(seed):
    rng = random.Random(seed)
    passages = [letters(rng, n) for n in (390, 399, 400, 401, 900, 3000)]
    texts = [None, "", "short", "x" * 399, "y" * 400, "y" * 401, "z" * 5000, "ab" * 1500]
    for _ in range(40):
        texts.append(letters(rng, rng.randrange(300)) + "".join(rng.choice(passages)[: rng.choice([380, 450, 9000])] + letters(rng, rng.randrange(3)) for _ in range(rng.randrange(4))) + letters(rng, rng.randrange(300)))
    return texts + [texts[-1]] * 3 + [texts[9] + "!"]


def test_arrays():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 60, 300):
        for alphabet in (1, 2, 5):
            x = np.append(rng.integers(0, alphabet, n), 300).astype(np.uint16)
            order, rank, quads = suffix_dedup.suffix_array(x)
            want = sorted(range(n + 1), key=lambda i: x[i:].tolist())
            assert order.tolist() == want and rank[order].tolist() == list(range(n + 1))
            got = suffix_dedup.common_prefixes(order, rank, quads, np.array([0]), np.array([n + 1]))
            for r in range(1, n + 1):
                a, b = x[order[r - 1] :].tolist(), x[order[r] :].tolist()
                assert got[r] == next(k for k in range(n + 2) if a[: k + 1] != b[: k + 1])


def test_merged():
    a, b, c = (np.array(v, np.int64) for v in ([1, 3, 3, 9], [2, 3, 8], [1, 3, 5]))
    got = suffix_dedup.merged([(a, np.array([0, 1, 2, 0])), (b, np.array([0, 2, 0])), (c, np.array([0, 7, 0]))])
    assert [g.tolist() for g in got] == [[True, False, True, False], [False, True, False], [True, False, False]]


@pytest.mark.parametrize("seed", [1, 2])
def test_windows(spark, seed):
    texts = made(seed)
    assert run(spark, texts) == brute(texts)


def test_anchors_over_several_shards(spark, monkeypatch):
    texts = made(3)
    monkeypatch.setattr(suffix_dedup, "SHARE", 2)
    monkeypatch.setattr(shared, "HOT_ROWS", 4)
    assert run(spark, texts) == brute(texts)


def test_rows(spark):
    """Null ids, repeated rows, an empty table, a text of one letter over several blocks."""
    text = letters(random.Random(4), 600).replace("é", "e").replace("ß", "s")[:500]
    df = spark.createDataFrame([(None, text), (None, text[:450] + "?"), (7, "w" * 1_200_000), (7, "short"), (7, "short")], "doc_id bigint, text string")
    got = sorted(tuple(r)[:4] for r in suffix_dedup.repeated_bytes(df.where("doc_id is null")).select(F.coalesce("doc_id", F.lit(-1)), "n_bytes", "n_removed", "n_spans").collect())
    assert got == [(-1, 451, 450, 1), (-1, 500, 450, 1)]
    assert sorted(tuple(r) for r in suffix_dedup.repeated_bytes(df).where("doc_id = 7").select("n_bytes", "n_removed", "n_spans").collect()) == [(5, 0, 0), (5, 0, 0), (1_200_000, 1_200_000, 1)]
    assert suffix_dedup.repeated_bytes(df.limit(0)).count() == 0
