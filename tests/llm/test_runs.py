"""Periodic runs against a comparison of every word with the word q places on, for every q."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tarnfell.llm import periodic_runs as pr


def brute(ids):
    x, n, found = np.array(ids), len(ids), {}
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[0], (x[q:] == x[:-q]).astype(int), [0]])
        up = np.diff(same)
        for s, e in zip(np.flatnonzero(up == 1).tolist(), (np.flatnonzero(up == -1) + q).tolist(), strict=True):
            if e - s >= max(6, 4 * q):
                found.setdefault((s, e), q)  # the smallest period comes first
    return sorted((s, e, q) for (s, e), q in found.items())


def expanded(symbol, rules, k):
    return [symbol] if symbol < k else expanded(rules[symbol - k][0], rules, k) + expanded(rules[symbol - k][1], rules, k)


def cases():
    rng = random.Random(5)
    for alphabet in (1, 2, 3, 4, 30):
        for _ in range(120):
            out = []
            for _ in range(rng.randint(0, 5)):
                piece = [rng.randrange(alphabet) for _ in range(rng.randint(1, 9))]
                out += piece * rng.choice([1, 1, 2, 4, 5, 9])
                out += [rng.randrange(alphabet) for _ in range(rng.randint(0, 6))]
            known = {}
            yield [known.setdefault(v, len(known)) for v in out]


def test_runs():
    for ids in cases():
        assert pr.runs_of(ids) == brute(ids), ids


def test_grammar():
    for ids in cases():
        rules, top = pr.grammar(ids)
        k = max(ids, default=-1) + 1
        assert [x for s in top for x in expanded(s, rules, k)] == ids
        pairs = list(zip(top, top[1:], strict=False))
        assert all(a == b for a, b in pairs if pairs.count((a, b)) > 1)  # only a a a is left twice


def test_nothing_left_out():
    """Every run lies in a stretch."""
    for ids in cases():
        if ids:
            words = pr.mix(np.array(ids, np.uint64) + np.uint64(9))
            inside = pr.stretches(np.concatenate([words, words]), np.repeat([0, 1], len(ids)))
            for s, e, _ in brute(ids):
                for shift in (0, len(ids)):
                    assert any(a <= s + shift and e + shift <= b for a, b in inside)


def answer(doc_id, text, planted):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if planted and doc_id is not None:
        h, n = zlib.crc32(str(doc_id).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    known = {}
    runs = brute([known.setdefault(x, len(known)) for x in w])
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    first = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in sorted(runs, key=lambda r: (r[0], r[2])))
    return (doc_id, len(runs), *first, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


COLUMNS = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()


def test_query(spark, folder):
    from tarnfell.llm.queries import QUERIES

    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op13_periodic_runs"](spark, folder).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(answer(r.doc_id, r.text, True) for r in rows)
    assert sum(r.n_runs > 0 for r in got) > len(rows) // 20


@pytest.mark.parametrize("planted", [False, True])
def test_edges(spark, planted):
    long = " ".join(["zero"] * 60_000)
    texts = [None, "", " \n\t ", "a", "a a a a a", "a a a a a a", "x " + "a b " * 4 + "a y", "a b " * 6, "A a A a A a A a", "no end " * 300 + "of it " * 200, long]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "a"), (None, "b b b b b b"), (10**12, "c d " * 9)]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id bigint, text string, n_runs int, start string")
    got = pr.periodic_runs(df, planted).select(*COLUMNS).collect()
    want = [answer(i, t, planted) for i, t in rows if t is not long]
    assert sorted((tuple(r) for r in got if r.doc_id != 10), key=repr) == sorted(want, key=repr)
    whole = next(r for r in got if r.doc_id == 10)
    if not planted:
        assert (whole.n_runs, whole.length, whole.period) == (1, 60_000, 1) and whole.collapsed_sha256 == hashlib.sha256(b"zero").hexdigest()
    assert pr.periodic_runs(df.limit(0), planted).count() == 0
