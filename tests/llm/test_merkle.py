"""The hash tree against one built with hashlib, node by node."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tarnfell.llm import merkle


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(row, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def way(nodes, at):
    """(what is left of nodes in runs of 16, siblings of node `at` by level as (left, right))."""
    sides = []
    while len(nodes) > 1:
        low = at // 16 * 16
        sides.append((nodes[low:at], nodes[at + 1 : low + 16]))
        nodes, at = [sha(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)], at // 16
    return nodes[0], sides


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {s: [x[2] for x in sorted(groups[s], key=lambda x: x[:3])] for s in groups}
    subroots = [way(leaves[s], 0)[0] for s in order]
    out = []
    for i, s in enumerate(order):
        root, above = way(subroots, i)
        for at, (_, _, own, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            now, sides = leaf(r, text), [*way(leaves[s], at)[1], *above]
            for left, right in sides:
                now = sha(*left, now, *right)
            out.append((r["doc_id"], own, subroots[i], root, sha(*(x for left, right in sides for x in (*left, *right))), now, now == root))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], 1, "x") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, place int, k string")
    return sorted((tuple(r) for r in merkle.dataset_manifest(df, merkle.tampered()).collect()), key=repr)


def test_hash_states():
    rng = np.random.default_rng(1)
    children, count = rng.integers(0, 256, (40, 16, 32)).astype(np.uint8), rng.integers(1, 17, 40)
    digests, states = merkle.hashed(children, count)
    texts = [[c.tobytes().hex() for c in children[i, : count[i]]] for i in range(40)]
    assert [d.tobytes().hex() for d in digests] == [sha(*t) for t in texts]
    at = rng.integers(0, count)
    new = children.copy()
    new[np.arange(40), at] = 7
    got = merkle._resumed(np.ascontiguousarray(states[np.arange(40), at].T), new, count, at)
    assert [g.tobytes().hex() for g in got] == [sha(*t[:a], "07" * 32, *t[a + 1 :]) for t, a in zip(texts, at, strict=True)]


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16}, {"a": 17, None: 1, "": 2, "é": 33, "B": 300}, {f"s{i}": i % 3 + 1 for i in range(40)}])
def test_against_hashlib(spark, sizes):
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append({"doc_id": i * 7919 % 100_003, "text": [None, "", "Some Text", "é no capitals", "X" * 3000][i % 5], "lang": [None, "en"][i % 2], "source": source, "n_chars": [None, i][i % 3 > 0]})
            i += 1
    assert run(spark, rows) == brute(rows)


def test_repeated_and_null(spark):
    row = {"doc_id": 5, "text": "Same", "lang": "en", "source": "s", "n_chars": 4}
    rows = [row, row, row | {"text": "Other"}, row | {"doc_id": None}, row | {"doc_id": None, "text": None}]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_many_ranges(spark):
    """A group over several ranges of the order."""
    rows = [{"doc_id": i, "text": f"Text {i}", "lang": "en", "source": "hot" if i % 4 else f"s{i % 3}", "n_chars": i} for i in range(700)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
