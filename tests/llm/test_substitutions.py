"""Decontamination against brute force: items with changed words at every place, and every stretch of every diagonal of random texts."""

import itertools
import random

from tarnfell.llm.decontamination import GAPS, LEAST, MISS_COST, RUN, contaminated, without_benchmark


def test_changed_words(spark):
    items, docs = [], []
    for n in (12, 13, 14, 15, 16, 17, 18, 20):
        words = [f"item{n}word{i}" for i in range(n)]
        items.append((n, " ".join(words)))
        for places in [(), *itertools.combinations(range(n), 1), *itertools.combinations(range(n), 2)]:
            changed = ["changed" if i in places else w for i, w in enumerate(words)]
            docs.append((len(docs), n, n - len(places), " ".join([f"before{i}" for i in range(9)] + changed + [f"after{i}" for i in range(9)])))
    frame = spark.createDataFrame(docs, "doc_id bigint, item bigint, equal bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: (r.item_id, r.n_equal) for r in contaminated(frame, bench).collect()}
    assert got == {d: (n, equal) for d, n, equal, _ in docs}
    assert without_benchmark(frame, bench).count() == 0


def test_every_stretch(spark):
    rng = random.Random(7)
    docs = [[rng.choice("aab") for _ in range(rng.randint(0, 60))] for _ in range(25)]
    items = [[rng.choice("aaab") for _ in range(n)] for n in (8, 11, 12, 13, 15, 16, 24, 40)]
    want = set()
    for (d, own), (k, theirs) in itertools.product(enumerate(docs), enumerate(items)):
        need = min(13, (5 * len(theirs) + 5) // 6) if len(theirs) > 11 else len(theirs)
        for diagonal in range(-len(theirs), len(own)):
            same = [own[i + diagonal] == w for i, w in enumerate(theirs) if 0 <= i + diagonal < len(own)]
            sums = [sum(same[:i]) for i in range(len(same) + 1)]
            best = max((sums[j] - sums[i] for i, j in itertools.combinations(range(len(sums)), 2) if sums[j] - sums[i] >= 4 * (j - i - sums[j] + sums[i])), default=0)
            if best >= need:
                want.add((d, k, diagonal, best))
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(items)], "item_id bigint, text string")
    assert want
    assert {(r.doc_id, r.item_id, r.doc_word - r.item_word, r.n_equal) for r in contaminated(frame, bench).collect()} == want


def test_masks_are_lossless():
    """No row of equal and substituted words makes an overlap without a seed. Longer ones can be halved into two of which one is an overlap."""
    masks = [(g + RUN, ((1 << RUN) - 1) | (((1 << RUN) - 1) << g)) for g in GAPS]
    states = {(0, 0, 0, 0)}  # last words as bits, words, equal, substituted
    while states:
        following = set()
        for bits, n, equal, other in states:
            for bit in (0, 1):
                b, e, o = ((bits << 1) | bit) & ((1 << 18) - 1), equal + bit, other + 1 - bit
                if e > 2 * LEAST or o > 2 * LEAST // MISS_COST or any(n + 1 >= size and b & m == m for size, m in masks):
                    continue
                assert e < LEAST or e < MISS_COST * o
                following.add((b, min(n + 1, 18), e, o))
        states = following


def test_short_items(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "Alpha beta"), (3, ""), (4, None), (5, "gamma")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "so one two three four five six seven eight, nine TEN. so"), (2, "one two three four five six seven eight nine eleven"), (3, "alpha, BETA!"), (4, "alpha beta alpha"), (5, "gamma"), (None, "gamma"), (5, "gamma")], "doc_id bigint, text string")
    assert sorted(((r.doc_id or 0, r.item_id, r.n_equal) for r in contaminated(docs, bench).collect())) == [(0, 5, 1), (1, 1, 10), (3, 2, 2), (4, 2, 2), (5, 5, 1), (5, 5, 1)]
    assert sorted(r.doc_id for r in without_benchmark(docs, bench).collect()) == [2, 4]


def test_shuffled_seeds(spark, monkeypatch):
    """The join by shuffle, with salts, gives what the broadcast gives."""
    from tarnfell.llm import decontamination, shared

    texts = [" ".join(f"w{i}" for i in range(k, k + 30)) for k in range(0, 60, 7)]
    docs = spark.createDataFrame([(i, texts[i % 3] if i % 2 else texts[i % 9]) for i in range(40)], "doc_id bigint, text string")
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    want = sorted(contaminated(docs, bench).collect())
    monkeypatch.setattr(decontamination, "BROADCAST", 0)
    monkeypatch.setattr(shared, "HOT_ROWS", 5)
    assert want and sorted(contaminated(docs, bench).collect()) == want
