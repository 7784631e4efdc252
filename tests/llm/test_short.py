"""Short test items, passages of one word again and again, ids that are no numbers."""

import time

from tarnfell.llm.decontamination import contaminated, without_benchmark
from tarnfell.llm.near_dedup import near_duplicates
from tarnfell.llm.substring_dedup import Passages
from tarnfell.llm.suffix_dedup import repeated_bytes


def test_short_items(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (2, "Yes."), (3, "two words"), (4, "")], "item_id int, text string")
    texts = {1: "so alpha beta gamma, delta EPSILON it was", 2: "yes", 3: "oh yes two, words", 4: "two other words", 5: "alpha beta gamma delta", 6: None, 7: "yes yes"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    got = sorted((r.doc_id, r.item_id, r.doc_word, r.n_words) for r in contaminated(docs, items).collect())
    assert got == [(1, 1, 1, 5), (2, 2, 0, 1), (3, 2, 1, 1), (3, 3, 2, 2), (7, 2, 0, 1), (7, 2, 1, 1)]
    assert sorted(r.doc_id for r in without_benchmark(docs, items).collect()) == [1, 3, 4, 5, 6, 7]
    assert sorted(r.doc_id for r in without_benchmark(docs, items, shortest=2).collect()) == [4, 5, 6, 7]


def test_one_word_again_and_again():
    for text in ("0", "0 1 2", " ".join(f"w{i}" for i in range(30))):
        words = (text + " ") * (60_000 // len(text.split()))
        passages = Passages([words.strip()])
        began = time.perf_counter()
        assert passages.stretches(words.strip()) == [(0, len(words.split()))]
        assert time.perf_counter() - began < 2
    assert Passages(["0 " * 99 + "0"]).stretches("1 " + "0 " * 49 + "2 " + "0 " * 60 + "3") == [(51, 111)]


def test_text_ids(spark):
    prose = " ".join(f"w{i * 7919 % 1013}" for i in range(200))
    other = " ".join(f"v{i * 7919 % 1013}" for i in range(200))
    texts = {"b": prose, "a": prose + " tail", "c": prose, "d": "head " + prose, "x": other, "y": "quite another text of a few words", "z": "one " + other}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    got = {r.doc_id: (r.representative, r.class_id, r.kept) for r in near_duplicates(docs).collect()}
    assert got == {"a": ("a", "a", True), "b": ("b", "a", False), "c": ("b", "a", False), "d": ("d", "a", False), "x": ("x", "x", True), "y": ("y", "y", True), "z": ("z", "x", False)}
    removed = {r.doc_id: (r.n_bytes - r.n_removed) for r in repeated_bytes(docs).collect()}
    assert removed == {"a": 5, "b": 0, "c": 0, "d": 5, "x": 0, "y": 33, "z": 4}
