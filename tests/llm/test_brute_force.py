"""Whole operators against plain Python on the small test tables."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tarnfell.llm import near_dedup, queries, token_counts, vector_dedup
from tarnfell.llm.packing import plan


@pytest.fixture(scope="module")
def texts(spark, folder):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def rows(spark, folder, name, key="doc_id"):
    return {r[key]: r for r in queries.QUERIES[name](spark, folder).collect()}


def bag(text):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", text)]
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else collections.Counter([tuple(w)] if w else [])


def jp(x, y):
    """By the definition, but each distinct ratio of counts is summed once."""
    every, ratios = x.keys() | y.keys(), collections.defaultdict(float)
    for d in x.keys() & y.keys():
        ratios[x[d] / y[d]] += x[d]
    return sum(v / sum(max(x[e], y[e] * r) for e in every) for r, v in ratios.items())


def test_near_duplicates(spark, folder, texts):
    bags = {i: bag(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b in itertools.combinations(sorted(texts), 2):
        common = sum((bags[a] & bags[b]).values())
        if common and common >= 0.5 * max(1, min(sum(bags[a].values()), sum(bags[b].values()))) and jp(bags[a], bags[b]) >= 0.8 and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = rows(spark, folder, "op2_near_duplicates")
    assert {i: r.class_id for i, r in got.items()} == {i: find(i) for i in texts}


def test_probability_jaccard():
    """Against the definition, term by term."""
    slow = lambda x, y: sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())
    rng = np.random.default_rng(1)
    for _ in range(30):
        x, y = (collections.Counter(rng.integers(0, 12, 20).tolist()) for _ in range(2))
        one = lambda c: (np.array(sorted(c)), np.array([c[k] for k in sorted(c)]))
        assert abs(near_dedup.probability_jaccard(*one(x), *one(y)) - slow(x, y)) < 1e-12


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    x, y = (collections.Counter((rng.integers(0, 60, 150) + s).tolist()) for s in (0, 12))
    size = 2048
    s = [near_dedup.signatures(np.zeros(len(c), np.int64), np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)]), 1, size)[0] for c in (x, y)]
    assert abs((s[0] == s[1]).mean() - jp(x, y)) < 0.05


def test_substring_dedup(spark, folder, texts):
    first, want = {}, {}
    for i in sorted(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[i])
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) < i:
                gone[k : k + 50] = [True] * 50
        want[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    got = rows(spark, folder, "op6_substring_dedup")
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == want


def test_personal_data(spark, folder, texts):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def passes(kind, value):
        d = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    got = rows(spark, folder, "op3_personal_data")
    for i, t in texts.items():
        spans = ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in patterns.items() for m in re.finditer(p, t) if passes(k, m.group()))
        assert got[i].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert got[i].spans.startswith(spans)


def test_contamination(spark, folder, texts):
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    inside = {i for i, t in texts.items() if any(x in t for x in items)}
    found = {r.doc_id for r in queries.QUERIES["op4_decontamination"](spark, folder).collect()}
    assert inside <= found


def test_chat(spark, folder):
    turns = collections.defaultdict(list)
    for r in sorted(spark.read.parquet(f"{folder}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        turns[r.conv_id].append((r.role, r.text or ""))
    got = rows(spark, folder, "op1_chat_windows", "conv_id")
    assert set(got) == {*turns, -1}
    for c, t in turns.items():
        loss = "".join(x for r, x in t if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_token_counts(spark, folder, texts):
    k = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = rows(spark, folder, "op7_token_counts")
    for i, t in texts.items():
        assert got[i].n_tokens == len(k.encode(t, add_special_tokens=False).ids) and got[i].n_bytes == len(t.encode())


@pytest.mark.parametrize("text", ["word " * 4000, "x" * 9000, "It's a <|endoftext|> test, é\u0301 ΟΔΥΣΣΕΥΣ 123\u00a0ß\x1c!? " * 150, "\n".join("a b" * 40 for _ in range(60)), "漢字かな" * 900])
def test_resynchronisation(text):
    path = public_tokenizers.path("word_bpe_49k.json")
    k = Tokenizer.from_file(path)
    for chunk, overlap in ((1000, 40), (777, 8)):
        counter = token_counts.Counter(path, chunk, overlap)
        assert counter.many([text, text[:500]])[0][0] == len(k.encode(text, add_special_tokens=False).ids)
        assert counter.many([text[:500]])[0][0] == len(k.encode(text[:500], add_special_tokens=False).ids)


def test_packing(spark, folder, texts):
    k = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = collections.defaultdict(list)
    for r in queries.QUERIES["op8_packing"](spark, folder).collect():
        got[r.doc_id].append(r)
    total = 0
    for i, t in texts.items():
        ids = np.array([*k.encode(t, add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        assert sum(r.length for r in got[i]) == len(ids)
        for r in got[i]:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert len({r.sequence_id for g in got.values() for r in g}) <= -(-total // 2048) + 2


def test_plan_uses_all():
    rng = np.random.default_rng(3)
    counts = collections.Counter(rng.integers(1, 65, 5000).tolist())
    used = collections.Counter()
    for pattern, n in plan(counts, 64):
        assert n > 0 and sum(a * m for a, m in pattern) <= 64
        for a, m in pattern:
            used[a] += n * m
    assert used == counts


def test_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 24))
    x[100:200] = x[:100] + rng.normal(size=(100, 24)) * rng.uniform(0.05, 0.6, (100, 1))
    x[200:230] = x[5]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    got = {r.vec_id: r for r in vector_dedup.linked_vectors(df).collect()}
    assert [got[i].n_links for i in range(300)] == link.sum(1).tolist()
    low = np.arange(300)
    for _ in range(300):
        low = np.minimum(low, np.where(link, low[None, :], 300).min(1))
    assert [got[i].component_id for i in range(300)] == low.tolist()


def ranks(scores, labels):
    """Area under the curve: the share of pairs of a positive and a negative in the right order, ties half."""
    good, bad = (np.array([s for s, y in zip(scores, labels, strict=True) if y == k]) for k in (1, 0))
    return float((good[:, None] > bad[None, :]).mean() + (good[:, None] == bad[None, :]).mean() / 2)


@pytest.mark.parametrize("name, column, least", [("op5_quality", "quality", (0.95, 0.97, 0.8)), ("op10_toxicity", "toxic", (0.8, 0.65, 0.97))])
def test_held_out(spark, folder, name, column, least):
    """Area, true positive rate and true negative rate on the held-out fifth; always saying the same would give 0.5 and one rate of 0."""
    big = folder.replace("sf0.001", "sf0.1")
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in queries.QUERIES[name](spark, big).collect() if r.held_out and r.doc_id in labels]
    area = ranks([h[0] for h in held], [h[2] for h in held])
    rate = lambda y: np.mean([h[1] == y for h in held if h[2] == y])
    assert (area, rate(1), rate(0)) >= least and area >= least[0] and rate(1) >= least[1] and rate(0) >= least[2], (area, rate(1), rate(0))


def test_toxic_features():
    """Single features by plain counting: shares of the words and 40 more."""
    import pyarrow as pa

    from tarnfell.llm.toxicity import FEATURES, features

    def of(text):
        return dict(zip(FEATURES, features(pa.array(["first you", text, None]), np.zeros(0, np.uint64), np.zeros(0))[1].round(6).tolist(), strict=True))

    part = lambda hits, words: round(100 * hits / (words + 40), 6)
    assert of("you are an 1diot")["disguised"] == part(1, 4) and of("you idiot! you 1diot!!")["disguised"] == part(1, 4)
    assert of("you idiot! you 1diot")["insult_words"] == 2 and of("fine! no insult")["disguised"] == of("fine! no insult")["insults"] == 0
    assert of("BLÖD")["insult_words"] == of("blöd")["insult_words"] == 1
    assert of("vivo con mi familia")["insult_words"] == 0
    assert of("you are an idiot")["near_you"] == part(1, 4) and of("an idiot " + "and so on " * 4 + "you")["near_you"] == 0
    assert of("y0u l0ser")["near_you"] == part(1, 2) and of("an idiot")["near_you"] == 0
    assert of("WHY not YOU")["capital_words"] == part(2, 3) and of("")["word_length"] == 0
    assert of("so!!")["exclaims"] == part(2, 4) and of("a1 b2c d")["mixed_words"] == part(1, 3)


HARMLESS = """Take out the trash and shut the door|The garbage truck comes on Monday|She shut the window because it was cold|I hate rain in spring|The old fool in the play is the best part|He made a dumb bet and lost
The clown at the party was funny|This key is useless without the lock|They hate to be late|The ugly duckling became a swan|Please shut the gate behind the horses|We put the trash into the blue bin
A clown juggled four balls|My brother hates onions|The garbage was burned at night|It was a stupid mistake of the printer|The tool is useless in winter|Fools rush in where angels fear to tread|The shop was shut all day|An ugly scratch ran along the table""".replace("\n", "|").split("|")


def test_toxic_scores(spark, folder):
    """Every dealt feature decides something; disguise doesn't help, harmless uses of such words stay clean, address and disguise never lower a score."""
    from tarnfell.llm.toxicity import FEATURES, RISING, disguised, toxicity_scores, train_toxicity

    big = folder.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    trained = train_toxicity(docs, labels)
    used = set()

    def walk(node):
        if node.feature >= 0:
            used.add(FEATURES[node.feature])
            walk(node.left)
            walk(node.right)

    for tree in trained[0].trees:
        walk(tree)
    assert used >= {*RISING, "capitals", "punctuation"}, used
    assert len(trained[1]) < 1000  # the bound of the learned lexicon is not reached
    rng = np.random.default_rng(1)
    x = np.abs(rng.normal(size=(400, len(FEATURES)))) * 3
    for name in RISING:
        more = x.copy()
        more[:, FEATURES.index(name)] += rng.uniform(0, 3, 400)
        assert (trained[0].margin(more) >= trained[0].margin(x) - 1e-12).all()

    def scores(texts):
        rows = toxicity_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), trained).collect()
        return [r.score for r in sorted(rows)]

    assert len(HARMLESS) == 20 and max(scores(HARMLESS)) < 0.5
    assert min(scores(["you idiot", "you are an 1d10t", "1d10t l0ser y0u", "you are a stupid idiot and a loser"])) >= 0.5
    held = docs.join(labels.where("toxic = 1"), "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").collect()
    plain, twins = scores([r.text for r in held]), scores([disguised(r.text) for r in held])
    assert sum(s >= 0.5 for s in twins) >= 0.9 * sum(s >= 0.5 for s in plain)


def test_personal_data_beyond_patterns(spark):
    """What the trees add: secrets and obfuscated addresses, nothing in prose. Learned from perturbed base spans, so recall is measured on unseen ones."""
    from tarnfell.llm.pii import personal_data, train_detector

    filler = ["the river was cold and the boat", "le chat dort sur la table et", "im Jahr 1998 war es so warm, dass 40", "part 12 of 250 pages with 3,000 words"]
    learn = [(i, f"{filler[i % 4]} write to user{i}.name@host{i % 13}.org or call +49 30 {1000000 + i * 137 % 9000000} {filler[(i + 1) % 4]} token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" {filler[(i + 2) % 4]}") for i in range(600)]
    docs = spark.createDataFrame(learn, "doc_id bigint, text string")
    detector = train_detector(docs)
    new = [(i, f"{filler[i % 4]} write to who{i} (at) place{i} (dot) net {filler[(i + 1) % 4]}") for i in range(40)] + [(100 + i, f"{filler[i % 4]} secret: {hashlib.md5(str(i).encode()).hexdigest()}") for i in range(40)] + [(200 + i, f"{filler[i % 4]} and {filler[(i + 3) % 4]}") for i in range(40)]
    got = {r.doc_id: r.n_extra for r in personal_data(spark.createDataFrame(new, "doc_id bigint, text string"), detector).collect()}
    assert np.mean([got[i] > 0 for i in range(40)]) >= 0.9 and np.mean([got[100 + i] > 0 for i in range(40)]) >= 0.9
    assert sum(got[200 + i] for i in range(40)) == 0
