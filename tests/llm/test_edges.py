"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns: every operator gives the result its docstring names."""

import hashlib
import itertools

import public_tokenizers
import pytest

from tarnfell.llm.chat import chat_windows, parse, read_back, render
from tarnfell.llm.decontamination import contaminated, without_benchmark
from tarnfell.llm.near_dedup import near_duplicates, one_of_each
from tarnfell.llm.packing import packed
from tarnfell.llm.pii import personal_data, redacted, train_detector
from tarnfell.llm.quality import keep_good, quality_scores, train_quality
from tarnfell.llm.substring_dedup import repeated_passages
from tarnfell.llm.token_counts import token_counts
from tarnfell.llm.toxicity import toxicity_scores, train_toxicity
from tarnfell.llm.vector_dedup import linked_vectors

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
SCHEMA = "doc_id bigint, text string, label int, key1 string, bucket string, n string, kind string"
LONG = " ".join(f"word{i % 977} and{i}" for i in range(20_000))
PROSE = " ".join(f"w{i * 7919 % 1013}" for i in range(120))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, PROSE), (2, PROSE), (3, None), (4, ""), (5, "   \n\t "), (6, LONG), (7, "a"), (8, PROSE + " tail"), (9, "A"), (10, "line\n" * 50), (11, "é" * 3000), (12, "x" * 120_000)]
    return spark.createDataFrame([(i, t, 7, "k", "b", "n", "q") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2, "x") for i in range(1, 13)], "doc_id bigint, quality int, toxic int, text string")


@pytest.fixture(scope="module")
def detector(spark):
    rows = [(i, f"the river {i} write to user{i}.name@host{i % 13}.org or call +49 30 {1000000 + i * 137} and token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" so on") for i in range(200)]
    return train_detector(spark.createDataFrame(rows, "doc_id bigint, text string"))


def ids(df, name="doc_id"):
    return sorted(r[name] for r in df.select(name).collect())


def test_row_per_row(spark, docs, empty, labels, detector):
    chain, toxic = train_quality(docs, labels), train_toxicity(docs, labels)
    for make in (lambda d: quality_scores(d, chain), lambda d: toxicity_scores(d, toxic), lambda d: personal_data(d, detector), lambda d: token_counts(d, WORDS), near_duplicates, repeated_passages):
        assert ids(make(docs)) == list(range(1, 13))
        assert make(empty).count() == 0
    for d in (quality_scores(docs, chain), toxicity_scores(docs, toxic)):
        assert d.where("score is null or isnan(score) or score < 0 or score > 1").count() == 0


def test_training_without_rows(spark, docs, empty, labels):
    none = labels.limit(0)
    assert quality_scores(docs, train_quality(docs, none)).count() == 12
    assert toxicity_scores(docs, train_toxicity(empty, labels)).count() == 12
    assert personal_data(docs, train_detector(empty)).where("n_extra > 0").count() == 0


def test_stages_keep_columns(spark, docs, empty, labels, detector):
    chain = train_quality(docs, labels)
    bench = spark.createDataFrame([(1, " ".join(PROSE.split()[30:60]), "z")], "item_id bigint, text string, doc_id string")
    for stage in (lambda d: keep_good(d, chain), one_of_each, lambda d: without_benchmark(d, bench), lambda d: redacted(d, detector)):
        assert stage(docs).columns == docs.columns
        assert stage(empty).count() == 0
    assert ids(without_benchmark(docs, bench)) == [3, 4, 5, 6, 7, 9, 10, 11, 12]
    assert ids(without_benchmark(docs, bench.limit(0))) == list(range(1, 13))
    assert {r.doc_id for r in contaminated(docs, bench).collect()} == {1, 2, 8}
    assert contaminated(docs, bench.limit(0)).count() == 0
    assert ids(one_of_each(docs)) == [1, 3, 4, 5, 6, 7, 10, 11, 12]
    assert redacted(docs, detector).where("doc_id = 3 and text is null").count() == 1


def test_near_duplicates(spark, docs):
    classes = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    assert classes == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 1, 9: 7, 10: 10, 11: 11, 12: 12}


def test_repeated_passages(spark, docs):
    got = {r.doc_id: r for r in repeated_passages(docs).collect()}
    assert [got[i].n_removed for i in (1, 2, 3, 4, 5, 8)] == [0, 120, 0, 0, 0, 120]
    assert got[8].kept_sha256 == hashlib.sha256(b"tail").hexdigest()
    assert got[3].kept_sha256 == hashlib.sha256(b"").hexdigest()


def test_passages_of_repeated_rows(spark, docs):
    twice = docs.unionByName(docs).unionByName(spark.createDataFrame([(2, "other " + PROSE, 7, "k", "b", "n", "q"), (None, PROSE, 7, "k", "b", "n", "q")], SCHEMA))
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in repeated_passages(twice).collect())
    assert len(got) == 26
    assert [g for g in got if g[0] in (0, 1, 2, 8)] == [(0, 120, 0), (1, 120, 0), (1, 120, 0), (2, 120, 120), (2, 120, 120), (2, 121, 120), (8, 121, 120), (8, 121, 120)]


def test_hot_windows(spark, monkeypatch):
    """Salted joins and automata give what plain ones give."""
    from tarnfell.llm import shared, substring_dedup

    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{'again ' * 70}head{i} {passage} tail{i}" if i % 3 else f"{passage} {passage}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted(repeated_passages(df).collect())
    monkeypatch.setattr(shared, "HOT_ROWS", 4)
    monkeypatch.setattr(substring_dedup, "SHARE", 3)
    assert sorted(repeated_passages(df).collect()) == want
    assert [r.n_removed for r in want if r.doc_id in (0, 1, 2, 3)] == [0, 60, 130, 120]


def test_packing(spark, docs, empty):
    rows = packed(docs, BYTES).collect()
    assert {r.doc_id for r in rows} == set(range(1, 13))
    assert sorted((r.doc_id, r.length) for r in rows if r.doc_id in (3, 4)) == [(3, 1), (4, 1)]
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        end = 0
        for offset, length in sorted(p):
            assert offset == end
            end += length
        assert end <= 2048
    assert packed(empty, BYTES).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.9, 0.1]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (9, []), (10, [1.0, 0.0, 0.0]), (11, [1.0, 0.0]), (12, [0.0, 1.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in linked_vectors(spark.createDataFrame([(a, b, "c", 1) for a, b in rows], "vec_id bigint, embedding array<float>, copies string, cell int")).collect()}
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[11] == (3, 1, False) and got[3] == (3, 1, False)
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 12))
    assert linked_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_chat(spark):
    rows = [(1, 0, "system", "be <|im_end|> good"), (1, 1, "user", None), (1, 2, "assistant", "<\\|x " * 40), (1, None, None, "first"), (2, 0, "assistant", ""), (None, 0, "us\ner&n", "t")]
    rows += [(3, i, "system" if i == 0 else "user" if i % 2 else "assistant", f"turn {i} " * 30) for i in range(600)]
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, block string, part int")
    windows = chat_windows(turns, BYTES, budget=512, history=2, history_budget=200)
    got = {r.conv_id: r for r in read_back(windows).collect()}
    assert set(got) == {1, 2, 3, None}
    three = [r for r in rows if r[0] == 3]
    assert got[3].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in three).encode()).hexdigest()
    assert got[3].loss_sha256 == hashlib.sha256("".join(t for _, _, r, t in three if r == "assistant").encode()).hexdigest()
    assert got[1].n_turns == 4 and got[1].loss_chars == 200
    assert windows.where("n_tokens > 512 and not over_budget").count() == 0
    assert windows.where("conv_id = 3 and not startswith(text, '<|im_start|>system')").count() == 0
    assert windows.where("conv_id = 3 and n_repeated > 1").count() > 10
    assert chat_windows(turns.limit(0), BYTES).count() == 0
    for role, text in (("a&n\n<|", "<|im_end|>\n<\\\\|"), ("", "")):
        assert parse(render(role, text)[0]) == [(role, text)]


def test_windows_of_gapped_turns(spark):
    """Against prefix sums over the turns in order: numbers with gaps, many tiny turns, any budget."""
    from tarnfell.llm.packing import Encoder

    encode = Encoder(BYTES)
    sets = {1: [(i * 1000, "user" if i % 2 else "assistant", f"tiny {i}") for i in range(10)], 2: [(i, "system" if i == 0 else "user" if i % 2 else "assistant", "word " * (i * 37 % 90)) for i in range(300)]}
    frame = spark.createDataFrame([(c, *t) for c, turns in sets.items() for t in turns], "conv_id bigint, turn bigint, role string, text string")
    for budget, history, most in ((100_000, 4, 512), (400, 3, 120)):
        want = []
        for c, turns in sets.items():
            tokens = [len(encode(render(r, t)[0])) for _, r, t in turns]
            sums = [0, *itertools.accumulate(tokens)]
            start, window = 0, 0
            while start < len(turns):
                system = int(start > 0 and turns[0][1] == "system")
                past = start - min(history, start - (turns[0][1] == "system")) if start else 0
                room = budget - system * tokens[0]
                while past < start and (sums[start] - sums[past] > most or sums[start + 1] - sums[past] > room):
                    past += 1
                end = start + 1
                while end < len(turns) and sums[end + 1] - sums[past] <= room:
                    end += 1
                want.append((c, window, system + start - past, system * tokens[0] + sums[end] - sums[past]))
                start, window = end, window + 1
        got = chat_windows(frame, BYTES, budget, history, most).select("conv_id", "window", "n_repeated", "n_tokens").collect()
        assert sorted(map(tuple, got)) == want


def test_links_at_high_limits(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    angles = np.sort(rng.uniform(0, 2 * np.pi, 1500))
    x = np.stack([np.cos(angles), np.sin(angles)], 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    want = (x @ x.T >= 0.9999).sum() - len(x)
    assert linked_vectors(df, 0.9999).agg({"n_links": "sum"}).first()[0] == want


def test_marginals():
    """Against all labellings of short chains."""
    import numpy as np

    from tarnfell.llm.quality import BINS, FEATURES, Chain, gradient

    rng = np.random.default_rng(9)
    chain = Chain(np.zeros((3, len(FEATURES), BINS + 1)), rng.normal(size=(2, 2)) * 2)
    owner = np.repeat(np.arange(7), [1, 4, 2, 6, 1, 3, 5])
    e = rng.normal(size=len(owner)) * 3
    good, moves = chain.marginals(owner, e)
    total = np.zeros((2, 2))
    for k in range(7):
        mine = e[owner == k]
        labels = np.array(list(itertools.product((0, 1), repeat=len(mine))))
        w = np.exp(labels @ mine + chain.steps[labels[:, :-1], labels[:, 1:]].sum(1))
        w /= w.sum()
        assert np.allclose(good[owner == k], w @ labels)
        for a, b in itertools.product((0, 1), repeat=2):
            total[a, b] += (w[:, None] * ((labels[:, :-1] == a) & (labels[:, 1:] == b))).sum()
    assert np.allclose(moves, total)
    # the gradient, against differences of the likelihood by enumeration
    own = rng.integers(0, BINS, (6, len(FEATURES))).astype(np.uint8)
    y, theta = np.array([1, 1, 0, 0, 1, 1]), rng.normal(size=3 * len(FEATURES) * (BINS + 1) + 5) * 0.3

    def likelihood(t):
        from tarnfell.llm.quality import placed

        c, out = Chain.of(t), 0.0
        for part in (slice(0, 4), slice(4, 6)):
            em = c.emissions(placed(np.zeros(len(y[part]), int), own[part]))
            labels = np.array(list(itertools.product((0, 1), repeat=len(em))))
            s = labels @ em + c.steps[labels[:, :-1], labels[:, 1:]].sum(1)
            out += s[(labels == y[part]).all(1)][0] - np.log(np.exp(s).sum())
        return out / len(y)

    g = gradient(theta, np.array([0, 0, 0, 0, 1, 1]), own, y)
    for i in (*rng.integers(0, len(theta), 20), *range(len(theta) - 5, len(theta))):
        step = np.zeros(len(theta))
        step[i] = 1e-5
        assert abs((likelihood(theta + step) - likelihood(theta - step)) / 2e-5 - 3e-6 * theta[i] - g[i]) < 1e-6


def test_very_many_lines(spark):
    """A labelled text of 200,000 lines is learned and scored whole."""
    rows = [(i, "good words here\nand more of them" if i % 2 else "| x | 77 |\n| 8 |") for i in range(1, 60)] + [(60, "| x | 77 |\n" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality_scores(df, train_quality(df, labels)).collect()}
    assert got[60].n_lines == 200_001 and got[60].n_bad_lines > 199_000 and got[60].score < 0.3 < got[1].score


def test_repeated_rows(spark, docs, labels):
    twice = docs.unionByName(docs)
    chain, toxic, bench = train_quality(docs, labels), train_toxicity(docs, labels), spark.createDataFrame([(1, PROSE)], "item_id bigint, text string")
    for make in (lambda d: quality_scores(d, chain), lambda d: toxicity_scores(d, toxic), lambda d: packed(d, BYTES), lambda d: contaminated(d, bench)):
        assert make(twice).count() == 2 * make(docs).count() > 0
    assert token_counts(twice, WORDS).count() == 24
    assert near_duplicates(twice).count() == 24
    assert ids(twice.where("doc_id > 100")) == []


def test_long_runs_of_digits(spark, detector):
    texts = ["1" * 6_000, "1 " * 3_000, "1.2." * 1_500, "a." * 3_000 + "@x.y", "+" * 2_000, "a@" + "b." * 2_000 + "c", "12345678901234567890 4111 1111 1111 1111"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in personal_data(df, detector).collect()}
    assert got[5].n_email == 1 and got[3].n_email == 1 and got[2].n_ip == 750


def test_very_many_spans(spark, detector):
    """A long text with tens of thousands of spans: time grows with the text, not with its square."""
    piece = "x 10.0.0.1 a@b.co +49 301 2345678 y 4111111111111111 z 7777777 abcdef0123456789abcdef "
    df = spark.createDataFrame([(1, piece * 5_000), (2, piece), (None, piece), (2, piece)], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in personal_data(df, detector).collect())
    assert got == [(0, 1, 1, 1, 1), (1, 5_000, 5_000, 5_000, 5_000), (2, 1, 1, 1, 1), (2, 1, 1, 1, 1)]
    clean = {r.doc_id: r.text for r in redacted(df, detector).collect()}
    assert clean[1] == clean[2] * 5_000
    assert clean[2].startswith("x [IP] [EMAIL] [PHONE] y [CARD] z ")


def test_marks_of_a_text_itself(spark, detector):
    """Private code points of a text don't move places and come out as they are, those that stand for lost characters too."""
    texts = ["\U000f0041\U000f0042 a@b.co \U000f00c0", "\U000f0041", "a@b.co+49 301 2345678", "\ufffd\U000f0041a@b.co\ufffd\U000f037f", "\ufffd a@b.co \ufffd"]
    df = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id bigint, text string")
    assert [r.spans for r in personal_data(df, detector).orderBy("doc_id").collect()] == ["email:3:9", "", "email:0:6,phone:6:21", "email:2:8", "email:2:8"]
    assert [r.text for r in redacted(df, detector).orderBy("doc_id").collect()] == ["\U000f0041\U000f0042 [EMAIL] \U000f00c0", "\U000f0041", "[EMAIL]", "\ufffd\U000f0041[EMAIL]\ufffd\U000f037f", "\ufffd [EMAIL] \ufffd"]


PERSONAL = {
    "address": ["please write to jane.roe (at) example (dot) org soon", "contact max at posteo dot de for more", "meine Adresse: h.lang [at] firma [dot] de danke"],
    "number": ["please ring my mobile 0171 2345678 tomorrow", "my phone is (415) 555-2671 if needed", "Telefon 030/9012345 am Abend", "IBAN DE89 3704 0044 0532 0130 00 please", "GB82WEST12345698765432 is my account", "the server 10 . 20 . 0 . 15 is down"],
    "secret": ["password: hunter2xyz", 'api_key = "Zk3vQ9xL2mT7pR4wY8bN6cJ1dF5gH0sA"', 'TOKEN = "027AEA05EB92C454086E6575CD38D76A884ACAFF"', "Passwort: Sommer2024"],
}
PLAIN = [
    *("in 1998 and 2004 123456 people came", "the city has 1,250,000 inhabitants", "part 1234567 of the order 7654321", "fixed in 2fd4e1c67a2d28fced849ee1bb76e7391b93eb12 last week", "the budget was 12.345.678 euro", "uuid 123e4567-e89b-12d3-a456-426614174000"),
    *("remarks: Everything was wonderful", "version 2024.10.15 came", "they paid 45000000 for it", "from 1939 - 1945 there was war", "the hash d41d8cd98f00b204e9800998ecf8427e is that of nothing", "wir trafen uns am 24.12.2019 abends", "he stood silently at the dot of noon", "3.1415926535 is a number"),
]


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01", None])
def test_personal_or_plain(spark, empty, table):
    """Decisions on sentences of no template, learned beside small, larger and no documents; precision and recall on held-back templates by kind."""
    learned = train_detector(spark.read.parquet(f"/root/testdata/{table}/documents.parquet") if table else empty)
    assert set(learned.margins) == set(learned.report) == set(PERSONAL)
    for kind, r in learned.report.items():
        assert r["personal"] >= 200 and r["other"] >= 200 and r["precision"] >= 0.97 and r["recall"] >= (0.6 if kind == "number" else 0.9), (kind, r)
    texts = [t for some in PERSONAL.values() for t in some] + PLAIN
    got = {r.doc_id: r.spans for r in personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), learned).collect()}
    wanted = [kind for kind, some in PERSONAL.items() for _ in some] + [""] * len(PLAIN)
    assert [(t, got[i].split(":")[0]) for i, t in enumerate(texts)] == list(zip(texts, wanted, strict=True))
