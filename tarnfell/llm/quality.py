"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are binned shares of character classes, word lengths and repetitions, of the line itself and of its
two neighbours; a transition weight ties it to the line before. Training takes each line of a labelled document as labelled like the document
and maximises the chain's conditional likelihood, by iterative parameter mixing: in each round every shard of the sample goes on from the mixed weights in
a task of its own, a step for some hundred lines, and the shards' weights are averaged. Whole documents are learned, of any length, and no line leaves its task.
A document's raw score is the mean of the lines' forward-backward marginals of being
good, weighted by length; a rising step function, fitted on labelled documents that the chain has not seen, turns it into a probability.

Forward and backward passes are prefix products of the chain's 2 by 2 matrices, taken by doubling over all lines at once, so that a text of a million lines is as cheap
a line as a short one.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import isotonic
from .shared import MAX_LABELLED_ROWS, id_type, labelled_sample, unclashed, written
from .words import find_words, mix, slices, word_hashes

FEATURES = ("length", "letters", "upper", "digits", "space", "pipes", "symbols", "stops", "wide", "word_length", "repeats", "skip_repeats", "same_as_before")
_SMALL = (0.001, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.4, 0.7)
_TIMES = (0.001, 0.01, 0.03, 0.06, 0.1, 0.15, 0.25, 0.4, 0.6, 0.8, 0.95)
#: Upper limits of the bins of each feature, by its scale; the last bin has none.
LIMITS = np.array(
    [
        (1.5, 2.5, 3, 3.5, 4, 4.5, 5, 5.5, 6, 6.5, 7.5),
        (0.3, 0.45, 0.55, 0.62, 0.68, 0.72, 0.76, 0.79, 0.82, 0.85, 0.9),
        _SMALL,
        _SMALL,
        (0.02, 0.06, 0.09, 0.11, 0.125, 0.14, 0.155, 0.17, 0.19, 0.22, 0.3),
        _SMALL,
        _SMALL,
        _SMALL,
        _SMALL,
        (1.5, 2.5, 3.2, 3.8, 4.3, 4.8, 5.3, 6, 7, 9, 14),
        _TIMES,
        _TIMES,
        _TIMES,
    ]
)
BINS = LIMITS.shape[1] + 1
#: Rounds of mixing, shards of the sample, lines of a step at least, its length in the first round, and the penalty of large weights.
ROUNDS, SHARDS, STEP_LINES, RATE, RIDGE = 10, 4, 150, 0.1, 3e-6

_HIGH = np.uint64(32)
_CLASSES = {
    "letters": [i for i in range(128) if chr(i).isalpha()],
    "upper": [i for i in range(128) if chr(i).isupper()],
    "digits": [i for i in range(128) if chr(i).isdigit()],
    "space": [9, 11, 12, 13, 32],
    "pipes": [ord("|")],
    "symbols": [i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,;:!?'\"()-|"],
    "stops": [ord(c) for c in ".,;:!?"],
    "wide": list(range(128, 256)),
}
_PAIRS = [("letters", "upper"), ("digits", "space"), ("pipes", "symbols"), ("stops", "wide")]
_TABLES = []
for _a, _b in _PAIRS:
    _t = np.zeros(256, np.uint64)
    _t[_CLASSES[_a]] += np.uint64(1)
    _t[_CLASSES[_b]] += np.uint64(1) << _HIGH
    _TABLES.append(_t)


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, bytes and features (n, 13) of every line. A row without text has one empty line."""
    breaks = np.flatnonzero(data == 10)
    rows = len(offsets) - 1
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    owner = np.repeat(np.arange(rows), 1 + np.bincount(np.searchsorted(offsets, breaks, "right") - 1, minlength=rows) if len(breaks) else 1)
    last = np.append(owner[1:] != owner[:-1], True)
    ends = np.append(starts[1:], len(data))
    ends = np.where(last, offsets[owner + 1], ends - 1)
    n = np.maximum(ends - starts, 0)
    out = np.zeros((len(starts), len(FEATURES)), np.float32)
    out[:, 0] = np.log1p(n)
    size = np.maximum(n, 1)
    for t, (a, b) in zip(_TABLES, _PAIRS, strict=True):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(t[data], out=sums[1:])
        d = sums[np.maximum(ends, starts)] - sums[starts]
        out[:, FEATURES.index(a)] = (d & np.uint64(0xFFFFFFFF)).astype(np.float64) / size
        out[:, FEATURES.index(b)] = (d >> _HIGH).astype(np.float64) / size
    ws, we, _ = find_words(data, offsets)
    if len(ws):
        line = np.searchsorted(starts, ws, "right") - 1
        h = word_hashes(data, ws, we)
        words = np.maximum(np.bincount(line, minlength=len(starts)), 1)
        out[:, 9] = np.bincount(line, we - ws, len(starts)) / words
        for step, j in ((1, 10), (2, 11)):
            again = (h[step:] == h[:-step]) & (line[step:] == line[:-step])
            out[:, j] = np.bincount(line[step:][again], minlength=len(starts)) / words
        weight = mix(h + np.uint64(1))
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(weight, out=sums[1:])
        first = np.searchsorted(ws, starts)
        bag = sums[np.append(first[1:], len(ws))] - sums[first]
        out[1:, 12] = (bag[1:] == bag[:-1]) & (owner[1:] == owner[:-1])
    return owner, n, out


def _prefix_products(m: np.ndarray, place: np.ndarray) -> np.ndarray:
    """(4, n) matrices, row by row: the product of each one with all before it in its chain, up to a factor. place: the number of those before."""
    m, step = m.copy(), 1
    while True:
        at = np.flatnonzero(place >= step)
        if not len(at):
            return m
        a, b = m[:, at - step], m[:, at]
        new = np.stack([a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3]])
        m[:, at] = new / new.max(0)
        step *= 2


@dataclass
class Chain:
    """weights (3, features, BINS + 1): previous, own and next line, the last bin for a missing line; steps (2, 2): from and to bad and good."""

    weights: np.ndarray
    steps: np.ndarray
    bias: float = 0.0
    knots: np.ndarray | None = None
    levels: np.ndarray | None = None

    @staticmethod
    def of(theta: np.ndarray) -> Chain:
        return Chain(theta[:-5].reshape(3, len(FEATURES), BINS + 1), theta[-5:-1].reshape(2, 2), float(theta[-1]))

    def emissions(self, placed: np.ndarray) -> np.ndarray:
        out = np.full(len(placed), self.bias)
        for p in range(3):
            for j in range(placed.shape[2]):
                out += self.weights[p, j][placed[:, p, j]]
        return out

    def marginals(self, owner: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of good for each line, expected transitions (2, 2)."""
        n = len(e)
        if not n:
            return np.zeros(0), np.zeros((2, 2))
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        size = np.diff(np.append(first, n))
        place = np.arange(n) - np.repeat(first, size)
        steps = np.exp(self.steps - self.steps.max())
        low, high = np.exp(-np.maximum(e, 0)), np.exp(np.minimum(e, 0))
        m = np.stack([steps[0, 0] * low, steps[0, 1] * high, steps[1, 0] * low, steps[1, 1] * high])
        m[:, first] = np.stack([low[first], high[first]] * 2)
        ahead = _prefix_products(m, place)[:2]
        back = np.ones((4, n))
        back[:, :-1] = m[:, 1:][[0, 2, 1, 3]]
        back[:, first + size - 1] = 1
        behind = _prefix_products(back[:, ::-1], (np.repeat(size, size) - 1 - place)[::-1])[:2, ::-1]
        both = ahead * behind
        inner = np.flatnonzero(place > 0)
        moves = (ahead[:, None, inner - 1] * m[:, inner].reshape(2, 2, -1) * behind[None, :, inner]) if len(inner) else np.zeros((2, 2, 0))
        return both[1] / both.sum(0), (moves / moves.sum((0, 1))).sum(2)

    def raw(self, owner: np.ndarray, n: np.ndarray, x: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Length-weighted mean marginal, lines and bad lines of each row."""
        good, _ = self.marginals(owner, self.emissions(placed(owner, bins(x))))
        w = n + 1.0
        return np.bincount(owner, good * w, rows) / np.bincount(owner, w, rows), np.bincount(owner, minlength=rows), np.bincount(owner[good < 0.5], minlength=rows)

    def score(self, raw: np.ndarray) -> np.ndarray:
        return raw if self.knots is None or not len(self.knots) else np.interp(raw, self.knots, self.levels)


def bins(x: np.ndarray) -> np.ndarray:
    """(n, features) numbers of bins."""
    return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(LIMITS)], 1).astype(np.uint8)


def placed(owner: np.ndarray, own: np.ndarray) -> np.ndarray:
    """(n, 3, features): bins of the line before, of the line and of the next one."""
    out = np.full((len(own), 3, own.shape[1]), BINS, np.uint8)
    out[:, 1] = own
    same = owner[1:] == owner[:-1]
    out[1:, 0][same] = own[:-1][same]
    out[:-1, 2][same] = own[1:][same]
    return out


def gradient(theta: np.ndarray, owner: np.ndarray, own: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the conditional log likelihood a line, less the penalty. own: bins, y: labels, each of every line."""
    chain, at = Chain.of(theta), placed(owner, own)
    good, moves = chain.marginals(owner, chain.emissions(at))
    inner = owner[1:] == owner[:-1]
    seen = np.bincount(2 * y[:-1][inner] + y[1:][inner], minlength=4)
    gap = y - good
    cells = [np.bincount(at[:, p, j], gap, BINS + 1) for p in range(3) for j in range(own.shape[1])]
    return np.concatenate([*cells, seen - moves.ravel(), [gap.sum()]]) / len(y) - RIDGE * theta


def learned(documents, theta: np.ndarray, rate: float) -> tuple[np.ndarray, int]:
    """Weights after one pass over documents (label, bins) with Adam steps of some hundred lines each, and the lines."""
    theta, m, v, i, lines = theta.copy(), np.zeros(len(theta)), np.zeros(len(theta)), 0, 0
    held: list[tuple[int, np.ndarray]] = []

    def step() -> None:
        nonlocal m, v, i
        sizes = [len(b) for _, b in held]
        g = gradient(theta, np.repeat(np.arange(len(held)), sizes), np.concatenate([b for _, b in held]), np.repeat([y for y, _ in held], sizes))
        i += 1
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta[:] += rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        held.clear()

    for document in documents:
        held.append(document)
        lines += len(document[1])
        if sum(len(b) for _, b in held) >= STEP_LINES:
            step()
    if held:
        step()
    return theta, lines


def train_quality(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED_ROWS) -> Chain:
    """Fit on at most limit labelled documents outside the held-out fifth, whole texts of any number of lines: three in four train the chain, one in four the final step function.
    One label only, or none: a constant."""
    sample = written(labelled_sample(docs, labels, "quality", limit).withColumn("deal", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(4 * SHARDS)).cast("int")), "sample")

    def binned(batches):
        for part, data, offsets in slices(batches):
            owner, _, x = line_features(data, offsets)
            cut = np.searchsorted(owner, np.arange(part.num_rows + 1))
            own = bins(x)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), part.column("deal"), pa.array([own[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())], ["doc_id", "label", "deal", "bins"])

    known = sample.where(F.col("deal") < 3 * SHARDS).select("doc_id", "text", "label", "deal").mapInArrow(binned, f"doc_id {id_type(docs)}, label int, deal int, bins binary")
    known = written(known.withColumn("shard", F.col("deal") % SHARDS).repartition(SHARDS, "shard").sortWithinPartitions("shard", "doc_id"), "lines")
    theta = np.zeros(3 * len(FEATURES) * (BINS + 1) + 5)

    def one_round(start: np.ndarray, rate: float):
        def mixed(batches):
            def rows():
                for batch in batches:
                    yield from zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)

            for _, own in itertools.groupby(rows(), lambda r: r[0]):
                got, lines = learned(((y, np.frombuffer(b, np.uint8).reshape(-1, len(FEATURES))) for _, y, b in own), start, rate)
                yield pa.RecordBatch.from_arrays([pa.array([lines], pa.int64()), pa.array([got], pa.list_(pa.float64()))], ["lines", "theta"])

        # a row for each shard
        return known.select("shard", "label", "bins").mapInArrow(mixed, "lines bigint, theta array<double>").collect()

    for i in range(ROUNDS):
        got = one_round(theta, RATE / (1 + i / 2))
        if not got:
            break
        theta = np.average([r["theta"] for r in got], axis=0, weights=[r["lines"] for r in got])
    chain = Chain.of(theta)

    def judged(batches):
        for part, data, offsets in slices(batches):
            raw, _, _ = chain.raw(*line_features(data, offsets), part.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(raw), part.column("label")], ["raw", "label"])

    rows = sample.where(F.col("deal") >= 3 * SHARDS).select("text", "label").mapInArrow(judged, "raw double, label int").toArrow()  # at most limit rows
    raw, y = np.asarray(rows["raw"], np.float64), np.asarray(rows["label"], np.int64)
    chain.knots, chain.levels = isotonic(raw, y)
    if not len(chain.knots) and len(y):
        chain.knots, chain.levels = np.array([0.0]), np.array([(y.sum() + 1) / (len(y) + 2)])
    return chain


def quality_scores(docs: DataFrame, chain: Chain, threshold: float = 0.3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score, predicted, n_lines, n_bad_lines for every row, whole texts of any number of lines; narrow. Null text is empty: one line without bytes, scored
    by the same chain. Equal texts get equal scores, so repeated rows and ties do; rows without a doc_id are scored too; other columns are left out."""

    def scored(batches):
        for part, data, offsets in slices(batches, text):
            raw, lines, bad = chain.raw(*line_features(data, offsets), part.num_rows)
            s = chain.score(raw)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(lines.astype(np.int64)), pa.array(bad.astype(np.int64))], ["doc_id", "score", "predicted", "n_lines", "n_bad_lines"])

    return unclashed(docs, doc_id, text).mapInArrow(scored, f"doc_id {id_type(docs, doc_id)}, score double, predicted int, n_lines bigint, n_bad_lines bigint")


def keep_good(docs: DataFrame, chain: Chain, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that the chain accepts, all columns as they are, repeated rows as often as they occur; narrow: the verdict is made beside the row, not joined to it."""
    schema = docs.schema

    def kept(batches):
        for part, data, offsets in slices(batches, "text"):
            raw, _, _ = chain.raw(*line_features(data, offsets), part.num_rows)
            yield part.filter(pa.array(chain.score(raw) >= threshold))

    return docs.mapInArrow(kept, schema)
