"""Toxicity from gradient-boosted trees over dense features, with isotonic calibration.

Features of a document are densities: insults (words of a fixed lexicon, words learned from labelled documents, and either of them behind digits or signs that are read as letters), insults close to
a second-person word, disguised insults, words with digits or signs inside, capitals and punctuation. Densities are shares of words plus a constant, so that one word is not much in a short text. The
score never falls as insults, address or disguise grow (monotone trees). The labelled texts have neither disguised insults nor harmless uses of such words, so the trees also learn from copies of
training rows: toxic ones disguised or addressed to somebody, pieces of clean ones with a word that can be an insult, and with an insult addressed to somebody. Words are compared in lower case, of all
alphabets. Labelled documents are dealt into three: one learns the lexicon, one the trees, one (as it is) the calibration.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, fit, isotonic
from .shared import MAX_LABELLED_ROWS, id_type, labelled_sample, unclashed, written
from .words import BYTE_VALUES, NOT_WORD, WHITE_SPACE, find_words, slices, text_buffers, word_hashes

#: Common insults and second-person words of the corpus' languages, without those that are common words in another of them.
INSULTS = """clown disgusting dumb fool garbage hate idiot idiots loser losers moron morons pathetic scum shut stupid trash ugly useless worthless
arschloch blöd dumm dreck idioten trottel versager widerlich wertlos abruti crétin dégoûtant imbécile minable ordure pathétique stupide
asqueroso basura estúpido idiota imbécil inútil patético payaso perdedor tonto""".split()
SECOND_PERSON = "you your you're u ur yourself du dich dir dein deine ihr euch tu te toi ta tes vous votre vos usted tú ti contigo vosotros".split()
#: Signs read as letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
FEATURES = ("insults", "insult_words", "near_you", "disguised", "learned_weight", "mixed_words", "capitals", "capital_words", "exclaims", "punctuation", "digits", "word_length")
#: Features with which the score may only rise.
RISING = ("insults", "insult_words", "near_you", "disguised", "learned_weight")
#: Words added to every text's number when shares are taken.
SMOOTH = 40
#: Words of the lexicon that also stand in harmless sentences.
MILD = "trash garbage shut hate dumb fool ugly useless clown stupid basura dreck ordure".split()
#: Defaults of the learned lexicon: words at most, toxic labelled documents that must hold each, log odds that it must exceed.
LEARNED_WORDS, LEARNED_DOCUMENTS, LEARNED_ODDS = 1000, 6, 2.5
#: Beginnings of words that are learned beside whole words: bytes, salt of their hashes.
PREFIXES = ((5, 0x5A17), (7, 0xC0DE))
NEAR = 5

_LOOK_VALUES = BYTE_VALUES.copy()
for _sign, _letter in LOOKALIKES.items():
    _LOOK_VALUES[ord(_sign)] = BYTE_VALUES[ord(_letter)]
_LOOK_SEPARATORS = NOT_WORD.copy()
_LOOK_SEPARATORS[[ord(c) for c in LOOKALIKES]] = False
_MASKS = {"upper": [i for i in range(128) if chr(i).isupper()], "digit": [i for i in range(128) if chr(i).isdigit()], "letter": [i for i in range(256) if i > 127 or chr(i).isalpha()], "sign": [ord(c) for c in "@$*#%!0123456789"]}


def _hashes(words: list[str]) -> np.ndarray:
    offsets, data = text_buffers(pa.array([w.lower() for w in words]))
    return np.unique(word_hashes(data, offsets[:-1], offsets[1:]))


_INSULTS, _YOU = _hashes(INSULTS), _hashes(SECOND_PERSON)


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of the texts in lower case."""
    offsets, data = text_buffers(pc.utf8_lower(column.cast(pa.large_string())))
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def _sums(mask: list[int], data: np.ndarray) -> np.ndarray:
    table = np.zeros(256, np.int32)
    table[mask] = 1
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum(table[data], out=out[1:])
    return out


def _member(h: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether h is among the sorted known hashes, and where."""
    if not len(known):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return known[at] == h, at


def _words(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Bytes in lower case, offsets, words' starts, ends and rows, and their hashes."""
    offsets, data = lowered(column)
    ws, we, wr = find_words(data, offsets, NOT_WORD)
    return data, offsets, ws, we, wr, word_hashes(data, ws, we)


def features(column: pa.Array, learned: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(rows, features) of a column of texts; null is empty. learned: sorted word hashes with their log odds."""
    low, places, ws, we, wr, h = _words(column)
    rows = len(places) - 1
    first = np.searchsorted(wr, np.arange(rows + 1))
    n = np.diff(first)
    hit, odds = _member(h, _INSULTS)[0], np.zeros(len(h))
    for unit in _units(low, ws, we, h):
        found, at = _member(unit, learned)
        hit = hit | found
        if len(weights):
            odds = np.maximum(odds, np.where(found, weights[at], 0))
    you = _member(h, _YOU)[0]
    # words behind signs, by the word of the text in which or before which they begin
    start, dr, insult, second = _read(low, places, learned)
    at = np.minimum(np.searchsorted(ws, start, "right") - 1, len(ws) - 1)
    at = np.where((at < 0) | (wr[np.maximum(at, 0)] != dr), np.minimum(at + 1, len(ws) - 1), at) if len(ws) else at
    inside = wr[at] == dr if len(ws) else np.zeros(len(at), bool)
    hit = hit.copy()
    hit[at[inside & insult]] = True
    you = you.copy()
    you[at[inside & second]] = True
    around = np.concatenate([[0], np.cumsum(you)])
    before, after = np.maximum(np.arange(len(h)) - NEAR, first[wr]), np.minimum(np.arange(len(h)) + NEAR + 1, first[wr + 1])
    close = hit & (around[after] - around[before] > 0)
    per = lambda flag: np.bincount(wr[flag], minlength=rows)
    share = lambda count: 100 * count / (n + SMOOTH)
    out = np.zeros((rows, len(FEATURES)))
    out[:, 0], out[:, 1], out[:, 2] = share(per(hit)), per(hit), share(per(close))
    out[:, 3] = share(np.bincount(dr[insult], minlength=rows))
    np.maximum.at(out[:, 4], wr, odds)
    offsets, data = text_buffers(column)
    offsets, data = offsets - offsets[0], data[offsets[0] : offsets[-1]]
    size = np.diff(offsets) + SMOOTH
    part = lambda mask: 100 * (lambda s: s[offsets[1:]] - s[offsets[:-1]])(_sums(mask, data)) / size
    ps, pe, pr = find_words(data, offsets, WHITE_SPACE)
    letters, signs, upper = (_sums(_MASKS[k], data) for k in ("letter", "sign", "upper"))
    mixed = (letters[pe] - letters[ps] > 1) & (signs[np.maximum(pe - 1, ps)] - signs[ps] > 0)
    out[:, 5] = share(np.bincount(pr[mixed], minlength=rows))
    out[:, 6] = part(_MASKS["upper"])
    cs, ce, cr = find_words(data, offsets, NOT_WORD)
    out[:, 7] = share(np.bincount(cr[(upper[ce] - upper[cs] == ce - cs) & (ce - cs > 2)], minlength=rows))
    out[:, 8] = part([ord("!")])
    out[:, 9] = part([i for i in range(33, 127) if not chr(i).isalnum()])
    out[:, 10] = part(_MASKS["digit"])
    out[:, 11] = np.bincount(wr, we - ws, rows) / np.maximum(n, 1)
    return out


def _read(low: np.ndarray, places: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, row, insult, second person) of the words that are an insult or a second-person word only once their signs are read as letters. Exclamation marks at a word's end are none of its
    letters."""
    ls, le, lr = find_words(low, places, _LOOK_SEPARATORS)
    if not len(ls):
        return ls, lr, np.zeros(0, bool), np.zeros(0, bool)
    kept = np.maximum.accumulate(np.where(low != ord("!"), np.arange(len(low)), -1))
    le = np.maximum(kept[le - 1] + 1, ls)
    read, plain = word_hashes(low, ls, le, _LOOK_VALUES), word_hashes(low, ls, le)
    other = (read != plain) & (le > ls)
    insult = other & (_member(read, _INSULTS)[0] | _member(read, learned)[0]) & ~_member(plain, _INSULTS)[0]
    second = other & _member(read, _YOU)[0]
    on = insult | second
    return ls[on], lr[on], insult[on], second[on]


_INSULT = re.compile(rf"\b({'|'.join(sorted(INSULTS, key=len, reverse=True))})\b", re.IGNORECASE)
_SECOND = re.compile(rf"\b({'|'.join(sorted(SECOND_PERSON, key=len, reverse=True))})\b", re.IGNORECASE)
_SIGN = {"o": "0", "i": "1", "e": "3", "a": "@", "s": "5", "t": "7"}


def disguised(text: str) -> str:
    """The text with its insults' letters as signs."""
    return _INSULT.sub(lambda m: "".join(_SIGN.get(c.lower(), c) for c in m[0]), text)


def copies(text: str, label: int, turn: int) -> list[tuple[str, int]]:
    """What is learned beside a training row: (text, label)."""
    if label:
        return [(disguised(text), 1), (_INSULT.sub(lambda m: f"you {m[0]}", text), 1)] if _INSULT.search(text) else []
    words = _SECOND.sub("", _INSULT.sub("", text)).split()[: 6 + turn % 9]
    mild, insult, at = MILD[turn % len(MILD)], INSULTS[turn * 7 % len(INSULTS)], turn % (len(words) + 1)
    if turn % 3 == 0:
        return [(" ".join([*words[:at], mild, *words[at:]]), 0)]
    if turn % 3 == 1:
        return [(" ".join([*words[:at], mild, *words[at:], MILD[(turn + 4) % len(MILD)]]), 0)]
    return [(" ".join([*words[:at], *(["you", "are", insult] if turn % 2 else ["you", disguised(insult)]), *words[at:]]), 1)]


def _units(data: np.ndarray, ws: np.ndarray, we: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
    """Hashes of whole words and of their beginnings (of words that are longer than those); a short word's beginning is the word."""
    return [h, *(np.where(we - ws > n, word_hashes(data, ws, np.minimum(we, ws + n)) ^ np.uint64(salt), h) for n, salt in PREFIXES)]


def _learned(words: DataFrame, most: int, documents: int, odds: float) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes that labelled toxic documents hold far more often, with their log odds."""
    toxic, clean = F.sum(F.col("label")), F.sum(1 - F.col("label"))
    sizes = words.where("word is null").agg(toxic.alias("t"), clean.alias("c")).first()
    t, c = (sizes["t"] or 0) + 1.0, (sizes["c"] or 0) + 1.0
    found = words.where("word is not null").groupBy("word").agg(toxic.alias("t"), clean.alias("c")).where(F.col("t") >= documents)
    found = found.withColumn("w", F.log((F.col("t") + 0.5) / t) - F.log((F.col("c") + 0.5) / c)).where(F.col("w") > odds).orderBy(F.desc("t"), "word").limit(most).collect()
    h, w = np.array([r["word"] for r in found], np.int64).view(np.uint64), np.array([r["w"] for r in found])
    order = np.argsort(h)
    return h[order], w[order] if len(w) else w


def train_toxicity(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED_ROWS, words: int = LEARNED_WORDS, documents: int = LEARNED_DOCUMENTS, odds: float = LEARNED_ODDS) -> tuple[Boosted, np.ndarray, np.ndarray]:
    """(trees, learned hashes, their weights) from at most limit labelled documents outside the held-out fifth, whole texts. The learned lexicon has at most `words` words or
    beginnings of words, each in `documents` toxic documents at least and with log odds above `odds`; 0 words leave it out. One label only, or none: a constant."""
    sample = written(labelled_sample(docs, labels, "toxic", limit).withColumn("deal", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(10))), "sample")

    def bags(batches):
        for part, _, _ in slices(batches):
            data, _, ws, we, wr, h = _words(part.column("text"))
            units = _units(data, ws, we, h)
            pairs = np.unique(np.stack([np.tile(wr.astype(np.uint64), len(units)), np.concatenate(units)], 1), axis=0)
            label = np.asarray(part.column("label"))
            at = pairs[:, 0].astype(np.int64)
            # a row with a null word counts its document
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([label[at], label])), pa.concat_arrays([pa.array(pairs[:, 1].view(np.int64)), pa.nulls(len(label), pa.int64())])], ["label", "word"])

    learned, weights = (np.zeros(0, np.uint64), np.zeros(0)) if not words else _learned(sample.where("deal < 4").select("text", "label").mapInArrow(bags, "label int, word bigint"), words, documents, odds)

    def measured(batches):
        for part, _, _ in slices(batches):
            rows = list(zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "label", "deal")), strict=True))
            rows += [(own, t, y, deal) for own, text, label, deal in rows if deal < 8 for t, y in copies(text or "", label, zlib.crc32(str(own).encode()))]
            ids, texts, labels, deals = zip(*rows, strict=True)
            x = features(pa.array(texts, pa.string()), learned, weights)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, part.column("doc_id").type), pa.array(labels, pa.int32()), pa.array(deals, pa.int64()), lists], ["doc_id", "label", "deal", "x"])

    kind = id_type(docs)
    rows = sample.where("deal >= 4").select("doc_id", "text", "label", "deal").mapInArrow(measured, f"doc_id {kind}, label int, deal bigint, x array<double>").toArrow()  # at most limit rows and two copies of each
    rows = rows.take(pc.sort_indices(rows.select(["doc_id"]), [("doc_id", "ascending")]))  # copies behind their row
    y = np.array(rows["label"].to_pylist(), np.int64)
    x = np.array(rows["x"].to_pylist(), np.float64).reshape(len(y), len(FEATURES))
    own = np.array(rows["deal"].to_pylist(), np.int64) < 8
    model = fit(x[own], y[own], list(FEATURES), trees=80, rising=RISING)
    model.knots, model.levels = isotonic(model.margin(x[~own]), y[~own])
    return model, learned, weights


def toxicity_scores(docs: DataFrame, trained: tuple[Boosted, np.ndarray, np.ndarray], threshold: float = 0.5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score, predicted, lexicon_hits for every row, whole texts; narrow. Null text is empty and is scored by the same trees. Equal texts get equal scores, so repeated
    rows and ties do; rows without a doc_id are scored too; other columns are left out."""
    model, learned, weights = trained

    def scored(batches):
        for part, _, _ in slices(batches, text):
            x = features(part.column(text), learned, weights)
            s = model.predict(x)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(x[:, 1])], ["doc_id", "score", "predicted", "lexicon_hits"])

    return unclashed(docs, doc_id, text).mapInArrow(scored, f"doc_id {id_type(docs, doc_id)}, score double, predicted int, lexicon_hits double")
