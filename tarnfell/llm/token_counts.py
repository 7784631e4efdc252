"""Token counts by overlap resynchronisation.

A text longer than chunk_chars is never encoded in one go: chunks that overlap their left neighbour are encoded with offsets, and two
neighbours are spliced at a boundary inside the overlap that is proven stable: on both sides of it the encodings agree on several tokens
(same place, same id), and it lies behind white space, where this kind of tokenizer always cuts. Where no such boundary exists the
overlap is doubled, in the end to the whole text. Shorter texts are encoded whole; if the tokenizer's file proves that no token spans
white space, their white-space pieces are encoded each by itself and a worker remembers the counts of pieces it has met.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import id_type, unclashed
from .words import slices

#: Fixed value: the split pattern under which a token never spans white space.
SPACELESS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pieces whose counts a worker remembers at most, and characters of each: 64 MB or so. The memory is emptied when full; longer pieces are encoded each time.
MEMORY, MEMORY_CHARS = 400_000, 64
#: Characters of new pieces that are encoded in one call.
CALL_CHARS = 1 << 20
#: The memories of this Python worker by tokenizer file; they serve all its tasks.
_KNOWN: dict[str, dict[str, int]] = {}
#: Tokens that must agree on either side of a splice.
AGREE = 4


def cuts_at_space(path: str) -> bool:
    """Whether the file proves that every run of ASCII white space is a token boundary that leaves no trace in the counts."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    plain = all(s["type"] in ("NFC", "Lowercase") or s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " " for s in steps)
    split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    removes = split.get("type") == "Split" and split.get("pattern") == {"Regex": SPACELESS_PATTERN} and split.get("behavior") == "Removed" and split.get("invert") is True
    spaceless = all(not any(c.isspace() for c in t["content"]) and not t["lstrip"] and not t["rstrip"] for t in spec.get("added_tokens", []))
    return plain and removes and spaceless and spec.get("post_processor") is None


class Counter:
    """Counts tokens of texts; lives in one task."""

    def __init__(self, path: str, chunk_chars: int, overlap_chars: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk, self.overlap = chunk_chars, overlap_chars
        self.by_piece = cuts_at_space(path)
        self.known = _KNOWN.setdefault(path, {"": 0})

    def many(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(tokens, chunks, widened overlaps) of each text."""
        out: list = [None] * len(texts)
        short = []
        for i, t in enumerate(texts):
            if len(t) > self.chunk:
                out[i] = self.resynchronised(t)
            else:
                short.append(i)
        if not self.by_piece:
            for i, e in zip(short, self.tokenizer.encode_batch_fast([texts[i] for i in short], add_special_tokens=False), strict=True):
                out[i] = (len(e), 1, 0)
            return out
        known = self.known
        pieces = [texts[i].replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for i in short]
        if len(known) > MEMORY:
            known.clear()
            known[""] = 0
        longer: dict[str, int] = {}
        call, chars = [], 0

        def encoded() -> None:
            for p, e in zip(call, self.tokenizer.encode_batch_fast(call, add_special_tokens=False), strict=True):
                (known if len(p) <= MEMORY_CHARS else longer)[p] = len(e)
            call.clear()

        for p in set().union(*pieces).difference(known):
            call.append(p)
            chars += len(p)
            if chars > CALL_CHARS:
                encoded()
                chars = 0
        encoded()
        for i, own in zip(short, pieces, strict=True):
            try:
                out[i] = (sum(map(known.__getitem__, own)), 1, 0)
            except KeyError:
                out[i] = (sum(known[p] if p in known else longer[p] for p in own), 1, 0)
        return out

    def encode(self, text: str, start: int, end: int) -> np.ndarray:
        """(n, 3): start and end character in the whole text, id."""
        e = self.tokenizer.encode(text[start:end], add_special_tokens=False)
        out = np.empty((len(e.ids), 3), np.int64)
        out[:, :2] = np.array(e.offsets, np.int64).reshape(-1, 2) + start
        out[:, 2] = e.ids
        return out

    def resynchronised(self, text: str) -> tuple[int, int, int]:
        n, done, chunks, widened = len(text), 0, 1, 0
        end = min(n, self.chunk)
        left = self.encode(text, 0, end)
        while end < n:
            width, until = self.overlap, min(n, end + self.chunk)
            while True:
                start = end - width
                if start <= (left[0, 0] if len(left) else 0):
                    return len(self.encode(text, 0, n)), chunks + 1, widened + 1
                right = self.encode(text, start, until)
                cut = splice(text, left, right, start, end)
                chunks += 1
                if cut is not None:
                    break
                width *= 2
                widened += 1
            done += cut[0]
            left, end = right[cut[1] :], until
        return done + len(left), chunks, widened


def splice(text: str, left: np.ndarray, right: np.ndarray, start: int, end: int) -> tuple[int, int] | None:
    """Tokens of left and of right that stand before the middle of the proven boundaries in text[start:end], or None. Tokens that
    touch the edge of a chunk are not trusted."""
    a = np.flatnonzero((left[:, 0] > start) & (left[:, 1] < end))
    b = np.flatnonzero((right[:, 0] > start) & (right[:, 1] < end))
    _, i, j = np.intersect1d(left[a, 0], right[b, 0], return_indices=True)
    i, j = a[i], b[j]
    same = (left[i] == right[j]).all(1)
    i, j = i[same], j[same]
    if len(i) < 2 * AGREE:
        return None
    run = 2 * AGREE - 1
    whole = (i[run:] - i[:-run] == run) & (j[run:] - j[:-run] == run)
    at = np.flatnonzero(whole) + AGREE
    at = [k for k in at if left[i[k], 0] > left[i[k] - 1, 1] - 1 and text[left[i[k], 0] - 1] in " \n\t\r\f\v"]
    if not at:
        return None
    k = at[len(at) // 2]
    return int(i[k]), int(j[k])


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, chunk_chars: int = 32_768, overlap_chars: int = 512, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_chunks, n_widened for every row; narrow, no shuffle.

    Null and empty texts count 0. Repeated rows and rows without a doc_id come out as often as they come in; a text has the same count wherever it stands, however long it
    is; other columns are left out."""
    kind = id_type(docs, doc_id)

    def count(batches):
        counter = Counter(tokenizer_path, chunk_chars, overlap_chars)
        for part, _, offsets in slices(batches, text, rows=500):
            got = counter.many([t or "" for t in part.column(1).to_pylist()])
            tokens, chunks, widened = (pa.array([g[i] for g in got], pa.int64()) for i in range(3))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), tokens, pa.array(np.array([g[0] > limit for g in got], bool)), chunks, widened], ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks", "n_widened"])

    return unclashed(docs, doc_id, text).mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, n_chunks bigint, n_widened bigint")
