"""Chat formatting in budgeted windows.

A conversation becomes training windows of at most budget tokens. Prefix sums of its turns' tokens choose the longest span of whole turns that
fits beside what a window repeats: the system turn, and up to history turns before the span under a budget of their own. Only assistant texts of the
span itself are targets; a repeated turn is masked, so each assistant text is learned once.

Turns are marked by control strings. Where a text or role holds something like them, an escape character is added inside, which reading takes
off again.

Three steps: turns are rendered and counted where they lie; windows are cut from the turns' token counts alone, a stream of a few numbers a turn for each conversation, of which the
history is held; turns then join their windows, which are put together each by itself. So no task holds a conversation, and texts are dealt by window, however long a conversation is.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .packing import Encoder
from .shared import id_type, unclashed, written

START, END = "<|im_start|>", "<|im_end|>"
_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No control string is left: every '<', backslashes, '|' gets one backslash more."""
    return _OPEN.sub(lambda m: f"<\\{m[1]}|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"<{m[1]}|", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and where its text stands in it."""
    head = f"{START}{escape(role).replace('&', '&a').replace(chr(10), '&n')}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn."""
    out = []
    for turn in formatted.split(f"{END}\n")[:-1]:
        role, _, text = turn.removeprefix(START).partition("\n")
        out.append((unescape(role.replace("&n", "\n").replace("&a", "&")), unescape(text)))
    return out


class Cutter:
    """Cuts one conversation's turns, fed in order, into windows; holds the system turn and the history."""

    def __init__(self, budget: int, history: int, history_budget: int):
        self.budget, self.history_budget = budget, history_budget
        self.lead: tuple[int, int, int] | None = None
        self.past: deque[tuple[int, int, int]] = deque(maxlen=history)
        self.window, self.total, self.place = -1, 0, -1

    def fed(self, row: int, tokens: int, system: bool) -> list[tuple[int, int, int, bool]]:
        """(row, window, place, own) of the turn and, where it opens a window, of the turns that are repeated before it."""
        self.place += 1
        out = []
        if self.window < 0 or self.total + tokens > self.budget:
            self.window += 1
            kept = deque(self.past)
            total = sum(t for _, t, _ in kept)
            room = self.budget - (self.lead[1] if self.lead else 0)
            while kept and (total > self.history_budget or total + tokens > room):
                total -= kept.popleft()[1]
            out = [(r, self.window, p, False) for r, _, p in ([self.lead, *kept] if self.lead else kept)]
            self.total = self.budget - room + total
        self.total += tokens
        out.append((row, self.window, self.place, True))
        if system and self.place == 0:
            self.lead = (row, tokens, 0)
        else:
            self.past.append((row, tokens, self.place))
        return out


def chat_windows(conversations: DataFrame, tokenizer_path: str, budget: int = 2048, history: int = 4, history_budget: int = 512) -> DataFrame:
    """conv_id, window, text, n_repeated (turns at the head that are repeats), targets (code points of text under the loss), n_tokens, over_budget.

    Turns come by turn, a null one first, and those of one number by role and the hash of their text; null role and text are empty. A window is the longest span of turns that fits the budget
    beside its repeats: the first turn of a conversation, if its role is system, and the last `history` turns before the span, of which the first are left out until they fit. A turn that can't
    fit is a window of its own, marked over_budget, never cut. Repeated rows are repeated turns; rows without conv_id make one conversation; an empty table gives no rows; extra columns are left out."""
    kind = id_type(conversations, "conv_id")
    rows = unclashed(conversations, "conv_id", "turn", "role", "text").select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))

    def rendered(batches):
        encode = Encoder(tokenizer_path)
        for batch in batches:
            got = [render(r, t) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            texts, low, high = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1, 2, 4)), pa.array(texts, pa.string()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array([len(encode(t)) for t in texts], pa.int64())], ["conv_id", "turn", "role", "hash", "text", "low", "high", "n_tokens"])

    turns = rows.select("conv_id", "turn", "role", "text", "hash").mapInArrow(rendered, f"conv_id {kind}, turn bigint, role string, hash bigint, text string, low bigint, high bigint, n_tokens bigint")
    turns = written(turns.withColumn("row", F.monotonically_increasing_id()), "turns")

    def cut(batches):
        key, cutter = None, None
        for batch in batches:
            out, of = [], []
            for at, (conv, row, tokens, system) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)):
                if cutter is None or conv != key:
                    key, cutter = conv, Cutter(budget, history, history_budget)
                got = cutter.fed(row, tokens, system)
                out += got
                of += [at] * len(got)
            columns = zip(*out, strict=True) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True))], ["conv_id", "row", "window", "place", "own"])

    thin = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "hash").select("conv_id", "row", "n_tokens", (F.col("role") == "system").alias("system"))
    places = thin.mapInArrow(cut, f"conv_id {kind}, row bigint, window bigint, place bigint, own boolean")
    dealt = places.join(turns.select("row", "role", "text", "low", "high", "n_tokens"), "row").repartition("conv_id", "window").sortWithinPartitions("conv_id", "window", "place")
    out_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def formatted(batches):
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True)

        for (conv, window), own in itertools.groupby(rows(), lambda r: r[:2]):
            parts, at, targets, tokens, repeated = [], 0, [], 0, 0
            for _, _, mine, role, text, low, high, n in own:
                if mine and role == "assistant":
                    targets.append({"start": at + low, "end": at + high})
                repeated += not mine
                parts.append(text)
                at += len(text)
                tokens += n
            yield pa.RecordBatch.from_arrays([pa.array([conv], id_kind), pa.array([window], pa.int64()), pa.array(["".join(parts)]), pa.array([repeated], pa.int64()), pa.array([targets], out_type), pa.array([tokens], pa.int64()), pa.array([tokens > budget])], ["conv_id", "window", "text", "n_repeated", "targets", "n_tokens", "over_budget"])

    id_kind = to_arrow_type(conversations.schema["conv_id"].dataType)
    schema = f"conv_id {kind}, window bigint, text string, n_repeated bigint, targets array<struct<start:bigint,end:bigint>>, n_tokens bigint, over_budget boolean"
    return dealt.select("conv_id", "window", "own", "role", "text", "low", "high", "n_tokens").mapInArrow(formatted, schema)


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows: what the formatted windows say, each turn once.

    A digest over a conversation is one sequential sum by its nature: its windows pass through a task as a stream in order, of which only the
    sums are held."""
    kind = id_type(windows, "conv_id")

    def digests(batches):
        key, sums, seen = None, None, False

        def emit():
            turns, loss, n, chars, length, count = sums
            return pa.RecordBatch.from_arrays([pa.array([key], id_kind), pa.array([n], pa.int64()), pa.array([turns.hexdigest()]), pa.array([chars], pa.int64()), pa.array([loss.hexdigest()]), pa.array([length], pa.int64()), pa.array([count], pa.int64())], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"])

        for batch in batches:
            id_kind = batch.column(0).type
            for conv, text, repeated, targets in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if not seen or conv != key:
                    if seen:
                        yield emit()
                    key, sums, seen = conv, [hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0], True
                for role, body in parse(text)[repeated:]:
                    sums[0].update(f"{role}\n{body}\n".encode())
                    sums[2] += 1
                for t in targets:
                    body = unescape(text[t["start"] : t["end"]])
                    sums[1].update(body.encode())
                    sums[3] += len(body)
                sums[4] += len(text)
                sums[5] += 1
        if seen:
            yield emit()

    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.select("conv_id", "window", "text", "n_repeated", "targets").mapInArrow(digests, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint")
