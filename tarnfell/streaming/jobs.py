"""The two streams: the sliding limit on calls in order of time, and continuous ingest of a folder of changes."""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import changes
from ..operators.usage import decide
from ..sources import manifest_log, stores


class Limiter(StatefulProcessor):
    """Calls of a key wait until the watermark has passed them, so that no earlier one can come, and are judged in order of time then, whatever micro-batches brought them. State: the waiting calls,
    and the times of allowed ones, max_calls at most, dropped once a window has passed without a call."""

    def __init__(self, max_calls: int, window: float):
        self.max_calls, self.window = max_calls, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t bigint, row binary")
        self.allowed = handle.getListState("allowed", "t bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t), pickle.dumps(row)) for pdf in rows for t, row in zip(_micros(pdf["ts"]), pdf.to_dict("records"), strict=True)]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(t for t, _ in new) // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        calls = list(self.waiting.get()) if self.waiting.exists() else []
        held = deque(sorted(t for (t,) in self.allowed.get()) if self.allowed.exists() else [])
        due, later = [c for c in calls if c[0] < until], [c for c in calls if c[0] >= until]
        if due:
            rows = sorted(((t, pickle.loads(row)) for t, row in due), key=lambda c: (c[0], c[1]["event_id"]))
            times = [t for t, _ in rows]
            got = [(True, 0.0)] * len(times) if self.max_calls <= 0 else decide(times, held, self.max_calls, self.window)
            yield pd.DataFrame([row for _, row in rows]).assign(allowed=[a for a, _ in got], retry_after=[w for _, w in got])
            _put(self.waiting, later)
        if held and not later and (until - held[-1]) / 1e6 >= self.window:
            held.clear()
        _put(self.allowed, [(t,) for t in held])
        if later:
            self.handle.registerTimer(min(t for t, _ in later) // 1000 + 1)
        elif held:
            self.handle.registerTimer((held[-1] + int(self.window * 1e6)) // 1000 + 1)

    def close(self) -> None:
        pass


def _micros(ts: pd.Series) -> list[int]:
    return ts.astype("datetime64[us]").astype("int64").tolist()


def _put(state, values: list) -> None:
    if values:
        state.put(values)
    elif state.exists():
        state.clear()


def rate_limit_stream(events: DataFrame, max_calls: int = 3, window: float = 60.0, lateness: str = "10 minutes") -> DataFrame:
    """rate_limit() over a stream (event_id, key, ts). A call is judged once the watermark (the latest time less lateness) has passed it; events later than that are dropped. The verdicts are those of
    the batch, in whatever order the calls arrive within the lateness. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    keyed = events.withWatermark("ts", lateness).groupBy("key")
    return keyed.transformWithStateInPandas(Limiter(max_calls, window), f"{fields}, allowed boolean, retry_after double", "Append", "EventTime")


def sync_stream(found: DataFrame, folder: str, ingest: Callable[[DataFrame], tuple[DataFrame, DataFrame]], checkpoint: str):
    """A stream of inventory rows (relative_path, document_id, hash, extension, size, mtime_ns) kept in step with index and manifest below folder; returns the query, not yet
    awaited. Files are new or changed, never gone: deletions need a whole inventory.

    ingest takes the planned rows to be read (relative_path, new) and returns (chunks, results) as outcomes() wants them. Each batch reads the manifest's records of its own paths, replaces the index'
    buckets that its documents fall in, then adds the changed records to the manifest's log under its number; a batch that is run again gives the same tables."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        where = f"{folder}/manifest"
        pointer = stores.log.latest(spark, where)
        if pointer.done >= number:
            return
        latest = rows.groupBy("relative_path").agg(F.max_by(F.struct("document_id", "hash", "extension", "size", "mtime_ns"), "mtime_ns").alias("r")).select("relative_path", "r.*")
        latest, used = stores.scratch(latest, "batch")
        plan = changes.plan_sync(manifest_log.read_log(spark, where, latest, pointer), latest).where("action <> 'delete'")
        chunks, results = ingest(plan.where("action in ('ingest_new', 'ingest_changed', 'retry')").select("relative_path", "new"))
        done = changes.outcomes(plan, results)
        stores.update_index(f"{folder}/index", latest, lambda old: changes.apply_sync(old, done, chunks), chunks)
        manifest_log.append(spark, where, changes.next_manifest(done.where("action not in ('unchanged', 'give_up')")), batch=number, pointer=pointer)
        stores.log.remove(spark, used)

    return found.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
