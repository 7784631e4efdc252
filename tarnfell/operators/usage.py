"""Rollups of usage logs and the sliding limit on calls."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usage_by_operation(log: DataFrame) -> DataFrame:
    """operation, calls, input_tokens, output_tokens, total_tokens, and the grand total with operation null."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")]
    return log.rollup("operation").agg(F.count("*").alias("calls"), *sums).withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


def stage_metrics(log: DataFrame) -> DataFrame:
    """One row over a query log (retrieved_nodes, retrieval_s, generation_s, evaluation_s, cache_hit, evaluated, failed, corrected)."""
    stages = [c for s in ("retrieval", "generation", "evaluation") for c in (F.coalesce(F.sum(f"{s}_s"), F.lit(0.0)).alias(f"{s}_total_s"), F.avg(f"{s}_s").alias(f"{s}_mean_s"))]
    return log.agg(F.count("*").alias("queries"), F.coalesce(F.sum("retrieved_nodes"), F.lit(0)).alias("retrieved_nodes"), *stages, F.avg(F.col("cache_hit").cast("double")).alias("cache_hit_ratio"), F.count_if("evaluated").alias("evaluations"), F.count_if(F.col("evaluated") & F.col("failed")).alias("evaluation_failures"), F.count_if("corrected").alias("corrections"))


def decide(times: list[int], held: deque, max_calls: int, window: float) -> list[tuple[bool, float]]:
    """Verdicts for calls at rising times in microseconds; held are the allowed times that may still count, and is kept up."""
    out = []
    for t in times:
        while held and (t - held[0]) / 1e6 >= window:
            held.popleft()
        if len(held) >= max_calls:
            out.append((False, max(0.1, window - (t - held[0]) / 1e6)))
        else:
            held.append(t)
            out.append((True, 0.0))
    return out


def rate_limit(events: DataFrame, max_calls: int = 3, window: float = 60.0) -> DataFrame:
    """Adds allowed and retry_after (seconds) to events (event_id, key, ts). A call is allowed if fewer than max_calls allowed ones of its key are younger than window seconds;
    refused calls don't count; max_calls <= 0 allows all.

    Verdicts hang on earlier verdicts, so calls of a key are one stream of rows in time order, of which max_calls times are held, until it pauses: behind a stretch of time as long as a window
    and without any call everything starts afresh. Keys are dealt by such pauses, which are found on a key's stretches of time and not on its calls; a key that never pauses is one task."""
    if max_calls <= 0:
        return events.withColumns({"allowed": F.lit(True), "retry_after": F.lit(0.0)})
    from pyspark.sql import Window

    width = max(1, int(window * 1e6))
    rows = events.withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("_stretch", F.floor(F.col("_t") / width))
    by = Window.partitionBy("k").orderBy("s")
    stretches = rows.select(F.col("key").alias("k"), F.col("_stretch").alias("s")).distinct()
    runs = stretches.withColumn("_run", F.sum(F.coalesce(F.col("s") - F.lag("s").over(by) > 1, F.lit(True)).cast("int")).over(by))
    rows = rows.join(runs, F.col("key").eqNullSafe(F.col("k")) & (F.col("_stretch") == F.col("s"))).drop("k", "s", "_stretch")
    rows = rows.repartition("key", "_run").sortWithinPartitions("key", "_run", "ts", "event_id")

    def run(frames):
        last, held = None, deque()
        for pdf in frames:
            out = []
            for key, r, t in zip(pdf["key"], pdf["_run"], pdf["_t"], strict=True):
                if (key, r) != last:
                    last, held = (key, r), deque()
                out += decide([t], held, max_calls, window)
            yield pdf.drop(columns=["_run", "_t"]).assign(allowed=pd.array([a for a, _ in out], dtype="bool"), retry_after=[w for _, w in out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    return rows.mapInPandas(run, f"{fields}, allowed boolean, retry_after double")
