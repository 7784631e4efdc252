"""Joins whose keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one in HOT_SHARE of all rows, and more than HOT_ROWS of them, is hot: there are fewer hot keys than HOT_SHARE.
HOT_ROWS, HOT_SHARE = 4096, 1000


def salted_join(rows: DataFrame, keyed: DataFrame, on: list[str], by: str, how: str = "inner", counts: DataFrame | None = None, least: int = HOT_ROWS) -> DataFrame:
    """rows joined with keyed on columns that are not null, hot keys of rows dealt by the column `by` over several tasks. counts (on, n): rows of each key, if known.
    Fewer than HOT_SHARE hot keys exist whatever the size, so they are broadcast. how: inner or left. least: rows that a key has at least to be hot."""
    counts = rows.groupBy(*on).agg(F.count("*").alias("n")) if counts is None else counts
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(least, total // HOT_SHARE)
    hot = F.broadcast(counts.where(F.col("n") > limit).select(*on, F.ceil(F.col("n") / limit).cast("int").alias("_salts")))
    dealt = rows.join(hot, on, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("_salts")).cast("int"))).drop("_salts")
    copies = keyed.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(copies, [*on, "_salt"], how).drop("_salt")
