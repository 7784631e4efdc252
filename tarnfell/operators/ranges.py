"""Order within groups of any size: rows are dealt in ranges of a global order, and only what a range hands to the next one crosses its borders.

A window over one group puts the group in one task. Here a group may lie over many ranges: what is needed from other ranges (the rows of a group before, the last and the first row
next door) is one row a range, which is broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stores import sized, written

_ROW_BITS = 33


def in_ranges(rows: DataFrame, keys: list[Column | str], name: str) -> DataFrame:
    """rows in ranges of the order by keys, written; adds _at, which rises along the order, and _range. Keys should tell rows apart: rows with equal keys share a range."""
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(dealt.withColumn("_at", F.monotonically_increasing_id()), name).withColumn("_range", F.shiftright("_at", _ROW_BITS))


def ranked(rows: DataFrame, by: list[str], order: list[Column | str], name: str = "ranks", carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows with place, groups with length): place counts from 0 within a group (columns by, null a value like others) in the given order, ascending, nulls first. carry: columns that are one
    value within a group, for the groups.

    Two levels: rows are counted for each range and group, the counts of a group's earlier ranges are summed, and the rest is a rank within range and group. A range starts at
    most one group that began before it, so the sums sent to all tasks are at most one row a range."""
    rows = in_ranges(rows, [*by, *order], name)
    counts = rows.groupBy("_range", *by).agg(F.count("*").alias("_n"), *[F.max(c).alias(c) for c in carry])
    earlier = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    carried = counts.withColumn("_before", earlier).where("_before > 0").select("_range", F.struct(*by).alias("_group"), "_before")
    local = F.row_number().over(Window.partitionBy("_range", *by).orderBy("_at")) - 1
    before = F.when(F.struct(*by).eqNullSafe(F.col("_group")), F.col("_before")).otherwise(0)
    placed = rows.withColumn("_local", local).join(F.broadcast(carried), "_range", "left").withColumn("place", F.col("_local") + before)
    return placed.drop("_at", "_range", "_local", "_group", "_before"), counts.groupBy(*by).agg(F.sum("_n").alias("length"), *[F.max(c).alias(c) for c in carry])


def neighbours(rows: DataFrame, by: list[str], order: list[Column | str], value: str, name: str = "neighbours") -> DataFrame:
    """rows with before and after: the value of the row next to it within its group, null at a group's ends. Give narrow rows: no text has a place here.

    Within a range by a window over the range; across ranges by the first and the last row of each, one row a range."""
    rows = in_ranges(rows, [*by, *order], name)
    own = F.struct(F.struct(*by).alias("group"), F.col(value).alias("value"))
    along = Window.partitionBy("_range").orderBy("_at")
    inside = rows.withColumns({"_own": own, "_prev": F.lag(own).over(along), "_next": F.lead(own).over(along)})
    ends = rows.groupBy("_range").agg(F.min_by(own, "_at").alias("_first"), F.max_by(own, "_at").alias("_last"))
    ranges = Window.orderBy("_range")  # one row a range
    ends = ends.select("_range", F.lag("_last").over(ranges).alias("_left"), F.lead("_first").over(ranges).alias("_right"))
    joined = inside.join(F.broadcast(ends), "_range", "left")
    near = lambda inner, outer: F.coalesce(inner, outer)
    same = lambda s: F.when(s["group"].eqNullSafe(F.col("_own.group")), s["value"])
    return joined.withColumns({"before": same(near(F.col("_prev"), F.col("_left"))), "after": same(near(F.col("_next"), F.col("_right")))}).drop("_at", "_range", "_own", "_prev", "_next", "_left", "_right")


def at_places(placed: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """The rows of placed (place within by) that wanted (by, place) names; a key is one row, so that no group is hot."""
    there = sized(wanted.select(*[F.col(f"`{c}`").alias(f"_w{i}") for i, c in enumerate([*by, "place"])]))
    meets = [F.col(f"`{c}`").eqNullSafe(F.col(f"_w{i}")) for i, c in enumerate(by)] + [F.col("place") == F.col(f"_w{len(by)}")]
    condition = meets[0]
    for m in meets[1:]:
        condition = condition & m
    return placed.join(there, condition, "left_semi")
