"""Helpers that several operators use: labelled samples, joins with hot keys, connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.stores import written

__all__ = ["MAX_LABELLED_ROWS", "components", "few", "held_out", "id_type", "labelled_sample", "salted_join", "spanning_roots", "table", "unclashed", "written"]
#: Rows of labelled data that a model is fitted on at most; the only sample that the operators take.
MAX_LABELLED_ROWS = 12_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unclashed(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: whatever else a table has can't clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int = MAX_LABELLED_ROWS) -> DataFrame:
    """(doc_id, text, label) of at most limit labelled documents outside the held-out fifth, taken by the smallest hash of doc_id."""
    chosen = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return unclashed(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")


#: A key with more than one in HOT_SHARE of all rows, and more than HOT_ROWS of them, is hot: there are fewer hot keys than HOT_SHARE.
HOT_ROWS, HOT_SHARE = 4096, 1000


def salted_join(rows: DataFrame, keyed: DataFrame, on: list[str], by: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """rows joined with keyed on columns that are not null, hot keys of rows dealt by the column `by` over several tasks. counts (on, n): rows of each key, if known.
    Fewer than HOT_SHARE hot keys exist whatever the size, so they are broadcast. how: inner or left."""
    counts = rows.groupBy(*on).agg(F.count("*").alias("n")) if counts is None else counts
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(HOT_ROWS, total // HOT_SHARE)
    hot = F.broadcast(counts.where(F.col("n") > limit).select(*on, F.ceil(F.col("n") / limit).cast("int").alias("_salts")))
    dealt = rows.join(hot, on, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("_salts")).cast("int"))).drop("_salts")
    copies = keyed.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(copies, [*on, "_salt"], how).drop("_salt")


#: Narrow rows of a file, one or two MB.
FILE_ROWS = 1 << 16


def few(df: DataFrame, most: int | None, size: int = FILE_ROWS) -> DataFrame:
    """df, of about `most` rows or fewer, in at most as many partitions as these fill with `size` rows each. Partitions are only merged, so a large table keeps those it has; a small one
    would otherwise be written as a file for every shuffle partition (on a local disk Hadoop starts several processes for each file)."""
    return df if most is None else df.coalesce(max(1, -(-most // size)))


def components(edges: DataFrame, name: str = "components", most: int | None = None) -> DataFrame:
    """(node, root): the smallest node reachable over undirected edges (u, v). Alternates large-star and small-star steps
    (Kiveris et al., Connected Components in MapReduce and Beyond) until the edges are stars: every node has one edge to a centre that has none itself,
    so that nothing can change any more. One number a round reaches the driver. Nodes without edges are not listed. most: about how many edges there are at most, if known."""
    now = written(few(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), most), name)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        star = both.where("v > u").join(low, "u").select(F.col("v").alias("b"), F.col("m").alias("a")).where("a <> b").distinct()
        low = star.groupBy("b").agg(F.min("a").alias("m"))
        star = star.join(low, "b").select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("a").alias("v")), F.struct(F.col("m").alias("u"), F.col("b").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = written(few(star, most), name)
        ends = now.select(F.col("v").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("u").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")).distinct())
        loose = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1")
        if loose.agg(F.count("*")).first()[0] == 0:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def spanning_roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes reaches over edges (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def id_type(df: DataFrame, name: str = "doc_id") -> str:
    kind = df.schema[name].dataType
    return kind.simpleString() if isinstance(kind, T.DataType) else "bigint"
