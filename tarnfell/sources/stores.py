"""Stored tables: the manifest as versioned snapshots behind pointers, the index in buckets of documents, scratch tables in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import log

MANIFEST_SCHEMA = "relative_path string, document_id string, hash string, extension string, size bigint, mtime_ns bigint, status string, indexed_nodes int, failure struct<hash:string,attempts:int,error:string>"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or one of this machine where that is unset and no other machine takes part (tests)."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.tarnfell.folder", "")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{os.path.realpath(tempfile.mkdtemp(prefix='spark-', dir='/tmp'))}"
        spark.conf.set("spark.tarnfell.folder", where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives lost executors. The user clears the folder."""
    return scratch(df, name)[0]


def scratch(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """written(), and the path, for those who remove it themselves."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def free_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of finished queries removed now. Spark removes them once the driver collects its garbage, which may not happen while several large tables are written one after the other."""
    spark._jvm.System.gc()


def sized(df: DataFrame, rows: int = 200_000, size: int = 32 << 20) -> DataFrame:
    """df to be broadcast if it proves to have at most that many rows and bytes (as JSON), else as it is."""
    n, m = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and m <= size else df


def validate_manifest(records: DataFrame) -> DataFrame:
    """One row: valid and records. Every record needs a path, a document_id and a hash, and paths must differ once backslashes are slashes."""
    path = F.regexp_replace("relative_path", r"\\", "/")
    full = path.isNotNull() & (path != "") & F.col("document_id").isNotNull() & F.col("hash").isNotNull()
    return records.agg(F.count("*").alias("records"), (F.coalesce(F.bool_and(full), F.lit(True)) & (F.count("*") == F.countDistinct(path))).alias("valid"))


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshot that was published last, with slashes in its paths; empty if nothing was ever published or if any record is invalid. What else goes wrong is raised: a
    manifest that can't be read is not an empty one."""
    number = latest_version(spark, folder)
    if number is not None:
        records = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder}/v={number}")
        if validate_manifest(records).first()["valid"]:
            return records.withColumn("relative_path", F.regexp_replace("relative_path", r"\\", "/"))
    return spark.createDataFrame([], MANIFEST_SCHEMA)


def latest_version(spark: SparkSession, folder: str) -> int | None:
    """The highest published version. Pointers are only ever added, and one that is not complete yet has no visible file, so readers see the version before it."""
    try:
        return spark.read.schema("version bigint").option("recursiveFileLookup", "true").json(f"{folder}/published").agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_manifest(manifest: DataFrame, folder: str, version: int) -> None:
    """Write the snapshot, then a pointer of its own: a reader sees the old or the new one, never none. Publish after the index. A version that was published is written anew only by a
    batch that is run again, with the same rows."""
    manifest.write.mode("overwrite").parquet(f"{folder}/v={version}")
    manifest.sparkSession.createDataFrame([(version,)], "version bigint").coalesce(1).write.mode("append").json(f"{folder}/published/n={version}")


def bucket_of(document_id: str, buckets: int):
    return F.pmod(F.hash(document_id), F.lit(buckets))


def write_index(table: DataFrame, path: str, buckets: int = 64, files: int = 1) -> None:
    """Write rows by bucket of document_id, each bucket as that many files. Only buckets that rows fall in are replaced, so give all rows of a touched bucket. Choose buckets and files by
    the size of the table: a file is written by one task."""
    dealt = table.withColumn("bucket", bucket_of("document_id", buckets))
    dealt.repartition("bucket", F.pmod(F.xxhash64("document_id"), F.lit(files))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def update_index(path: str, document_ids: DataFrame, updated: Callable[[DataFrame], DataFrame], empty: DataFrame, buckets: int = 64) -> None:
    """Rewrite the buckets of the given documents only: updated() gets their rows and returns the new ones. empty has the columns of an index that is not there yet."""
    spark = empty.sparkSession
    touched = [r[0] for r in document_ids.select(bucket_of("document_id", buckets)).distinct().collect()]  # at most as many as buckets
    try:
        old = spark.read.parquet(path).where(F.col("bucket").isin(touched)).select(empty.columns)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        old = empty.limit(0)
    table, where = scratch(updated(old), "index")
    write_index(table, path, buckets)
    log.remove(spark, where)
