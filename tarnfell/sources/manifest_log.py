"""The manifest as a log: a batch writes the records it changes, a reader takes the newest record of each path, and compaction writes what is left as one segment.

A segment lies in buckets of the path, so that a batch reads the buckets of its own paths only. Segments are published by pointers that are created once (log.py): a batch that is run again after it
was published changes nothing, and of two writers that start from one version the later gets a WriteConflict."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import log
from .stores import MANIFEST_SCHEMA, sized, validate_manifest

BUCKETS = 16
#: Segments from which append() compacts first.
SEGMENTS = 16
_SCHEMA = f"{MANIFEST_SCHEMA}, gone boolean, segment string, bucket int"


def _bucket(path: str = "relative_path"):
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


def _slashed(records: DataFrame) -> DataFrame:
    return records.withColumn("relative_path", F.regexp_replace("relative_path", r"\\", "/"))


def read_log(spark: SparkSession, folder: str, paths: DataFrame | None = None, pointer: log.Pointer | None = None) -> DataFrame:
    """The records as they are now; of the given paths (relative_path) only, if any are given. Empty if nothing was ever published."""
    pointer = pointer or log.latest(spark, folder)
    if not pointer.segments:
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    rows = spark.read.schema(_SCHEMA).parquet(f"{folder}/records").where(F.col("segment").isin(pointer.names))
    if paths is not None:
        paths = _slashed(paths.select("relative_path")).distinct()
        touched = [r[0] for r in paths.select(_bucket()).distinct().collect()]  # at most BUCKETS
        rows = rows.where(F.col("bucket").isin(touched)).join(sized(paths), "relative_path", "left_semi")
    age = F.array_position(F.array(*map(F.lit, pointer.names)), F.col("segment"))
    names = [c.split(" ")[0] for c in MANIFEST_SCHEMA.split(", ")]
    newest = rows.groupBy("relative_path").agg(F.max_by(F.struct(*names[1:], "gone"), age).alias("r"))
    return newest.where("not r.gone").select("relative_path", *[f"r.{c}" for c in names[1:]])


def _write(records: DataFrame, folder: str) -> dict:
    name = uuid.uuid4().hex
    dealt = records.withColumn("bucket", _bucket())
    dealt.repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/records/segment={name}")
    return {"name": name}


def append(spark: SparkSession, folder: str, records: DataFrame, gone: DataFrame | None = None, batch: int | None = None, pointer: log.Pointer | None = None) -> log.Pointer:
    """The log with new or changed records, and without the paths of gone. pointer: the version that they were worked out from, by default the last. A batch number that was published before adds
    nothing. Records need a path, a document_id and a hash, each path once."""
    pointer = pointer or log.latest(spark, folder)
    if batch is not None and pointer.done >= batch:
        return pointer
    records = _slashed(records.select([c.split(" ")[0] for c in MANIFEST_SCHEMA.split(", ")]))
    if not validate_manifest(records).first()["valid"]:
        raise ValueError("records without path, document_id or hash, or with one path twice")
    rows = records.withColumn("gone", F.lit(False))
    if gone is not None:
        rows = rows.unionByName(_slashed(gone.select("relative_path")).distinct().join(records.select("relative_path"), "relative_path", "left_anti").withColumn("gone", F.lit(True)), allowMissingColumns=True)
    if len(pointer.segments) >= SEGMENTS:
        pointer = compact(spark, folder, pointer)
    new = log.Pointer(pointer.version + 1, [*pointer.segments, _write(rows, folder)], pointer.done if batch is None else batch)
    log.publish(spark, folder, new)
    return new


def compact(spark: SparkSession, folder: str, pointer: log.Pointer | None = None) -> log.Pointer:
    """One segment with what the log says now. The old ones stay for their readers until sweep()."""
    pointer = pointer or log.latest(spark, folder)
    whole = read_log(spark, folder, pointer=pointer).withColumn("gone", F.lit(False))
    new = log.Pointer(pointer.version + 1, [_write(whole, folder)], pointer.done)
    log.publish(spark, folder, new)
    return new


def sweep(spark: SparkSession, folder: str) -> int:
    return log.sweep(spark, folder, ["records"], log.latest(spark, folder).names)
