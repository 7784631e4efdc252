"""Tables that grow by segments: each change writes a segment of its own, and a numbered pointer names the segments that count. A reader takes the highest complete pointer, so it sees the
table before or after a change. Pointers are created, never replaced: of two writers that start from the same version, one gets the next number and the other a WriteConflict. (Atomic
where creating a file is, as on HDFS and local disks.)"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class WriteConflict(RuntimeError):
    """Another writer has published the version first: read again and repeat the change."""


@dataclass
class Pointer:
    """version: number of changes; segments: those that count, oldest first, each a dict with its name; done: the last batch number that is in them."""

    version: int = 0
    segments: list[dict] = field(default_factory=list)
    done: int = -1

    @property
    def names(self) -> list[str]:
        return [s["name"] for s in self.segments]


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def latest(spark: SparkSession, folder: str) -> Pointer:
    """The last published state; that of an empty table if there is none. A pointer that is still being written does not count."""
    fs, p = _path(spark, f"{folder}/published")
    if not fs.exists(p):
        return Pointer()
    for name in sorted((s.getPath().getName() for s in fs.listStatus(p)), reverse=True):
        if not name.startswith("v"):
            continue
        text = "".join(r[0] for r in spark.read.text(f"{folder}/published/{name}").collect())
        try:
            return Pointer(**json.loads(text))
        except ValueError:
            continue
    return Pointer()


def publish(spark: SparkSession, folder: str, pointer: Pointer) -> None:
    fs, p = _path(spark, f"{folder}/published/v{pointer.version:012d}.json")
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception):
            raise WriteConflict(f"version {pointer.version} of {folder} is there already") from e
        raise
    out.write(bytearray(json.dumps(pointer.__dict__), "utf-8"))
    out.close()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that no pointer names."""
    fs, p = _path(spark, path)
    fs.delete(p, True)


def sweep(spark: SparkSession, folder: str, tables: list[str], keep: list[str]) -> int:
    """Delete segments of the tables that are not in keep, as compaction and failed writers leave them; call it when no reader of an older version is at work. Returns how many."""
    gone = 0
    for table in tables:
        fs, p = _path(spark, f"{folder}/{table}")
        if fs.exists(p):
            for s in fs.listStatus(p):
                name = s.getPath().getName()
                if name.startswith("segment=") and name.removeprefix("segment=") not in keep:
                    fs.delete(s.getPath(), True)
                    gone += 1
    return gone
