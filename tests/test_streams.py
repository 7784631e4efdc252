"""Streams give what the batch operators give; the manifest's log."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tarnfell.operators import changes, usage
from tarnfell.sources import log, manifest_log, stores
from tarnfell.streaming import jobs


@pytest.mark.parametrize("seed", [5, 6])
def test_rate_limit_stream(spark, tmp_path, seed):
    """Calls that arrive out of order over several micro-batches, within the lateness."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rnd = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    rows = sorted((start + datetime.timedelta(seconds=rnd.uniform(0, 600)), rnd.choice("abc")) for _ in range(120))
    rows += [(start + datetime.timedelta(seconds=4000 + i), "later") for i in range(2)]  # they move the watermark past the others
    df = spark.createDataFrame([(i, k, t) for i, (t, k) in enumerate(rows)], "event_id bigint, key string, ts timestamp")
    order = sorted(range(120), key=lambda i: i + rnd.uniform(-25, 25))
    for part in (order[:40], order[40:80], order[80:], [120], [121]):
        df.where(F.col("event_id").isin(part)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = jobs.rate_limit_stream(stream, 3, 60.0).writeStream.format("memory").queryName(f"limits{seed}").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    want = {r.event_id: (r.allowed, r.retry_after) for r in usage.rate_limit(df.where("key <> 'later'"), 3, 60.0).collect()}
    got = {r.event_id: (r.allowed, r.retry_after) for r in spark.table(f"limits{seed}").where("key <> 'later'").collect()}
    assert got == want and {a for a, _ in want.values()} == {True, False}


def test_sync_stream(spark, tmp_path):
    schema = "relative_path string, document_id string, hash string, extension string, size bigint, mtime_ns bigint"
    for batch in ([("a.txt", "1", "h1", ".txt", 1, 1), ("b.txt", "2", "h2", ".txt", 1, 1)], [("a.txt", "1", "h9", ".txt", 1, 2)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = jobs.sync_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), _ingest, str(tmp_path / "c"))
        query.processAllAvailable()
        query.stop()
    manifest = manifest_log.read_log(spark, f"{tmp_path}/out/manifest")
    assert {(r.relative_path, r.hash, r.indexed_nodes) for r in manifest.collect()} == {("a.txt", "h9", 1), ("b.txt", "h2", 1)}
    index = stores.read_index(spark, f"{tmp_path}/out/index")
    assert {(r.document_id, r.text) for r in index.collect()} == {("1", "h9"), ("2", "h2")}
    assert changes.integrity_check(manifest, index).first().passes
    # the second batch wrote the record that it changed, no more
    pointer = log.latest(spark, f"{tmp_path}/out/manifest")
    last = spark.read.parquet(f"{tmp_path}/out/manifest/records/segment={pointer.names[-1]}")
    assert [r.relative_path for r in last.collect()] == ["a.txt"] and pointer.done == 1


def _ingest(planned):
    return planned.select(F.col("new.document_id").alias("document_id"), F.col("new.hash").alias("text")), planned.select("relative_path", F.lit(1).alias("chunks"), F.lit(None).cast("string").alias("error"))


def record(spark, *rows):
    return spark.createDataFrame([(p, "d" + p, h, ".txt", 1, 1, "indexed", 1, None) for p, h in rows], stores.MANIFEST_SCHEMA)


def test_manifest_log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest_log, "SEGMENTS", 3)
    folder = str(tmp_path / "m")
    now = lambda paths=None: {r.relative_path: r.hash for r in manifest_log.read_log(spark, folder, paths).collect()}
    assert now() == {} and manifest_log.sweep(spark, folder) == 0
    manifest_log.append(spark, folder, record(spark, ("a", "1"), ("x\\b", "1")), batch=0)
    manifest_log.append(spark, folder, record(spark, ("a", "2"), ("c", "1")), batch=1)
    # a batch that is run again after its publication, and gone paths
    assert manifest_log.append(spark, folder, record(spark, ("a", "9")), batch=1).version == 2
    manifest_log.append(spark, folder, record(spark, ("d", "1")), gone=record(spark, ("x/b", "")), batch=2)
    assert now() == {"a": "2", "c": "1", "d": "1"}
    assert now(record(spark, ("c", ""), ("x/b", ""), ("z", ""))) == {"c": "1"}
    start = log.latest(spark, folder)
    manifest_log.append(spark, folder, record(spark, ("e", "1")), batch=3, pointer=start)  # compacts first
    assert len(log.latest(spark, folder).segments) == 2 and now() == {"a": "2", "c": "1", "d": "1", "e": "1"}
    with pytest.raises(log.WriteConflict):
        manifest_log.append(spark, folder, record(spark, ("f", "1")), pointer=start)
    assert "f" not in now()
    with pytest.raises(ValueError, match="one path twice"):
        manifest_log.append(spark, folder, record(spark, ("g", "1"), ("g", "2")))
    kept = len(log.latest(spark, folder).segments)
    assert manifest_log.sweep(spark, folder) >= 3 and len(log.latest(spark, folder).segments) == kept and len(now()) == 4
    # a pointer that is still being written does not count
    (tmp_path / "m" / "published" / "v000000000099.json").write_text('{"version": 99')
    assert len(now()) == 4
