"""Change capture: which files are new, changed, gone, to be tried again, and what becomes of manifest and index.

Only metadata is joined and shuffled; content is read for files whose size or time differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names

MAX_ATTEMPTS = 3


def content_hash(content: Column | str) -> Column:
    return F.sha2(F.col(content) if isinstance(content, str) else content, 256)


def resolve_path_collisions(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped): of paths with one document_id the first is kept; skipped ones name it in winner."""
    by_id = Window.partitionBy("document_id").orderBy("relative_path")
    ranked = files.withColumn("document_id", names.document_id("relative_path")).withColumns({"_n": F.row_number().over(by_id), "winner": F.first("relative_path").over(by_id)})
    return ranked.where("_n = 1").drop("_n", "winner"), ranked.where("_n > 1").select("relative_path", "winner")


def inventory(files: DataFrame, manifest: DataFrame, content: DataFrame) -> DataFrame:
    """files (relative_path, size, mtime_ns) with document_id, extension and hash. The manifest's hash is kept where size and time match; the others are
    hashed from content (relative_path, content), of which only their rows are read."""
    known = manifest.select("relative_path", F.col("hash").alias("known"), F.col("size").alias("_size"), F.col("mtime_ns").alias("_time"))
    listed = files.join(known, "relative_path", "left").withColumn("known", F.when((F.col("size") == F.col("_size")) & (F.col("mtime_ns") == F.col("_time")), F.col("known"))).drop("_size", "_time")
    fresh = content.join(listed.where("known is null").select("relative_path"), "relative_path", "left_semi").select("relative_path", content_hash("content").alias("fresh"))
    out = listed.join(fresh, "relative_path", "left").withColumns({"hash": F.coalesce("known", "fresh"), "reused": F.col("known").isNotNull(), "document_id": names.document_id("relative_path"), "extension": names.extension(names.file_name("relative_path"))})
    return out.drop("known", "fresh")


def plan_sync(manifest: DataFrame, found: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """relative_path, action, old (the record or null), new (the inventory row or null)."""
    old = manifest.select("relative_path", F.struct("document_id", "hash", "extension", "size", "mtime_ns", "status", "indexed_nodes", "failure").alias("old"))
    new = found.select("relative_path", F.struct("document_id", "hash", "extension", "size", "mtime_ns").alias("new"))
    both = old.join(new, "relative_path", "full_outer")
    failed = F.col("old.status") == "failed"
    spent = F.coalesce(F.col("old.failure.attempts") >= max_attempts, F.lit(False))
    same = F.col("old.hash") == F.col("new.hash")
    known_bad = F.coalesce(F.col("old.failure.hash") == F.col("new.hash"), F.lit(False)) & spent
    action = (
        F.when(F.col("old").isNull(), "ingest_new")
        .when(F.col("new").isNull(), "delete")
        .when(same & failed & ~spent, "retry")
        .when(same & failed, "give_up")
        .when(same, "unchanged")
        .when(known_bad, F.when(failed, "give_up").otherwise("unchanged"))
        .otherwise("ingest_changed")
    )
    return both.select("relative_path", action.alias("action"), "old", "new")


def failure_record(old_failure: Column, hash_: Column, error: Column) -> Column:
    attempts = F.when(old_failure["hash"] == hash_, old_failure["attempts"] + 1).otherwise(1)
    return F.struct(hash_.alias("hash"), attempts.cast("int").alias("attempts"), error.alias("error"))


def outcomes(plan: DataFrame, results: DataFrame) -> DataFrame:
    """plan with chunks, error and outcome. results: relative_path, chunks (rows made), error. Outcomes: indexed, failed (never indexed), kept (the old record
    stays, with the failure), deleted, unchanged, given_up."""
    tried = plan.join(results, "relative_path", "left")
    ingested = F.col("action").isin("ingest_new", "ingest_changed", "retry")
    never = F.col("old").isNull() | (F.col("old.status") == "failed")
    outcome = F.when(~ingested, F.when(F.col("action") == "delete", "deleted").when(F.col("action") == "give_up", "given_up").otherwise("unchanged")).when(F.coalesce("chunks", F.lit(0)) > 0, "indexed").when(never, "failed").otherwise("kept")
    return tried.withColumn("outcome", outcome)


def next_manifest(done: DataFrame) -> DataFrame:
    """The manifest after outcomes(). A changed file that failed keeps its old record whole, with the failure beside it."""
    failure = failure_record(F.col("old.failure"), F.col("new.hash"), F.coalesce("error", F.lit("no content")))
    none = F.lit(None).cast("struct<hash:string,attempts:int,error:string>")
    fresh = F.col("outcome").isin("indexed", "failed")
    of = lambda name: F.when(fresh, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}")).alias(name)
    return done.where("outcome <> 'deleted'").select(
        "relative_path",
        *[of(c) for c in ("document_id", "hash", "extension", "size", "mtime_ns")],
        F.when(F.col("outcome") == "indexed", "indexed").when(F.col("outcome") == "failed", "failed").otherwise(F.col("old.status")).alias("status"),
        F.when(F.col("outcome") == "indexed", F.col("chunks").cast("int")).when(F.col("outcome") == "failed", F.lit(0)).otherwise(F.col("old.indexed_nodes")).alias("indexed_nodes"),
        F.when(F.col("outcome") == "indexed", none).when(F.col("outcome").isin("failed", "kept"), failure).otherwise(F.col("old.failure")).alias("failure"),
    )


def apply_sync(index: DataFrame, done: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """index without the documents that were indexed anew or deleted, with the new chunks of the indexed ones. Failed files keep their chunks."""
    gone = done.where("outcome in ('indexed', 'deleted')").select(F.coalesce("old.document_id", "new.document_id").alias("document_id")).distinct()
    fresh = done.where("outcome = 'indexed'").select(F.col("new.document_id").alias("document_id")).distinct()
    return index.join(gone, "document_id", "left_anti").unionByName(new_chunks.join(fresh, "document_id", "left_semi").select(index.columns))


def _bucket() -> Column:
    return F.when(F.col("outcome") == "indexed", F.when(F.col("old").isNull(), "added").otherwise("updated")).when(F.col("outcome").isin("failed", "kept", "given_up"), "failed").otherwise(F.col("outcome"))


def sync_report(done: DataFrame) -> DataFrame:
    """bucket, files: how many were added, updated, deleted, unchanged, failed (with those given up)."""
    return done.groupBy(_bucket().alias("bucket")).agg(F.count("*").alias("files"))


def sync_changes(done: DataFrame) -> DataFrame:
    """relative_path, bucket of every file that is not unchanged; a row each, nothing is gathered."""
    return done.select("relative_path", _bucket().alias("bucket")).where("bucket <> 'unchanged'")


def integrity_check(manifest: DataFrame, index: DataFrame) -> DataFrame:
    """One row: expected, actual, passes. Passes also when a record that is not failed has no count."""
    live = manifest.where("status is null or status <> 'failed'").agg(F.coalesce(F.sum("indexed_nodes"), F.lit(0)).alias("expected"), F.count_if(F.col("indexed_nodes").isNull()).alias("uncounted"))
    return live.crossJoin(index.agg(F.count("*").alias("actual"))).select("expected", "actual", ((F.col("uncounted") > 0) | (F.col("expected") == F.col("actual"))).alias("passes"))


def remove_documents(index: DataFrame, manifest: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index, manifest, flags): without the named paths; flags has relative_path and removed for each name. A failed record leaves the manifest only."""
    named = paths.select(F.regexp_replace(F.regexp_replace("relative_path", r"\\", "/"), "^/+", "").alias("relative_path")).distinct()
    known = manifest.select("relative_path", "document_id", "status")
    hit = named.join(known, "relative_path")
    ids = hit.where("status is null or status <> 'failed'").select("document_id").distinct()
    flags = named.join(known.select("relative_path", F.lit(True).alias("_known")), "relative_path", "left").select("relative_path", F.coalesce("_known", F.lit(False)).alias("removed"))
    return index.join(ids, "document_id", "left_anti"), manifest.join(named, "relative_path", "left_anti"), flags


def rebuild_reason(manifest: DataFrame, index: DataFrame) -> DataFrame:
    """One row: reason to build everything anew, or null: no index, no manifest, or counts that differ."""
    counts = integrity_check(manifest, index).crossJoin(manifest.agg(F.count("*").alias("records")))
    return counts.select(F.when((F.col("records") == 0) & (F.col("actual") == 0), "nothing is indexed").when(F.col("actual") == 0, "the index is empty").when(F.col("records") == 0, "the manifest is empty").when(~F.col("passes"), "manifest and index differ").alias("reason"))


def rebuild_plan(manifest: DataFrame, found: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """plan_sync() for an empty index: every file is ingested but those whose failures are spent."""
    plan = plan_sync(manifest, found, max_attempts).where("new is not null")
    spent = (F.col("action") == "give_up") | ((F.col("action") == "unchanged") & (F.coalesce(F.col("old.failure.hash") == F.col("new.hash"), F.lit(False))) & F.coalesce(F.col("old.failure.attempts") >= max_attempts, F.lit(False)))
    return plan.withColumn("action", F.when(spent, "give_up").otherwise("ingest_new"))


def document_listing(manifest: DataFrame) -> DataFrame:
    return manifest.select("relative_path", F.coalesce("status", F.lit("indexed")).alias("status"), "extension", "size", F.coalesce("indexed_nodes", F.lit(0)).alias("indexed_nodes"), F.col("failure.error").alias("error"), F.col("failure.attempts").alias("attempts")).orderBy("relative_path")


def corpus_status(manifest: DataFrame, index: DataFrame) -> DataFrame:
    """One row: documents, indexed, failed, nodes."""
    failed = F.col("status") == "failed"
    return manifest.agg(F.count("*").alias("documents"), F.count_if(F.coalesce(~failed, F.lit(True))).alias("indexed"), F.count_if(failed).alias("failed")).crossJoin(index.agg(F.count("*").alias("nodes")))
