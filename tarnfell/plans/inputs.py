"""The test tables as a document collection: files, an older manifest, an index, questions, answers, usage logs. Everything is derived from the given tables row by row, in an
expression text that Spark and the checking SQL share wherever both dialects allow it."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSION = "CASE doc_id % 8 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.py' WHEN 3 THEN '.csv' WHEN 4 THEN '.json' WHEN 5 THEN '.html' WHEN 6 THEN '.log' ELSE '.pdf' END"
NAME = f"CAST(doc_id AS STRING) || {EXTENSION}"
PATH = f"source || '/' || {NAME}"
#: Markdown rows get a heading, every fifth row a fence and an identifier, every seventh a table rule and a numbered heading: the documents have none of these.
BODY = (
    "(CASE WHEN doc_id % 8 = 0 THEN '# ' || source || chr(10) WHEN doc_id % 7 = 0 THEN '2.1 Part' || chr(10) ELSE '' END) || text || "
    "(CASE WHEN doc_id % 5 = 0 THEN chr(10) || '```' || chr(10) || '# no heading' || chr(10) || '```' || chr(10) || 'ref_' || CAST(doc_id AS STRING) ELSE '' END) || "
    "(CASE WHEN doc_id % 7 = 3 THEN chr(10) || '| a | b |' || chr(10) || '|---|:-:|' || chr(10) ELSE '' END)"
)
STATUS = "CASE WHEN doc_id % 13 = 5 THEN 'failed' ELSE 'indexed' END"
NODES = "CASE WHEN doc_id % 13 = 5 THEN 0 ELSE 1 + doc_id % 3 END"
#: What ingest of a file gives: chunks, and an error for every sixth.
CHUNKS = "CASE WHEN doc_id % 6 = 0 THEN 0 ELSE 1 + doc_id % 4 END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, relative_path, name, extension, text, source, size, mtime_ns, hash."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{PATH} AS relative_path", f"{NAME} AS name", f"{EXTENSION} AS extension", f"{BODY} AS text", "source")
    return docs.selectExpr("*", "CAST(octet_length(text) AS BIGINT) AS size", "doc_id * 1000 AS mtime_ns", "sha2(text, 256) AS hash")


FILES_SQL = f"""files AS (SELECT *, CAST(strlen(text) AS BIGINT) AS size, doc_id * 1000 AS mtime_ns, sha256(text) AS hash FROM
(SELECT doc_id, {PATH} AS relative_path, {NAME} AS name, {EXTENSION} AS extension, {BODY} AS text, source FROM documents))"""
ID_SQL = "sha256(lower(replace(relative_path, '\\', '/')))"


def manifest(files: DataFrame) -> DataFrame:
    """An older state: some files missing, some with another hash, size or failure, some records of files that are gone."""
    old = files.where("doc_id % 11 <> 3").selectExpr(
        "relative_path", "sha2(lower(relative_path), 256) AS document_id", "CASE WHEN doc_id % 7 = 2 THEN 'old' || hash ELSE hash END AS hash", "extension",
        "CASE WHEN doc_id % 7 = 2 THEN size + 1 ELSE size END AS size", "mtime_ns", f"{STATUS} AS status", f"CAST({NODES} AS INT) AS indexed_nodes",
        "CASE WHEN doc_id % 13 = 5 OR doc_id % 9 = 4 THEN named_struct('hash', CASE WHEN doc_id % 2 = 0 THEN hash ELSE 'x' END, 'attempts', CAST(1 + doc_id % 4 AS INT), 'error', 'parse') END AS failure",
    )
    gone = files.where("doc_id % 17 = 1").selectExpr("'gone/' || name AS relative_path", "sha2(lower('gone/' || name), 256) AS document_id", "hash", "extension", "size", "mtime_ns", "'indexed' AS status", "CAST(1 AS INT) AS indexed_nodes", "CAST(NULL AS STRUCT<hash:STRING,attempts:INT,error:STRING>) AS failure")
    return old.unionByName(gone)


MANIFEST_SQL = f"""manifest AS (SELECT doc_id, relative_path, {ID_SQL} AS document_id, CASE WHEN doc_id % 7 = 2 THEN 'old' || hash ELSE hash END AS hash, extension,
CASE WHEN doc_id % 7 = 2 THEN size + 1 ELSE size END AS size, mtime_ns, {STATUS} AS status, CAST({NODES} AS INT) AS indexed_nodes,
CASE WHEN doc_id % 13 = 5 OR doc_id % 9 = 4 THEN CASE WHEN doc_id % 2 = 0 THEN hash ELSE 'x' END END AS f_hash, CASE WHEN doc_id % 13 = 5 OR doc_id % 9 = 4 THEN CAST(1 + doc_id % 4 AS INT) END AS f_attempts,
CASE WHEN doc_id % 13 = 5 OR doc_id % 9 = 4 THEN 'parse' END AS f_error FROM files WHERE doc_id % 11 <> 3
UNION ALL SELECT doc_id, 'gone/' || name, sha256(lower('gone/' || name)), hash, extension, size, mtime_ns, 'indexed', 1, NULL, NULL, NULL FROM files WHERE doc_id % 17 = 1)"""


def inventory(files: DataFrame) -> DataFrame:
    return files.selectExpr("relative_path", "sha2(lower(relative_path), 256) AS document_id", "hash", "extension", "size", "mtime_ns")


def results(files: DataFrame) -> DataFrame:
    return files.selectExpr("relative_path", f"CAST({CHUNKS} AS INT) AS chunks", "CASE WHEN doc_id % 6 = 0 THEN 'no text' END AS error")


def index(manifest: DataFrame) -> DataFrame:
    """document_id, chunk_no: as many rows as the manifest counts."""
    return manifest.where("indexed_nodes > 0").select("document_id", F.explode(F.sequence(F.lit(1), "indexed_nodes")).alias("chunk_no"))


INDEX_SQL = "idx AS (SELECT document_id, unnest(range(1, indexed_nodes + 1)) AS chunk_no FROM manifest WHERE indexed_nodes > 0)"
PLAN_SQL = """plan AS (SELECT coalesce(m.relative_path, f.relative_path) AS relative_path, f.doc_id, m.relative_path IS NOT NULL AS known, f.relative_path IS NOT NULL AS present, m.status AS old_status,
m.hash AS old_hash, f.hash AS new_hash, m.document_id AS old_id, m.size AS old_size, f.size AS new_size, m.indexed_nodes AS old_nodes, m.f_hash, m.f_attempts, m.f_error,
CASE WHEN m.relative_path IS NULL THEN 'ingest_new' WHEN f.relative_path IS NULL THEN 'delete'
WHEN m.hash = f.hash THEN CASE WHEN m.status <> 'failed' THEN 'unchanged' WHEN coalesce(m.f_attempts, 0) >= 3 THEN 'give_up' ELSE 'retry' END
WHEN m.f_hash = f.hash AND m.f_attempts >= 3 THEN CASE WHEN m.status = 'failed' THEN 'give_up' ELSE 'unchanged' END ELSE 'ingest_changed' END AS action
FROM manifest m FULL JOIN files f ON m.relative_path = f.relative_path)"""
DONE_SQL = f"""done AS (SELECT *, CASE WHEN action = 'delete' THEN 'deleted' WHEN action = 'give_up' THEN 'given_up' WHEN action = 'unchanged' THEN 'unchanged' WHEN chunks > 0 THEN 'indexed'
WHEN NOT known OR old_status = 'failed' THEN 'failed' ELSE 'kept' END AS outcome FROM (SELECT *, {CHUNKS} AS chunks FROM plan))"""


def parts(files: DataFrame) -> DataFrame:
    """One part for each file, with identity."""
    from ..sources.files import attach_identity

    return attach_identity(files.select("relative_path", F.lit(0).alias("raw_index"), "text", "hash", "size"))


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one chunk of its source: chunk_id, document_id (the source), part_index, chunk_index, text, file_name, header_path."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id AS chunk_id", "source AS document_id", "0 AS part_index", "doc_id AS chunk_index", f"{BODY} AS text", f"{NAME} AS file_name", "source AS header_path")


def new_folder(spark: SparkSession, name: str) -> str:
    from ..sources.stores import shared_folder

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored_index(spark: SparkSession, sf_dir: str):
    """The index over doc_chunks in the shared folder, built by the first query that needs it and found again by the others as long as the files of the table are the same."""
    from ..operators.stored_index import LAYOUT, open_index, write_index
    from ..sources.stores import shared_folder

    files = table(spark, sf_dir, "documents").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    n, key = files.agg(F.count("*"), F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)"))).first()
    made = hashlib.sha1(f"{LAYOUT} {BODY} {NAME}".encode()).hexdigest()[:12]
    folder = f"{shared_folder(spark)}/index-{n}-{key}-{made}"
    return open_index(spark, folder) or write_index(doc_chunks(spark, sf_dir), folder)


CHUNKS_SQL = f"""chunks AS (SELECT *, lag(chunk_id) OVER (PARTITION BY document_id ORDER BY chunk_id) AS prev_chunk_id, lead(chunk_id) OVER (PARTITION BY document_id ORDER BY chunk_id) AS next_chunk_id FROM
(SELECT doc_id AS chunk_id, source AS document_id, doc_id AS chunk_index, {BODY} AS text, {NAME} AS file_name, source AS header_path FROM documents))"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark passages; every fourth begins with an identifier that a document holds."""
    return table(spark, sf_dir, "benchmark").selectExpr("item_id AS question_id", "(CASE WHEN item_id % 4 = 0 THEN 'what is ref_' || CAST(item_id * 5 AS STRING) || ' in ' ELSE '' END) || text AS question")


QUESTIONS_SQL = "questions AS (SELECT item_id AS question_id, (CASE WHEN item_id % 4 = 0 THEN 'what is ref_' || CAST(item_id * 5 AS STRING) || ' in ' ELSE '' END) || text AS question FROM benchmark)"

#: User turns as questions of all kinds.
ASKED = """CASE (conv_id + turn) % 12 WHEN 0 THEN 'Summarize all documents about ' || text WHEN 1 THEN 'ERR404?' WHEN 2 THEN 'compare these: ' || text WHEN 3 THEN 'what is in config.yaml and ' || text WHEN 4 THEN '  ' WHEN 5 THEN text || ' 12 and 13'
WHEN 6 THEN 'which ERROR code? ' || text WHEN 7 THEN 'getName' WHEN 8 THEN 'Why? How? ' || text WHEN 9 THEN ' ' || lower(text) || ' ' ELSE text END"""
ASKED_MODE = "CASE (conv_id + turn) % 9 WHEN 0 THEN 'BM25' WHEN 1 THEN 'vector' WHEN 2 THEN 'global' WHEN 3 THEN 'nonsense' ELSE 'auto' END"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").selectExpr("conv_id * 1000 + turn AS question_id", f"{ASKED} AS question", f"{ASKED_MODE} AS mode")


ASKED_SQL = f"asked AS (SELECT conv_id * 1000 + turn AS question_id, {ASKED} AS question, {ASKED_MODE} AS mode FROM conversations WHERE role = 'user')"

#: Assistant turns as answers that cite blocks and hold numbers and identifiers.
ANSWER = """text || ' [Context ' || CAST(turn % 7 AS STRING) || ', ' || CAST(conv_id % 5 AS STRING) || '] has 1,234 and ' || CAST(conv_id AS STRING) || '% of 7 in ref_' || CAST(conv_id % 50 AS STRING) || (CASE WHEN conv_id % 3 = 0 THEN ' [context 2]' ELSE '' END)"""
CONTEXT = "'held: 1234 ref_' || CAST(conv_id % 20 AS STRING) || ' ' || CAST(conv_id % 30 AS STRING) || ' ' || text"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, answer, contexts (one), n_blocks, status."""
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return rows.selectExpr("conv_id * 1000 + turn AS question_id", f"{ANSWER} AS answer", f"array({CONTEXT}) AS contexts", "CAST(conv_id % 4 AS INT) AS n_blocks", "CASE conv_id % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'unverified' ELSE 'no_evidence' END AS status", "conv_id", "turn")


ANSWERS_SQL = f"""answers AS (SELECT conv_id * 1000 + turn AS question_id, {ANSWER} AS answer, {CONTEXT} AS context, CAST(conv_id % 4 AS INT) AS n_blocks,
CASE conv_id % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'unverified' ELSE 'no_evidence' END AS status, conv_id, turn FROM conversations WHERE role = 'assistant')"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four documents for each conversation, from anywhere in the table, in an order of their own: question_id, chunk_id, score, rank."""
    ids = table(spark, sf_dir, "documents").agg((F.max("doc_id") + 1).alias("n"))  # one row
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").selectExpr("conv_id * 1000 + turn AS question_id", "conv_id")
    return rows.selectExpr("question_id", "explode(sequence(1, 4)) AS rank", "conv_id").crossJoin(F.broadcast(ids)).selectExpr("question_id", "(conv_id * 7919 + rank * 104729) % n AS chunk_id", "1.0D / (rank + conv_id % 3) AS score", "rank")


HITS_SQL = "hits AS (SELECT question_id, (conv_id * 7919 + rank * 104729) % (SELECT max(doc_id) + 1 FROM documents) AS chunk_id, CAST(1.0 AS DOUBLE) / (rank + conv_id % 3) AS score, rank FROM (SELECT conv_id * 1000 + turn AS question_id, unnest(range(1, 5)) AS rank, conv_id FROM conversations WHERE role = 'assistant'))"


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", "event_type AS operation", "CAST(floor(value) AS BIGINT) AS input_tokens", "CAST(event_id % 100 AS BIGINT) AS output_tokens", "user_id", "ts", "value")


def with_sql(final: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)} {final}" if ctes else final
