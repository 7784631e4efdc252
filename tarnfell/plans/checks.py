"""Queries over answer checks, usage logs and the limit on calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import usage, verify
from ..streaming import jobs
from . import inputs as given
from .inputs import ANSWERS_SQL, CHUNKS_SQL, HITS_SQL, with_sql

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


_CLEAN = "replace(replace(replace({}, '[BEGIN CONTEXT]', '[begin context]'), '[END CONTEXT]', '[end context]'), '\"\"\"', '''''''')"


@query(with_sql(f"""SELECT question_id, CAST(count(*) AS INT) AS n_blocks, sha256(string_agg('[Context ' || CAST(rank AS STRING) || ' | Source: ' || file_name || ' > ' || header_path || ']' || chr(10) || {_CLEAN.format('text')}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS blocks_sha256 FROM hits JOIN chunks USING (chunk_id) GROUP BY question_id""", HITS_SQL, CHUNKS_SQL))
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verify.context_blocks(given.hits(spark, sf_dir).withColumnRenamed("rank", "place"), given.doc_chunks(spark, sf_dir))
    return rows.select("question_id", "n_blocks", F.sha2("blocks", 256).alias("blocks_sha256"))


#: Literals by word lists: a number starts a word, an identifier is a whole run of word characters and hyphens that fits.
LITERALS = """bare AS (SELECT *, regexp_replace(answer, '(?i)\\[Context\\s+([0-9]+(?:\\s*,\\s*[0-9]+)*)\\]', ' ', 'g') AS body FROM answers),
numbered AS (SELECT *, list_transform(regexp_extract_all(body, '(?:^|[^\\p{L}\\p{N}_])([0-9][0-9,]*(?:\\.[0-9]+)?%?)', 1), lambda t: t) AS nums, regexp_extract_all(body, '(?:^|[^\\p{L}\\p{N}_])((?:[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+)|(?:[A-Za-z]+-?[0-9][A-Za-z0-9]*))', 1) AS idents FROM bare),
literals AS (SELECT *, list_concat(list_filter(nums, lambda t: length(regexp_replace(t, '[^0-9]', '', 'g')) >= 2 OR contains(t, '%') OR contains(t, '.')), idents) AS every FROM numbered),
distinct_literals AS (SELECT *, list_filter(every, lambda t, i: list_position(every, t) = i) AS lits FROM literals)"""


@query(with_sql("SELECT question_id, array_to_string(lits, ' ') AS literals FROM distinct_literals", ANSWERS_SQL, LITERALS))
def answer_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given.answers(spark, sf_dir).select("question_id", F.array_join(verify.extract_literals("answer"), " ").alias("literals"))


_NORMAL = "regexp_replace(regexp_replace(lower({}), '([0-9]),([0-9])', '\\1\\2', 'g'), '([0-9]),([0-9])', '\\1\\2', 'g')"


@query(with_sql(f"SELECT question_id, array_to_string(list_slice(list_filter(lits, lambda t: NOT contains({_NORMAL.format('context')}, regexp_replace({_NORMAL.format('t')}, '%+$', ''))), 1, 8), ' ') AS missing FROM distinct_literals", ANSWERS_SQL, LITERALS))
def ungrounded_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given.answers(spark, sf_dir).select("question_id", F.array_join(verify.ungrounded_literals("answer", "contexts"), " ").alias("missing"))


CITED = """cited AS (SELECT *, flatten(list_transform(regexp_extract_all(answer, '(?i)\\[Context\\s+([0-9]+(?:\\s*,\\s*[0-9]+)*)\\]', 1), lambda g: regexp_extract_all(g, '[0-9]+'))) AS numbers FROM answers),
faults AS (SELECT *, list_filter(numbers, lambda c: CAST(c AS INT) NOT BETWEEN 1 AND n_blocks) AS bad FROM cited)"""
_BAD = "list_transform(list_filter(bad, lambda t, i: list_position(bad, t) = i), lambda c: '[Context ' || c || ']')"


@query(with_sql(f"SELECT question_id, array_to_string({_BAD}, ' ') AS invalid FROM faults", ANSWERS_SQL, CITED))
def invalid_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given.answers(spark, sf_dir).select("question_id", F.array_join(verify.invalid_citations("answer", "n_blocks"), " ").alias("invalid"))


@query(with_sql("""SELECT h.question_id, h.chunk_id, CAST(h.rank AS INT) AS context FROM hits h JOIN cited c USING (question_id) WHERE c.status <> 'no_evidence' AND (c.status <> 'verified' OR len(list_filter(numbers, lambda n: CAST(n AS INT) BETWEEN 1 AND 4)) = 0 OR list_contains(list_transform(numbers, lambda n: CAST(n AS INT)), h.rank))""", ANSWERS_SQL, CITED, HITS_SQL))
def cited_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.cited_sources(given.answers(spark, sf_dir).select("question_id", "answer", "status"), given.hits(spark, sf_dir).withColumnRenamed("rank", "place")).select("question_id", "chunk_id", "context")


@query(with_sql("SELECT h.question_id, CAST(h.rank AS INT) AS context, c.document_id, 'path/' || c.document_id AS relative_path, c.file_name, round_even(h.score, 4) AS score, substr(regexp_replace(c.text, '^\\s+|\\s+$', '', 'g'), 1, 240) || CASE WHEN length(regexp_replace(c.text, '^\\s+|\\s+$', '', 'g')) > 240 THEN '...' ELSE '' END AS snippet FROM hits h JOIN chunks c USING (chunk_id)", HITS_SQL, CHUNKS_SQL))
def source_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = given.doc_chunks(spark, sf_dir)
    paths = rows.select("document_id", F.concat(F.lit("path/"), F.col("document_id")).alias("relative_path")).distinct()
    return verify.source_payload(given.hits(spark, sf_dir).withColumnRenamed("rank", "context"), rows, paths).select("question_id", "context", "document_id", "relative_path", "file_name", "score", "snippet")


#: What a judge may return: well-formed, string booleans, a scalar issue, a missing key, broken JSON.
JUDGED = """CASE conv_id % 6 WHEN 0 THEN '{"relevant": true, "faithful": true, "complete": true, "verdict": "PASS", "issues": []}' WHEN 1 THEN '{"relevant": "Yes", "faithful": 1, "complete": "no", "verdict": "pass", "issues": "too short"}'
WHEN 2 THEN '{"relevant": true, "faithful": true, "verdict": "PASS", "issues": []}' WHEN 3 THEN 'broken {' WHEN 4 THEN '{"relevant": 0, "faithful": "maybe", "complete": "y", "verdict": "FAIL", "issues": ["a", " ", "b"]}' ELSE '{"relevant": "TRUE", "faithful": "true", "complete": 1.0, "verdict": "FAIL", "issues": null}' END"""
EVALUATED = f"""evaluated AS (SELECT *, CASE WHEN n_blocks = 0 THEN 'none' WHEN conv_id % 6 IN (2, 3) THEN 'broken' ELSE 'read' END AS kind, conv_id % 6 IN (0, 1, 5) AS r, conv_id % 6 IN (0, 1, 5) AND len(bad) = 0 AS f, conv_id % 6 IN (0, 4, 5) AS c FROM faults),
judged AS (SELECT *, kind = 'read' AND r AS relevant, kind = 'read' AND f AS faithful, kind = 'read' AND c AS complete, CASE WHEN kind = 'read' AND r AND f AND c THEN 'PASS' ELSE 'FAIL' END AS verdict, kind = 'broken' AS evaluation_error,
CASE kind WHEN 'none' THEN 'Nothing was retrieved.' WHEN 'broken' THEN 'The judgement is not readable.' ELSE concat_ws('; ', CASE conv_id % 6 WHEN 1 THEN 'too short' WHEN 4 THEN 'a; b' END, CASE WHEN len(bad) > 0 THEN 'Cited blocks do not exist: ' || array_to_string({_BAD}, ', ') || '.' END) END AS issues FROM evaluated)"""


def _judged(spark, sf_dir):
    return verify.normalize_judgement(given.answers(spark, sf_dir).withColumn("judgement", F.expr(JUDGED)))


@query(with_sql("SELECT question_id, relevant, faithful, complete, verdict, evaluation_error, issues FROM judged", ANSWERS_SQL, CITED, EVALUATED))
def judge_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("question_id", "evaluation.*").withColumn("issues", F.array_join("issues", "; "))


@query(with_sql("SELECT question_id, CASE WHEN missing = '' THEN '' ELSE 'missing' END || CASE WHEN invalid = '' THEN '' ELSE ' invalid' END AS kinds FROM (SELECT l.question_id, l.lits, array_to_string(list_filter(l.lits, lambda t: NOT contains(" + _NORMAL.format("l.context") + ", regexp_replace(" + _NORMAL.format("t") + ", '%+$', ''))), ' ') AS missing, array_to_string(list_filter(c.numbers, lambda n: CAST(n AS INT) <> 1), ' ') AS invalid FROM distinct_literals l JOIN cited c USING (question_id))", ANSWERS_SQL, LITERALS, CITED))
def judge_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verify.judge_hints(given.answers(spark, sf_dir))
    return rows.select("question_id", F.concat(F.when(F.col("hints").contains("no context holds"), "missing").otherwise(""), F.when(F.col("hints").contains("do not exist"), " invalid").otherwise("")).alias("kinds"))


_STEP_INPUT = {"mode": "CASE conv_id % 5 WHEN 0 THEN 'semantic' WHEN 1 THEN 'keyword' WHEN 2 THEN 'hybrid' WHEN 3 THEN 'summary' ELSE 'semantic' END", "attempt": "CAST(1 + turn % 3 AS INT)", "recovered": "conv_id % 7 = 0", "recovery_changed": "conv_id % 4 <> 1"}


@query(with_sql(f"""SELECT question_id, CASE WHEN verdict = 'PASS' THEN 'done' WHEN attempt >= 3 OR evaluation_error THEN 'stop' WHEN relevant THEN 'self_correct' WHEN NOT recovered AND mode NOT IN ('hybrid', 'summary') AND recovery_changed THEN 'recover_hybrid' ELSE 'stop' END AS step
FROM (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _STEP_INPUT.items())} FROM judged)""", ANSWERS_SQL, CITED, EVALUATED))
def next_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _judged(spark, sf_dir).withColumns({n: F.expr(e) for n, e in _STEP_INPUT.items()})
    return verify.next_step(rows).select("question_id", "step")


@query(with_sql("""SELECT question_id, len(list_filter(b, lambda x: true)) > 0 AND a <> b AS recovery_changed FROM (SELECT question_id, list_sort(list_distinct(list(chunk_id) FILTER (WHERE rank <= 2))) AS a, list_sort(list_distinct(list(chunk_id) FILTER (WHERE (question_id % 3 = 0 AND rank <= 2) OR (question_id % 3 = 1 AND rank >= 2)))) AS b FROM hits GROUP BY question_id)""".replace("len(list_filter(b, lambda x: true)) > 0 AND a <> b", "coalesce(len(b), 0) > 0 AND a <> b"), HITS_SQL))
def recovery_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = given.hits(spark, sf_dir)
    return verify.recovery_changed(rows.where("rank <= 2"), rows.where("(question_id % 3 = 0 AND rank <= 2) OR (question_id % 3 = 1 AND rank >= 2)"))


#: Attempts of a conversation are its assistant turns.
ATTEMPTS = """tries AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS attempt, (conv_id + turn) % 11 = 0 AS failed_call FROM judged),
tried AS (SELECT conv_id, min(CASE WHEN verdict = 'PASS' THEN attempt END) AS won, max(attempt) AS last FROM tries WHERE attempt <= 3 GROUP BY conv_id),
ended AS (SELECT c.conv_id, c.conv_id % 23 <> 4 AS ready, c.conv_id % 13 AS n_hits, t.won, coalesce(t.won, t.last, 0) AS attempts, l.failed_call, l.relevant, l.evaluation_error FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN tried t USING (conv_id) LEFT JOIN tries l ON l.conv_id = c.conv_id AND l.attempt = t.last)"""


@query(with_sql("""SELECT conv_id AS question_id, status, status = 'verified' AS verified, CAST(attempts AS INT) AS attempts, status IN ('verified', 'unverified', 'error') AS show_sources FROM (SELECT *, CASE WHEN NOT ready THEN 'not_ready' WHEN n_hits = 0 THEN 'no_evidence' WHEN won IS NOT NULL THEN 'verified' WHEN coalesce(failed_call, true) THEN 'error' WHEN NOT relevant AND NOT evaluation_error THEN 'no_evidence' ELSE 'unverified' END AS status FROM ended)""", ANSWERS_SQL, CITED, EVALUATED, ATTEMPTS))
def answer_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    tries = _judged(spark, sf_dir).select(F.col("conv_id").alias("question_id"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("attempt"), "answer", F.expr("(conv_id + turn) % 11 = 0").alias("failed_call"), "evaluation")
    asked = given.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("question_id")).distinct().select("question_id", F.expr("question_id % 23 <> 4").alias("ready"), F.expr("question_id % 13").alias("n_hits"))
    return verify.resolve_status(asked, tries).select("question_id", "status", "verified", "attempts", "show_sources")


#: The hints of judge_hints and the prompt around them, in the words of the library.
_RULE = 'Judge the answer by the context blocks alone. Reply with JSON only: {"relevant": bool, "faithful": bool, "complete": bool, "verdict": "PASS" or "FAIL", "issues": [texts]}. PASS needs all three.'
PROMPTED = f"""blocked AS (SELECT question_id, string_agg('[Context ' || CAST(rank AS STRING) || ' | Source: ' || file_name || ' > ' || header_path || ']' || chr(10) || {_CLEAN.format('text')}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS blocks FROM hits JOIN chunks USING (chunk_id) GROUP BY question_id),
hinted AS (SELECT question_id, conv_id, answer, list_slice(list_filter(lits, lambda t: NOT contains({_NORMAL.format('context')}, regexp_replace({_NORMAL.format('t')}, '%+$', ''))), 1, 8) AS missing,
list_filter(list_transform(regexp_extract_all(array_to_string(regexp_extract_all(answer, '(?i)\\[Context\\s+([0-9]+(?:\\s*,\\s*[0-9]+)*)\\]', 1), ' '), '[0-9]+'), lambda t: CAST(t AS INT)), lambda n: n < 1 OR n > 1) AS bad FROM distinct_literals),
wrong AS (SELECT * REPLACE (list_filter(bad, lambda n, i: list_position(bad, n) = i) AS bad) FROM hinted),
said AS (SELECT *, concat_ws(chr(10), CASE WHEN len(missing) > 0 THEN 'Values of the answer that no context holds: ["' || array_to_string(missing, '","') || '"]. Each is unsupported unless it is simple arithmetic on values that are there.' END,
CASE WHEN len(bad) > 0 THEN 'Blocks that the answer cites but that do not exist: ["[Context ' || array_to_string(bad, ']","[Context ') || ']"]. That makes it unfaithful.' END) AS hints FROM wrong)"""


@query(with_sql(f"""SELECT question_id, sha256('{_RULE}' || chr(10) || chr(10) || 'QUESTION:' || chr(10) || 'What of ' || CAST(conv_id AS STRING) || '?' || chr(10) || chr(10) || 'ANSWER:' || chr(10) || answer || chr(10) || chr(10) ||
CASE WHEN hints <> '' THEN 'HINTS:' || chr(10) || hints || chr(10) || chr(10) ELSE '' END || '[BEGIN CONTEXT]' || chr(10) || blocks || chr(10) || '[END CONTEXT]') AS prompt_sha256 FROM said JOIN blocked USING (question_id)""", HITS_SQL, CHUNKS_SQL, ANSWERS_SQL, LITERALS, PROMPTED))
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = verify.context_blocks(given.hits(spark, sf_dir).withColumnRenamed("rank", "place"), given.doc_chunks(spark, sf_dir)).drop("contexts", "n_blocks")
    rows = verify.judge_hints(given.answers(spark, sf_dir)).join(blocks, "question_id").withColumn("question", F.concat(F.lit("What of "), F.col("conv_id").cast("string"), F.lit("?")))
    return verify.build_prompts(rows, "judge").select("question_id", F.sha2("prompt", 256).alias("prompt_sha256"))


@query("""SELECT operation, calls, input_tokens, output_tokens, input_tokens + output_tokens AS total_tokens FROM (SELECT event_type AS operation, count(*) AS calls, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS input_tokens, CAST(sum(event_id % 100) AS BIGINT) AS output_tokens FROM events GROUP BY ROLLUP (event_type))""")
def usage_by_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.usage_by_operation(given.usage_log(spark, sf_dir))


_LOG = {"retrieved_nodes": "event_id % 9", "retrieval_s": "round(value, 2) / 100", "generation_s": "CAST(event_id % 50 AS DOUBLE) / 10", "evaluation_s": "CAST(event_id % 30 AS DOUBLE) / 10", "cache_hit": "event_id % 4 = 0", "evaluated": "event_id % 3 <> 0", "failed": "event_id % 5 = 0", "corrected": "event_id % 10 = 0"}


@query(f"""SELECT count(*) AS queries, CAST(sum(retrieved_nodes) AS BIGINT) AS retrieved_nodes, round(sum(retrieval_s), 4) AS retrieval_total_s, round(avg(retrieval_s), 6) AS retrieval_mean_s, round(sum(generation_s), 4) AS generation_total_s, round(avg(generation_s), 6) AS generation_mean_s, round(sum(evaluation_s), 4) AS evaluation_total_s, round(avg(evaluation_s), 6) AS evaluation_mean_s,
round(avg(CAST(cache_hit AS DOUBLE)), 6) AS cache_hit_ratio, CAST(count_if(evaluated) AS BIGINT) AS evaluations, CAST(count_if(evaluated AND failed) AS BIGINT) AS evaluation_failures, CAST(count_if(corrected) AS BIGINT) AS corrections FROM (SELECT {', '.join(f'{e} AS {n}' for n, e in _LOG.items())} FROM events)""")
def stage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usage.stage_metrics(given.table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in _LOG.items()]))
    return rows.select(*[F.round(c, 4).alias(c) if c.endswith("total_s") else F.round(c, 6).alias(c) if c.endswith("mean_s") or c == "cache_hit_ratio" else F.col(c) for c in rows.columns])


@query("""WITH RECURSIVE calls AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
run AS (SELECT user_id, n, event_id, true AS allowed, [t] AS held, CAST(0 AS DOUBLE) AS retry_after FROM calls WHERE n = 1
UNION ALL SELECT c.user_id, c.n, c.event_id, len(k) < 2, CASE WHEN len(k) < 2 THEN list_append(k, c.t) ELSE k END, CASE WHEN len(k) < 2 THEN 0 ELSE greatest(0.1, 86400 - (c.t - k[1]) / CAST(1000000 AS DOUBLE)) END FROM (SELECT c.*, list_filter(r.held, lambda h: c.t - h < 86400000000) AS k FROM run r JOIN calls c ON c.user_id = r.user_id AND c.n = r.n + 1) c)
SELECT event_id, allowed, round(retry_after, 6) AS retry_after FROM run""")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = given.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), "ts")
    return usage.rate_limit(calls, 2, 86400.0).select("event_id", "allowed", F.round("retry_after", 6).alias("retry_after"))


@query(ORACLE_SQL["rate_limit"])
def rate_limit_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same verdicts from a stream: the calls as files out of order, each a micro-batch, judged when the watermark has passed them."""
    calls = given.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    last = calls.agg(F.max("ts").alias("ts"))  # a call from nobody, long after the others, moves the watermark past them
    after = last.select(F.lit(-1).cast("long").alias("event_id"), F.lit(None).cast(calls.schema["key"].dataType).alias("key"), (F.col("ts") + F.expr("INTERVAL 4000 DAYS")).alias("ts"))
    folder = given.new_folder(spark, "calls")
    for i in range(3):
        calls.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == i).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    for i in range(2):
        after.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {i} DAYS")).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    found = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    done = jobs.rate_limit_stream(found, 2, 86400.0, "3000 days").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.parquet(f"{folder}/out").where("event_id >= 0").select("event_id", "allowed", F.round("retry_after", 6).alias("retry_after"))
