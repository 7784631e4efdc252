"""Queries over keyword and vector search, fusion, rerank, expansion, routing and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, tokens
from ..operators import lexical, ranking, sampling, stored_index, vectors
from . import inputs as given
from .inputs import ASKED_SQL, CHUNKS_SQL, FILES_SQL, HITS_SQL, MANIFEST_SQL, QUESTIONS_SQL, with_sql

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _tokens_sql(text: str) -> str:
    found = f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')"
    return f"flatten(list_transform({found}, lambda t: CASE WHEN contains(t, '_') AND len(list_filter(string_split(t, '_'), lambda p: p <> '')) > 1 THEN list_prepend(t, list_filter(string_split(t, '_'), lambda p: p <> '')) ELSE [t] END))"


_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_SEARCHED = "text || ' ' || file_name || ' ' || header_path"
TOKENED = f"tokened AS (SELECT chunk_id, {_tokens_sql(_SEARCHED)} AS terms FROM chunks)"
POSTINGS = "postings AS (SELECT term, chunk_id, CAST(count(*) AS INT) AS tf, CAST(any_value(dl) AS INT) AS dl FROM (SELECT chunk_id, len(terms) AS dl, unnest(terms) AS term FROM tokened) GROUP BY term, chunk_id)"
TERMS = f"""asked_terms AS (SELECT question_id, {_tokens_sql('question')} AS every FROM questions),
kept_terms AS (SELECT question_id, every, list_filter(every, lambda t: NOT list_contains({_STOP}, t)) AS content FROM asked_terms),
terms AS (SELECT DISTINCT question_id, unnest(CASE WHEN len(content) > 0 THEN content ELSE every END) AS term FROM kept_terms)"""
SCORES = """df AS (SELECT term, count(*) AS df FROM postings GROUP BY term), stats AS (SELECT count(*) AS n, CAST(sum(len(terms)) AS DOUBLE) / count(*) AS avgdl FROM tokened),
scores AS (SELECT question_id, chunk_id, round(sum(ln(1.0 + (n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))) * tf * CAST(2.5 AS DOUBLE) / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl))), 9) AS score FROM terms JOIN df USING (term) JOIN postings USING (term), stats GROUP BY question_id, chunk_id)"""
SEARCH = f"""pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS place FROM scores) WHERE place <= 36),
found AS (SELECT question_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, place) AS INT) AS rank FROM (SELECT p.question_id, p.chunk_id, p.place,
p.score + CASE WHEN len(CASE WHEN len(k.content) > 0 THEN k.content ELSE k.every END) > 1 AND contains(lower({_SEARCHED}), lower(trim(q.question))) THEN 1.0 ELSE 0.0 END AS score
FROM pool p JOIN questions q USING (question_id) JOIN kept_terms k USING (question_id) JOIN chunks c USING (chunk_id))),
keyword_hits AS (SELECT question_id, chunk_id, round(score, 9) AS score, rank FROM found WHERE rank <= 12)"""
LEXICAL = (CHUNKS_SQL, QUESTIONS_SQL, TOKENED, POSTINGS, TERMS, SCORES, SEARCH)


@query(with_sql(f"SELECT chunk_id, sha256(array_to_string(terms, ' ')) AS terms_sha256, CAST(len(terms) AS INT) AS n FROM tokened", CHUNKS_SQL, TOKENED))
def token_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = given.doc_chunks(spark, sf_dir)
    return rows.select("chunk_id", tokens(lexical.searchable_text(rows)).alias("t")).select("chunk_id", F.sha2(F.array_join("t", " "), 256).alias("terms_sha256"), F.size("t").alias("n"))


@query(with_sql("SELECT * FROM postings", CHUNKS_SQL, TOKENED, POSTINGS))
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.build_postings(given.doc_chunks(spark, sf_dir))


@query(with_sql("SELECT term, count(*) AS df FROM postings GROUP BY term", CHUNKS_SQL, TOKENED, POSTINGS))
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_stats(lexical.build_postings(given.doc_chunks(spark, sf_dir)))


@query(with_sql("SELECT count(*) AS n, round(CAST(sum(len(terms)) AS DOUBLE) / count(*), 6) AS avgdl FROM tokened", CHUNKS_SQL, TOKENED))
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.corpus_stats(given.doc_chunks(spark, sf_dir)).withColumn("avgdl", F.round("avgdl", 6))


@query(with_sql("SELECT * FROM terms", QUESTIONS_SQL, TERMS))
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.query_terms(given.questions(spark, sf_dir))


@query(with_sql("SELECT question_id, chunk_id, round(score, 6) AS score FROM scores", *LEXICAL))
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = given.stored_index(spark, sf_dir).lexical()
    return lexical.bm25(given.questions(spark, sf_dir), index).withColumn("score", F.round("score", 6))


def _keyword(spark, sf_dir):
    return lexical.keyword_search(given.questions(spark, sf_dir), given.doc_chunks(spark, sf_dir), given.stored_index(spark, sf_dir))


@query(with_sql("SELECT question_id, chunk_id, round(score, 6) AS score, rank FROM keyword_hits", *LEXICAL))
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyword(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(with_sql("SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf, CAST(sum(dl) AS BIGINT) AS dl FROM postings GROUP BY term", CHUNKS_SQL, TOKENED, POSTINGS))
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index written from nothing, read back by term."""
    return stored_index.write_index(given.doc_chunks(spark, sf_dir), given.new_folder(spark, "built")).by_term()


@query(with_sql("SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf, CAST(sum(dl) AS BIGINT) AS dl, any_value(n) AS n, any_value(avgdl) AS avgdl FROM postings, (SELECT count(*) AS n, round(CAST(sum(len(terms)) AS DOUBLE) / count(*), 6) AS avgdl FROM tokened) GROUP BY term", CHUNKS_SQL, TOKENED, POSTINGS))
def index_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older index (a twentieth of the documents with other texts, some missing, some that are gone now) brought up to date by deltas: what a rebuild gives."""
    now = given.doc_chunks(spark, sf_dir)
    other = now.where("chunk_id % 20 = 3").withColumn("text", F.concat("text", F.lit(" older words "), F.col("file_name")))
    left = now.where("chunk_id % 40 = 7").withColumn("chunk_id", -1 - F.col("chunk_id"))
    old = now.where("chunk_id % 20 <> 3 and chunk_id % 50 <> 11").unionByName(other).unionByName(left)
    index = stored_index.write_index(old, given.new_folder(spark, "updated"))
    index = stored_index.update_index(index, left.select("chunk_id"), now.where("chunk_id % 20 = 3"))
    index = stored_index.update_index(index, left.select("chunk_id").limit(0), now.where("chunk_id % 50 = 11"))
    return index.by_term().withColumns({"n": F.lit(index.chunks).cast("long"), "avgdl": F.lit(round(index.avgdl, 6))})


@query(with_sql("SELECT question_id, chunk_id, round(score, 6) AS score, CAST(place AS INT) AS place FROM pool", *LEXICAL))
def bounded_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool that keyword search boosts, by upper bounds whatever the size."""
    found = stored_index.search(given.stored_index(spark, sf_dir), given.questions(spark, sf_dir), 36, full=0).hits
    return found.select("question_id", "chunk_id", F.round("score", 6).alias("score"), "place")


def search_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, postings of its terms, those of them that the bounded search scores, and the share that it skips."""
    reads = stored_index.search(given.stored_index(spark, sf_dir), given.questions(spark, sf_dir), 36, full=0).reads
    return reads.withColumn("skipped", F.round(1 - F.col("scored") / F.col("postings"), 4))


QUERIES["search_reads"] = search_reads

NEAREST = """pairs AS (SELECT q.vec_id AS question_id, v.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
vector_hits AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM pairs) WHERE rank <= 36)"""


def _vectors(spark, sf_dir):
    return given.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def _nearest(spark, sf_dir, k=36):
    """Queries are every row whose id is divisible by 20, against all rows."""
    rows = _vectors(spark, sf_dir)
    return vectors.vector_search(rows.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "question_id"), rows, k)


@query(with_sql("SELECT question_id, chunk_id, round(score, 6) AS score, rank FROM vector_hits WHERE rank <= 12", NEAREST))
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, 12).withColumn("score", F.round("score", 6))


@query(with_sql("""SELECT q.question_id, NOT (coalesce(max(v.score), 0) < 0.35 AND q.question_id % 40 <> 0 AND q.mode IN ('semantic', 'hybrid')) AS passes FROM (SELECT vec_id AS question_id, CASE vec_id % 3 WHEN 0 THEN 'semantic' WHEN 1 THEN 'keyword' ELSE 'hybrid' END AS mode FROM embeddings WHERE vec_id % 20 = 0) q
LEFT JOIN (SELECT * FROM vector_hits WHERE rank BETWEEN 2 AND 12) v USING (question_id) GROUP BY q.question_id, q.mode""", NEAREST))
def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _vectors(spark, sf_dir).where("chunk_id % 20 = 0").selectExpr("chunk_id AS question_id", "CASE chunk_id % 3 WHEN 0 THEN 'semantic' WHEN 1 THEN 'keyword' ELSE 'hybrid' END AS mode")
    others = _nearest(spark, sf_dir, 12).where("rank > 1")
    return vectors.evidence_gate(asked, others, asked.where("question_id % 40 = 0"), 0.35).select("question_id", "passes")


#: Keyword hits of the passages beside vector hits of the vectors: question 20 * i of the one is question i of the other.
DENSE = "dense AS (SELECT question_id // 20 AS question_id, chunk_id, score, rank FROM vector_hits WHERE rank <= 12)"
FUSED = """fused AS (SELECT * FROM (SELECT question_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, list, first) AS INT) AS rank FROM
(SELECT question_id, chunk_id, round(sum(CAST(1.0 AS DOUBLE) / (60 + rank)), 9) AS score, min(list) AS list, min(rank + 1000 * list) AS first FROM (SELECT question_id, chunk_id, rank, 0 AS list FROM dense UNION ALL SELECT question_id, chunk_id, rank, 1 FROM keyword_hits) GROUP BY 1, 2)) WHERE rank <= 12)"""


def _fused(spark, sf_dir):
    dense = _nearest(spark, sf_dir, 12).withColumn("question_id", F.expr("question_id div 20"))
    return ranking.fuse_rrf(dense, _keyword(spark, sf_dir))


@query(with_sql("SELECT question_id, chunk_id, round(score, 6) AS score, rank FROM fused", *LEXICAL, NEAREST, DENSE, FUSED))
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).withColumn("score", F.round("score", 6))


def _squash(text):
    return f"trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


RERANKED = f"""reranked AS (SELECT * FROM (SELECT question_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, before) AS INT) AS rank FROM
(SELECT h.question_id, h.chunk_id, h.rank AS before, round(CAST(0.55 AS DOUBLE) * h.score / max(h.score) OVER (PARTITION BY h.question_id) + CAST(0.35 AS DOUBLE) * coalesce(CAST(len(list_intersect(list_distinct(k.content), list_distinct({_tokens_sql('c.text')}))) AS DOUBLE) / nullif(len(list_distinct(k.content)), 0), 0)
+ CASE WHEN contains({_squash('c.text')}, {_squash('q.question')}) THEN CAST(0.1 AS DOUBLE) ELSE 0 END, 9) AS score FROM keyword_hits h JOIN questions q USING (question_id) JOIN kept_terms k USING (question_id) JOIN chunks c USING (chunk_id))) WHERE rank <= 5)"""


def _reranked(spark, sf_dir):
    return ranking.rerank(given.questions(spark, sf_dir), _keyword(spark, sf_dir), given.doc_chunks(spark, sf_dir))


@query(with_sql("SELECT question_id, chunk_id, round(score, 6) AS score, rank FROM reranked", *LEXICAL, RERANKED))
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir).withColumn("score", F.round("score", 6))


#: The word before and behind a term, if any, is not a word character: tokens of the lower-cased text, with their places.
EDGE_TERMS = f"edge_terms AS (SELECT question_id, list_distinct(list_filter(regexp_extract_all(lower(question), '[A-Za-z0-9_]+'), lambda t: length(t) >= 3 AND NOT list_contains({_STOP}, t))) AS terms FROM questions)"
SIDES = """bodies AS (SELECT r.question_id, r.chunk_id, r.score, r.rank, c.prev_chunk_id, c.next_chunk_id, e.terms, lower(regexp_replace(c.text, '^\\s+|\\s+$', '', 'g')) AS body FROM reranked r JOIN chunks c USING (chunk_id) JOIN edge_terms e USING (question_id)),
pieces AS (SELECT *, regexp_extract_all(body, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+') AS p FROM bodies),
starts AS (SELECT question_id, chunk_id, min(spot) AS low, max(spot) AS high FROM (SELECT question_id, chunk_id, terms, unnest(p) AS piece, unnest(list_transform(range(1, len(p) + 1), lambda i: i)) AS i, p FROM pieces) x,
LATERAL (SELECT coalesce(list_sum(list_transform(list_slice(x.p, 1, x.i - 1), lambda s: length(s))), 0) AS spot) AS y WHERE list_contains(terms, piece) GROUP BY 1, 2),
sides AS (SELECT b.*, coalesce(low / CAST(length(body) AS DOUBLE) <= 0.15, false) AS at_start, coalesce(high / CAST(length(body) AS DOUBLE) >= 0.85, false) OR regexp_matches(body, '(\\.\\.\\.|[:;,])$') AS at_end FROM bodies b LEFT JOIN starts USING (question_id, chunk_id))"""


@query(with_sql("SELECT question_id, chunk_id, at_start, at_end FROM sides", *LEXICAL, RERANKED, EDGE_TERMS, SIDES))
def boundary_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = given.questions(spark, sf_dir).select("question_id", ranking.edge_terms("question").alias("terms"))
    rows = _reranked(spark, sf_dir).join(asked, "question_id").join(given.doc_chunks(spark, sf_dir).select("chunk_id", "text"), "chunk_id")
    return rows.withColumns(ranking.boundary_sides("text", "terms")).select("question_id", "chunk_id", "at_start", "at_end")


EXPANDED = """added AS (SELECT * FROM (SELECT question_id, id AS chunk_id, score, rank, side, row_number() OVER (PARTITION BY question_id ORDER BY rank, side) AS n FROM
(SELECT question_id, prev_chunk_id AS id, score, rank, -1 AS side FROM sides WHERE at_start AND len(terms) > 0 UNION ALL SELECT question_id, next_chunk_id, score, rank, 1 FROM sides WHERE at_end AND len(terms) > 0) WHERE id IS NOT NULL) WHERE n <= 4),
expanded AS (SELECT question_id, chunk_id, score, rank, side, CAST(row_number() OVER (PARTITION BY question_id ORDER BY rank, side) AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY rank, side) AS once FROM
(SELECT question_id, chunk_id, score, rank, 0 AS side FROM reranked UNION ALL SELECT question_id, chunk_id, score, rank, side FROM added)) WHERE once = 1)"""


@query(with_sql("SELECT question_id, chunk_id, round(score, 6) AS score, rank, side, place FROM expanded", *LEXICAL, RERANKED, EDGE_TERMS, SIDES, EXPANDED))
def context_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.expand_context(given.questions(spark, sf_dir), _reranked(spark, sf_dir), given.doc_chunks(spark, sf_dir)).withColumn("score", F.round("score", 6))


_B, _E = "(?:^|[^\\p{L}\\p{N}_])", "(?:$|[^\\p{L}\\p{N}_])"
ROUTED = f"""flags AS (SELECT *, CASE lower(trim(mode)) WHEN 'vector' THEN 'semantic' WHEN 'dense' THEN 'semantic' WHEN 'bm25' THEN 'keyword' WHEN 'lexical' THEN 'keyword' WHEN 'hybrid_search' THEN 'hybrid' WHEN 'global' THEN 'summary' ELSE lower(trim(mode)) END AS chosen,
regexp_matches(question, '`[^`]+`') OR regexp_matches(question, '{_B}[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+{_E}') OR regexp_matches(question, '{_B}[a-z]+[A-Z][A-Za-z0-9]*{_E}') OR regexp_matches(question, '{_B}[A-Za-z]+[-_]?[0-9]+(?:[A-Za-z0-9_-]*[A-Za-z0-9_])?{_E}') OR regexp_matches(question, '{_B}[\\p{{L}}\\p{{N}}_]+\\.[A-Za-z]{{2,5}}{_E}') AS strong,
regexp_matches(question, '(?i){_B}(error|exception|traceback|id|code|filename|function|method|variable|class|field|column|sku|part){_E}') AS weak, len(list_filter(regexp_extract_all(question, '[\\p{{L}}\\p{{N}}_]+'), lambda t: regexp_full_match(t, '[0-9]+'))) >= 2 AS numbers,
regexp_matches(question, '(?i){_B}(summari[sz]e|summary|overview|main themes?|key themes?|big picture|entire document|whole document|all documents){_E}|what is (this|the) (document|file) about') AS broad,
regexp_matches(question, '(?i){_B}(compare|comparison|contrast|differences?|versus|vs\\.?|across|both|multiple|and explain|why and how){_E}') OR length(question) - length(replace(question, '?', '')) > 1 AS complex,
len(list_filter(string_split_regex(question, '\\s+'), lambda w: w <> '')) AS words FROM asked),
routed AS (SELECT question_id, question, CASE WHEN chosen <> 'auto' THEN chosen WHEN broad THEN 'summary' WHEN strong AND words <= 6 AND NOT complex THEN 'keyword' WHEN strong OR weak OR numbers OR complex THEN 'hybrid' ELSE 'semantic' END AS mode,
CASE WHEN chosen <> 'auto' THEN 'as asked' WHEN broad THEN 'asks about the whole' WHEN strong AND words <= 6 AND NOT complex THEN 'a short identifier' WHEN strong THEN 'an identifier in a longer question' WHEN weak OR numbers OR complex THEN 'exact words or several parts' ELSE 'a matter of meaning' END AS reason,
chosen = 'auto' AND (strong OR weak OR numbers) AS needs_exact_match, chosen = 'auto' AND broad AS is_broad, chosen = 'auto' AND complex AS is_complex, chosen IN ('auto', 'semantic', 'keyword', 'hybrid', 'summary') AS mode_ok FROM flags)"""


@query(with_sql("SELECT question_id, mode, reason, needs_exact_match, is_broad, is_complex, mode_ok FROM routed", ASKED_SQL, ROUTED))
def question_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.route_questions(given.asked(spark, sf_dir)).select("question_id", "mode", "reason", "needs_exact_match", "is_broad", "is_complex", "mode_ok")


@query(with_sql("SELECT question_id, regexp_replace(question, '^\\s+|\\s+$', '', 'g') AS question, CASE WHEN regexp_full_match(question, '\\s*') THEN 'empty' WHEN length(regexp_replace(question, '^\\s+|\\s+$', '', 'g')) > 300 THEN 'too_long' END AS problem FROM asked", ASKED_SQL))
def question_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.validate_questions(given.asked(spark, sf_dir), 300).select("question_id", "question", "problem")


@query(with_sql("SELECT question_id, min(question_id) OVER (PARTITION BY lower(trim(regexp_replace(question, '\\s+', ' ', 'g'))), mode) AS representative FROM asked", ASKED_SQL))
def question_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.dedupe_questions(given.asked(spark, sf_dir))[1]


#: Questions that name files, by name, by stem, by short stem, or mean all of them.
NAMED = """CASE doc_id % 5 WHEN 0 THEN 'what is in ' || name || ' exactly?' WHEN 1 THEN 'sum up all the documents' WHEN 2 THEN 'about ' || CAST(doc_id AS STRING) || ' only' WHEN 3 THEN 'compare ' || upper(name) || ' with ' || CAST(doc_id + 5 AS STRING) || '.CSV' ELSE 'nothing named' END"""
NAMED_SQL = f"named AS (SELECT doc_id AS question_id, {NAMED} AS question FROM files)"
MENTIONED = """plain AS (SELECT question_id, question, ' ' || array_to_string(regexp_extract_all(lower(question), '[a-z0-9]+'), ' ') || ' ' AS said FROM named),
known AS (SELECT relative_path, document_id, regexp_extract(relative_path, '[^/]*$') AS file FROM manifest WHERE status <> 'failed'),
forms AS (SELECT relative_path, document_id, array_to_string(regexp_extract_all(lower(file), '[a-z0-9]+'), ' ') AS name, array_to_string(regexp_extract_all(lower(regexp_replace(file, '\\.[^.]*$', '')), '[a-z0-9]+'), ' ') AS stem FROM known),
mentioned AS (SELECT question_id, relative_path, document_id FROM plain, forms WHERE contains(said, ' ' || name || ' ') OR (length(stem) >= 4 AND contains(said, ' ' || stem || ' ')))"""


def _named(spark, sf_dir):
    return given.files(spark, sf_dir).select(F.col("doc_id").alias("question_id"), F.expr(NAMED).alias("question"))


@query(with_sql("SELECT * FROM mentioned", FILES_SQL, MANIFEST_SQL, NAMED_SQL, MENTIONED))
def documents_mentioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.documents_mentioned(_named(spark, sf_dir), given.manifest(given.files(spark, sf_dir)))


@query("""SELECT source, doc_id, CAST(place AS BIGINT) AS place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM documents)
WHERE list_contains(list_transform(range(0, 7), lambda k: CAST(round_even(k * (n - 1) / CAST(6 AS DOUBLE), 0) AS BIGINT)), place) OR n <= 7""")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.even_sample(given.table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"], 7)


#: Chunks of the manifest's documents: as many as its record counts, in reading order.
CHUNKED = "chunked AS (SELECT document_id, document_id || '-' || CAST(chunk_no AS STRING) AS chunk_id, chunk_no FROM idx)"
SAMPLED = """live AS (SELECT relative_path, document_id FROM manifest WHERE status <> 'failed'), broad AS (SELECT question_id FROM named WHERE regexp_matches(question, '(?i)all the documents') AND question_id NOT IN (SELECT question_id FROM mentioned)),
chosen AS (SELECT *, greatest(1, 12 // count(*) OVER (PARTITION BY question_id)) AS each FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY relative_path) AS n FROM (SELECT * FROM mentioned UNION ALL SELECT question_id, relative_path, document_id FROM broad, (SELECT * FROM live ORDER BY relative_path LIMIT 12))) WHERE n <= 12),
spread AS (SELECT c.question_id, c.n, c.each, k.chunk_id, row_number() OVER (PARTITION BY c.question_id, c.document_id ORDER BY k.chunk_no) - 1 AS p, count(*) OVER (PARTITION BY c.question_id, c.document_id) AS len FROM chosen c JOIN chunked k USING (document_id)),
sampled AS (SELECT question_id, chunk_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY n, p) AS INT) AS place FROM spread WHERE len <= each OR (each = 1 AND p = len // 2) OR (each > 1 AND list_contains(list_transform(range(0, CAST(each AS BIGINT)), lambda k: CAST(round_even(k * (len - 1) / CAST(each - 1 AS DOUBLE), 0) AS BIGINT)), p)))"""


@query(with_sql("SELECT question_id, chunk_id, place FROM sampled WHERE place <= 12", FILES_SQL, MANIFEST_SQL, given.INDEX_SQL, NAMED_SQL, MENTIONED, CHUNKED, SAMPLED))
def corpus_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = given.manifest(given.files(spark, sf_dir))
    rows = given.index(old).select("document_id", F.concat_ws("-", "document_id", F.col("chunk_no").cast("string")).alias("chunk_id"), F.lit("0").alias("part_index"), F.col("chunk_no").alias("chunk_index"))
    return sampling.summarize_corpus(_named(spark, sf_dir), rows, None, old).select("question_id", "chunk_id", "place")


@query(with_sql("""SELECT question_id, chunk_id, rank, CAST(row_number() OVER (PARTITION BY question_id ORDER BY first, chunk_id) AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY turn, first) AS n FROM
(SELECT *, row_number() OVER w AS turn, min(rank) OVER (PARTITION BY question_id, chunk_id % 17) AS first FROM vector_hits WINDOW w AS (PARTITION BY question_id, chunk_id % 17 ORDER BY rank))) WHERE n <= 12""", NEAREST))
def diversified_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).select("chunk_id", F.expr("CAST(chunk_id % 17 AS STRING)").alias("document_id"), F.lit(0).alias("part_index"), F.col("chunk_id").alias("chunk_index"))
    return sampling.diversify(_nearest(spark, sf_dir), rows).select("question_id", "chunk_id", "rank", "place")


def retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All modes in one run: passages as questions, documents as chunks, the vectors beside them by id."""
    rows = given.doc_chunks(spark, sf_dir)
    asked = given.questions(spark, sf_dir).withColumn("mode", F.expr("CASE question_id % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'semantic' ELSE 'summary' END"))
    known = _vectors(spark, sf_dir)
    mine = known.withColumnRenamed("chunk_id", "question_id").join(asked.select("question_id"), "question_id", "left_semi")
    return ranking.retrieve(ranking.route_questions(asked), rows, known.join(rows.select("chunk_id"), "chunk_id", "left_semi"), mine, index=given.stored_index(spark, sf_dir))


QUERIES["retrieval"] = retrieval


#: The vectors of documents only, and the hits that each mode reranks. Scores are compared to four decimals: those that start from cosines differ in the ninth.
_KNOWN = NEAREST.replace("embeddings v WHERE", "(SELECT * FROM embeddings WHERE vec_id IN (SELECT chunk_id FROM chunks)) v WHERE")
_HITS = {"keyword": "keyword_hits", "semantic": "dense", "hybrid": "fused"}


def _retrieved_sql(mode: str) -> str:
    found = (RERANKED.replace("FROM keyword_hits h", f"FROM {_HITS[mode]} h"), EDGE_TERMS, SIDES, EXPANDED)
    return with_sql("SELECT question_id, chunk_id, round(score, 4) AS score, place FROM expanded", *LEXICAL, _KNOWN, DENSE, FUSED, *found)


def _retrieved(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    """The whole retrieval in one mode: question 20 * i of the vectors is passage i."""
    rows = given.doc_chunks(spark, sf_dir)
    known = _vectors(spark, sf_dir)
    mine = known.where("chunk_id % 20 = 0").select(F.expr("chunk_id div 20").alias("question_id"), "embedding")
    asked = given.questions(spark, sf_dir).withColumn("mode", F.lit(mode))
    return ranking.retrieve(asked, rows, known.join(rows.select("chunk_id"), "chunk_id", "left_semi"), mine, index=given.stored_index(spark, sf_dir)).withColumn("score", F.round("score", 4))


@query(_retrieved_sql("keyword"))
def retrieval_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir, "keyword")


@query(_retrieved_sql("semantic"))
def retrieval_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir, "semantic")


@query(_retrieved_sql("hybrid"))
def retrieval_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir, "hybrid")
