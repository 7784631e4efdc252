"""Keyword search: an inverted index with BM25 scores, for many questions at once.

The index is three tables: postings (term, chunk_id, tf, dl), term_stats (term, df), corpus_stats (n, avgdl). Texts are tokenized once, when the postings are written; the
statistics come from them. A search keeps the postings of its terms where they lie, and reads texts only for the pool of a question: the terms and the pool are counted, and sent to the
executors where they prove small."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, content_terms, tokens
from ..sources.stores import sized, written

#: Metadata that is searched beside the text.
SEARCHED = ("file_name", "sheet_name", "header_path", "language")
K1, B = 1.5, 0.75
POOL = 3
PHRASE_BOOST = 1.0


def searchable_text(chunks: DataFrame) -> Column:
    """The text and whatever of the searched metadata the chunks have, null and empty ones left out."""
    return F.concat_ws(" ", F.col("text"), *[F.when(F.col(c) != "", F.col(c)) for c in SEARCHED if c in chunks.columns])


@dataclass
class LexicalIndex:
    postings: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame

    def pool(self, questions: DataFrame, k: int) -> DataFrame:
        """question_id, chunk_id, score, place of the k best chunks."""
        best = Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")
        return bm25(questions, self).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def build_postings(chunks: DataFrame) -> DataFrame:
    """term, chunk_id, tf, dl. Counted where the chunk is read; the exchange carries one row for each term and chunk."""
    words = chunks.select("chunk_id", tokens(searchable_text(chunks)).alias("terms"))
    # outer: Spark would else infer a filter on the tokens and tokenize every text twice
    each = words.select("chunk_id", F.size("terms").alias("dl"), F.explode_outer("terms").alias("term")).where("term is not null")
    return each.groupBy("chunk_id", "dl", "term").agg(F.count("*").cast("int").alias("tf")).select("term", "chunk_id", "tf", "dl")


def term_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(chunks: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """One row: n, avgdl (1.0 if there is nothing). With the chunks' postings no text is read."""
    if postings is None:
        sums = chunks.select(F.size(tokens(searchable_text(chunks))).alias("dl")).agg(F.count("*").alias("n"), F.sum("dl").alias("total"))
    else:
        sums = chunks.agg(F.count("*").alias("n")).crossJoin(postings.agg(F.sum("tf").alias("total")))
    mean = F.coalesce(F.col("total") / F.col("n"), F.lit(0.0))
    return sums.select("n", F.when(F.col("n") == 0, 1.0).when(mean > 0, mean).otherwise(1.0).alias("avgdl"))


def build_index(chunks: DataFrame) -> LexicalIndex:
    """Written to the shared folder once, read by every search."""
    postings = written(build_postings(chunks), "postings")
    return LexicalIndex(postings, term_stats(postings), corpus_stats(chunks, postings))


def query_terms(questions: DataFrame) -> DataFrame:
    """question_id, term: distinct tokens without stop words, or all tokens where nothing else is left."""
    own = questions.select("question_id", F.array_distinct(tokens("question")).alias("all"), content_terms("question").alias("content"))
    return own.select("question_id", F.explode(F.when(F.size("content") > 0, F.col("content")).otherwise(F.col("all"))).alias("term"))


def bm25(questions: DataFrame, index: LexicalIndex, k1: float = K1, b: float = B) -> DataFrame:
    """question_id, chunk_id, score (9 decimals) of all chunks that share a term with the question."""
    stats = index.corpus_stats
    asked = query_terms(questions)
    held = index.postings.join(sized(asked.select("term").distinct()), "term", "left_semi")
    terms = asked.join(term_stats(held), "term").crossJoin(F.broadcast(stats))  # stats is one row
    weighted = terms.select("question_id", "term", "avgdl", F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    length = F.when(F.col("dl") > 0, F.col("dl")).otherwise(1)
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * length / F.col("avgdl")))
    return held.join(weighted, "term").groupBy("question_id", "chunk_id").agg(F.round(F.sum(part), 9).alias("score"))


def keyword_search(questions: DataFrame, chunks: DataFrame, index=None, k: int = 12) -> DataFrame:
    """question_id, chunk_id, score, rank: the k best of the 3k best BM25 chunks after a boost for chunks that hold the whole question. Ties: chunk_id.

    index: a LexicalIndex or a stored one; without, one is built for this search."""
    pool = written((index or build_index(chunks)).pool(questions, POOL * k), "pool")
    asked = questions.select("question_id", F.lower(F.trim("question")).alias("phrase"), _content_count("question").alias("terms"))
    texts = chunks.join(sized(pool.select("question_id", F.col("chunk_id"), "score", "place")), "chunk_id")
    body = F.lower(searchable_text(chunks))
    boosted = texts.select("question_id", "chunk_id", "score", "place", body.alias("body")).join(asked, "question_id")
    boosted = boosted.withColumn("score", F.col("score") + F.when((F.col("terms") > 1) & (F.col("phrase") != "") & F.col("body").contains(F.col("phrase")), PHRASE_BOOST).otherwise(0.0))
    final = Window.partitionBy("question_id").orderBy(F.desc("score"), "place")
    return boosted.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("question_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


def _content_count(question: str) -> Column:
    """Tokens that are no stop words, with repeats; all tokens where none is left."""
    kept = F.size(F.filter(tokens(question), lambda t: ~t.isin(*STOP_WORDS)))
    return F.when(kept > 0, kept).otherwise(F.size(tokens(question)))
