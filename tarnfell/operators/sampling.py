"""Bounded, representative samples of documents for broad questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.text import col
from ..sources.stores import written
from .joins import HOT_ROWS, salted_join
from .ranges import at_places, ranked

#: Fixed value: wording that means every document.
ALL_DOCUMENTS = r"(?i)(?<![\p{L}\p{N}_])(all|every|each)\s+(the\s+)?(documents?|files?)(?![\p{L}\p{N}_])|knowledge base|corpus"
BUDGET = 12


def plain(text: Column | str) -> Column:
    """ASCII words in lower case between single spaces."""
    return F.array_join(F.regexp_extract_all(F.lower(col(text)), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def documents_mentioned(questions: DataFrame, manifest: DataFrame, least: int = HOT_ROWS) -> DataFrame:
    """question_id, relative_path, document_id of files that are not failed whose name, or stem of four characters at least, stands in the question as whole words.

    A name is looked for by the rarest of its words among all names, so that a word with which very many begin draws none of them into a question; names that are equal are one. Words and names
    that are hot all the same (least rows and a thousandth of all) are dealt over several tasks."""
    file = names.file_name("relative_path")
    stem = F.when(names.extension(file) != "", F.substring(file, F.lit(1), F.length(file) - F.length(names.extension(file)))).otherwise(file)
    known = manifest.where("status is null or status <> 'failed'").select("relative_path", "document_id", plain(file).alias("name"), plain(stem).alias("stem"))
    forms = F.filter(F.array(F.col("name"), F.when(F.length("stem") >= 4, F.col("stem"))), lambda f: f.isNotNull() & (f != ""))
    named = written(known.select("relative_path", "document_id", F.explode(F.array_distinct(forms)).alias("form")), "named")
    counts = written(named.groupBy("form").agg(F.count("*").alias("n")), "forms")
    words = counts.select("form", F.explode(F.array_distinct(F.split("form", " "))).alias("word"))
    common = written(words.groupBy("word").agg(F.count("*").alias("n")), "words")
    rarest = salted_join(words, common, ["word"], "form", counts=common, least=least).groupBy("form").agg(F.min(F.struct("n", "word")).alias("least")).select("form", F.col("least.word").alias("word"))
    asked = questions.select("question_id", F.concat(F.lit(" "), plain("question"), F.lit(" ")).alias("said"))
    heard = asked.select("question_id", F.explode(F.array_distinct(F.split(F.trim("said"), " "))).alias("word"))
    may = salted_join(heard, rarest, ["word"], "question_id", least=least).select("question_id", "form")
    found = written(may.join(asked, "question_id").where(F.col("said").contains(F.concat(F.lit(" "), F.col("form"), F.lit(" ")))).select("question_id", "form"), "mentions")
    return salted_join(named, found, ["form"], "relative_path", counts=counts, least=least).select("question_id", "relative_path", "document_id").distinct()


def even_positions(length: Column, n: Column) -> Column:
    """Places from 0 that n of length rows take, evenly spread, first and last kept; one row: the middle."""
    return F.when(n <= 0, F.array().cast("array<bigint>")).when(length <= n, F.sequence(F.lit(0).cast("long"), length.cast("long") - 1)).when(n == 1, F.array(F.floor(length / 2))).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(2)).cast("long") - 1), lambda k: F.bround(k * (length - 1) / (n - 1)).cast("long")))
    )


def even_sample(rows: DataFrame, by: list[str], order: list[str], n: Column | int) -> DataFrame:
    """At most n rows of each group (n may be a column that is one value within a group), evenly spread in the given order. Adds place (from 0).

    A group may hold most of the rows: places come from ranges of the order, and only the rows at sampled places go on."""
    placed, groups = ranked(rows.withColumn("_take", F.lit(n) if isinstance(n, int) else n), by, order, "places", ("_take",))
    wanted = groups.select(*by, F.explode(even_positions(F.col("length"), F.col("_take"))).alias("place"))
    return at_places(placed, wanted, by).withColumn("place", F.col("place").cast("long")).drop("_take")


def reading_order(chunks: DataFrame) -> list[Column]:
    """Sort keys: part, then chunk; what is no number counts as 0."""
    return [F.coalesce(F.expr(f"try_cast({c} as bigint)"), F.lit(0)) for c in ("part_index", "chunk_index")]


def summarize_corpus(questions: DataFrame, chunks: DataFrame, vector_hits: DataFrame | None = None, manifest: DataFrame | None = None, budget: int = BUDGET) -> DataFrame:
    """question_id, chunk_id, score, place for broad questions: even samples of the documents they name, or of the first documents by path where they mean all, at
    most budget chunks in all; else the best vector hits spread over documents.

    manifest (relative_path, document_id, status); without it, documents are taken by document_id."""
    if manifest is None:
        manifest = chunks.select(F.col("document_id").alias("relative_path"), "document_id", F.lit("indexed").alias("status")).distinct()
    live = manifest.where("status is null or status <> 'failed'").select("relative_path", "document_id")
    mentioned = documents_mentioned(questions, manifest)
    first = live.orderBy("relative_path").limit(budget)
    all_of = questions.where(F.col("question").rlike(ALL_DOCUMENTS)).join(mentioned.select("question_id").distinct(), "question_id", "left_anti").select("question_id").crossJoin(F.broadcast(first))  # budget rows
    by_path = Window.partitionBy("question_id").orderBy("relative_path")
    chosen = mentioned.unionByName(all_of.select("question_id", "relative_path", "document_id")).withColumn("_n", F.row_number().over(by_path)).where(F.col("_n") <= budget)
    chosen = chosen.withColumn("_each", F.greatest(F.lit(1), F.floor(F.lit(budget) / F.count(F.lit(1)).over(Window.partitionBy("question_id")))))
    places = chunks.select("document_id", "chunk_id", *[k.alias(n) for k, n in zip(reading_order(chunks), ("_part", "_chunk"), strict=True)])
    sampled = even_sample(chosen.join(places, "document_id"), ["question_id", "document_id"], ["_part", "_chunk", "chunk_id"], F.col("_each"))
    named = sampled.withColumn("place_", F.row_number().over(Window.partitionBy("question_id").orderBy("_n", "place"))).where(F.col("place_") <= budget).select("question_id", "chunk_id", F.lit(1.0).alias("score"), F.col("place_").alias("place"))
    if vector_hits is None:
        return named
    rest = vector_hits.join(questions.select("question_id"), "question_id", "left_semi").join(chosen.select("question_id").distinct(), "question_id", "left_anti")
    return named.unionByName(diversify(rest, chunks, budget).select("question_id", "chunk_id", "score", "place"))


def diversify(hits: DataFrame, chunks: DataFrame, budget: int = BUDGET) -> DataFrame:
    """hits (the best max(3 * budget, 24) of a question) taken document by document in rounds until budget, then put in order of documents' first rank and of reading."""
    known = chunks.select("chunk_id", F.coalesce("document_id", F.col("chunk_id").cast("string")).alias("_document"), *[k.alias(n) for k, n in zip(reading_order(chunks), ("_part", "_chunk"), strict=True)])
    pool = hits.where(F.col("rank") <= max(3 * budget, 24)).join(known, "chunk_id")
    document = Window.partitionBy("question_id", "_document")
    rounds = pool.withColumns({"_round": F.row_number().over(document.orderBy("rank")), "_first": F.min("rank").over(document)})
    picked = rounds.withColumn("_n", F.row_number().over(Window.partitionBy("question_id").orderBy("_round", "_first"))).where(F.col("_n") <= budget)
    return picked.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("_first", "_part", "_chunk", "chunk_id"))).select("question_id", "chunk_id", "score", "rank", "place")
