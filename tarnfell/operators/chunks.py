"""From parts to chunks: strategy, segments under the token budget, stable ids, neighbours, text to embed. One narrow vectorised function cuts the texts; the rest
are column expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.names import normal_language
from ..functions.text import count_tokens, lines, uuid5
from ..sources.stores import written
from . import splitting
from .profiling import choose_strategy, chunk_overlap, chunk_size, code_lines, profile_structure
from .ranges import neighbours, ranked

#: Tokens an embedder takes, of which some are its own, and those kept free for metadata; share of them for a tokenizer that only estimates.
WINDOW, SPECIAL, RESERVE, MARGIN = 512, 2, 48, 0.75
CHARS_PER_CODE_TOKEN = 3
#: Lines of a large part that a task packs; more than a piece can hold.
RANGE = 4096
EMBEDDED = ("file_name", "sheet_name", "header_path", "page_label")
_SEGMENTS = "struct<label:string,segments:array<struct<text:string,header_path:string>>,error:string>"


def budgets(exact: bool = True) -> tuple[int, int]:
    """(embed limit, text budget)."""
    usable = WINDOW - SPECIAL
    limit = usable if exact else int(usable * MARGIN)
    return limit, max(64, limit - RESERVE)


def segments_of(text: str, strategy: str, kind: str, language: str | None, size: int, overlap: int, window: int, budget: int, limit_overlap: int, count: splitting.Counter) -> tuple[str, list]:
    """(label, [(text, header path)]) of one part."""
    if strategy == "code":
        if language:
            label, pieces = "code", splitting.split_code(text, window, budget * CHARS_PER_CODE_TOKEN)
        else:
            label, pieces = "code_fallback", splitting.split_lines(text, budget, count, overlap_lines=3)
        found = [(p, None) for p in pieces]
    elif strategy in ("markdown", "structured_document"):
        label, found = "markdown_structure", splitting.merge_small(splitting.split_markdown(text), budget, count)
    elif strategy == "structured_data":
        if count(text) <= size:
            label, found = "structured_data", [(text.strip(), None)]
        else:
            header = None
            if kind == "tabular":
                header, *rest = splitting.text_lines(text)
                text = "\n".join(rest)
            label, found = "structured_text", [(p, None) for p in splitting.split_lines(text, size, count, header)]
    elif strategy == "short_text":
        label, found = "minimal", [(text.strip(), None)]
    else:
        label, found = strategy, [(p, None) for p in splitting.split_sentences(text, size, overlap, count)]
    return label, splitting.enforce_limit(found, budget, limit_overlap, count) or [(text.strip(), None)]


def chunk_documents(parts: DataFrame, counter: Callable[[str], int] | None = None, exact: bool = True, large: int | None = None) -> DataFrame:
    """Rows of parts (document_id, part_index, text, document_type, language, ...) become chunks: profile and metadata columns, chunk_index, chunk_total,
    chunk_strategy, chunk_id, header_path, text, prev_chunk_id, next_chunk_id, error.

    A part without text gives no chunk; a part that can't be cut gives one row with error and no text, never a failed job. large: structured parts (logs, tables, data) of more characters are cut by
    several tasks each, into the same chunks; by default every part is cut by one."""
    _, budget = budgets(exact)
    limit_overlap = min(max(30, budget // 10), budget // 2)
    count = counter or splitting.count_default

    @F.pandas_udf(_SEGMENTS)
    def cut(text: pd.Series, strategy: pd.Series, kind: pd.Series, language: pd.Series, size: pd.Series, overlap: pd.Series, window: pd.Series) -> pd.DataFrame:
        out = []
        for t, *rest in zip(text, strategy, kind, language, size, overlap, window, strict=True):
            try:
                label, found = segments_of(t, *rest, budget, limit_overlap, count)
                out.append((label, [{"text": a, "header_path": b or None} for a, b in found], None))
            except Exception as e:  # one bad part must not end the job
                out.append((rest[0], [], f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["label", "segments", "error"])

    ready = choose_strategy(profile_structure(parts.where(F.trim("text") != "")))
    ready = ready.withColumn("_size", chunk_size("word_count", budget)).withColumns({"_overlap": chunk_overlap("_size"), "_window": code_lines("line_count"), "_language": normal_language("language")})
    if large is not None:
        big = (F.col("strategy") == "structured_data") & (F.length("text") > large)
        whole, ready = ready.where(big), ready.where(~big)
    done = ready.withColumn("_cut", cut("text", "strategy", "document_type", "_language", "_size", "_overlap", "_window")).drop("_size", "_overlap", "_window", "_language", "text")
    chunks = build_chunks(done.withColumns({"chunk_strategy": F.col("_cut.label"), "segments": F.col("_cut.segments"), "error": F.col("_cut.error")}).drop("_cut", "strategy"))
    return chunks if large is None else chunks.unionByName(chunk_lines(whole, budget, limit_overlap, count).select(chunks.columns))


def piece_ends(costs: np.ndarray, room: int) -> np.ndarray:
    """For a piece of whole lines that starts at each line, the line behind it: as many lines as cost room together; a line that costs more is a piece of its own."""
    sums = np.concatenate([[0], np.cumsum(costs)])
    ends = np.searchsorted(sums, sums[:-1] + room, "right") - 1
    long = np.append(np.flatnonzero(costs > room), len(costs))
    return np.maximum(np.minimum(ends, long[np.searchsorted(long, np.arange(len(costs)))]), np.arange(len(costs)) + 1)


def chunk_lines(parts: DataFrame, budget: int, limit_overlap: int, count: splitting.Counter) -> DataFrame:
    """The chunks of parts (with strategy structured_data and _size) whose lines are packed by several tasks.

    Where a piece ends depends on all lines before it, but only through the place where the piece starts. A range of RANGE lines therefore says, for each of its first lines, with which line of the next
    range a packing that enters there leaves it; packings that enter at different lines soon share an end and go on alike. Ranges are then passed through in order by these numbers alone, and each is
    cut from the line at which the packing of the whole part enters it. A range sees the first lines of the next one, as many as a piece can hold."""
    key = ["document_id", "part_index"]
    table = F.col("document_type") == "tabular"
    parts = written(parts, "large")
    top = parts.select(*key, F.col("_size").alias("size"), F.when(table, F.get(lines("text"), 0)).alias("header"), table.alias("table"), F.posexplode(lines("text")).alias("n", "line")).where("not table or n > 0")
    top = top.withColumn("n", F.col("n") - F.col("table").cast("int")).withColumn("own", F.floor(F.col("n") / RANGE).cast("int"))
    ahead = F.when((F.col("own") > 0) & (F.col("n") % RANGE < F.col("size")), F.array("own", F.col("own") - 1)).otherwise(F.array("own"))
    seen = top.withColumn("range", F.explode(ahead)).select(*key, "range", "n", "line", "size", "header")
    doc_type = parts.schema["document_id"].dataType.simpleString()
    part_type = parts.schema["part_index"].dataType.simpleString()

    def over_ranges(work):
        """work(key, rows of a range in order) for each range of sorted batches."""

        def run(batches):
            held, last = [], None
            for batch in batches:
                for row in batch.to_pylist():
                    now = (row["document_id"], row["part_index"], row["range"])
                    if held and now != last:
                        yield from work(last, held)
                        held = []
                    last = now
                    held.append(row)
            if held:
                yield from work(last, held)

        return run

    def measured(rows: list[dict]) -> tuple[np.ndarray, int, str, int]:
        """(ends of pieces by their start, room, what stands before each piece, the range's own lines)."""
        header, size = rows[0]["header"], rows[0]["size"]
        spent = count(header) + 1 if header else 0
        if spent > size // 2:
            header, spent = None, 0
        room = max(size - spent, 16)
        costs = np.array([count(r["line"]) + 1 for r in rows])
        return piece_ends(costs, room), room, f"{header}\n" if header else "", sum(r["n"] // RANGE == rows[0]["range"] for r in rows)

    def exits(now, rows):
        ends, _, _, own = measured(rows)
        out = ends[:own] - own
        for i in range(own - 1, -1, -1):
            if out[i] < 0:
                out[i] = out[ends[i]]
        yield pa.RecordBatch.from_pylist([{"document_id": now[0], "part_index": now[1], "range": now[2], "exits": out[: rows[0]["size"] + 1].tolist()}], schema)

    def cut(now, rows):
        ends, room, before, own = measured(rows)
        at, found = rows[0]["entry"], []
        while at < own:
            end = int(ends[at])
            texts = [r["line"] for r in rows[at:end]]
            if end == at + 1 and count(texts[0]) + 1 > room:
                found += [(before + p, None) for p in splitting.split_sentences(texts[0], room, 0, count) if p.strip()]
            elif "\n".join(texts).strip():
                found.append((before + "\n".join(texts), None))
            at = end
        made = splitting.enforce_limit(found, budget, limit_overlap, count)
        yield pa.RecordBatch.from_pylist([{"document_id": now[0], "part_index": now[1], "range": now[2], "k": k, "text": t} for k, (t, _) in enumerate(made)], pieces)

    kinds = [to_arrow_type(parts.schema[c].dataType) for c in key]
    schema = pa.schema([("document_id", kinds[0]), ("part_index", kinds[1]), ("range", pa.int32()), ("exits", pa.list_(pa.int64()))])
    pieces = pa.schema([("document_id", kinds[0]), ("part_index", kinds[1]), ("range", pa.int32()), ("k", pa.int32()), ("text", pa.string())])
    dealt = seen.repartition(*key, "range").sortWithinPartitions(*key, "range", "n")
    ways = dealt.mapInArrow(over_ranges(exits), f"document_id {doc_type}, part_index {part_type}, range int, exits array<bigint>")
    ways = ways.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("range", "exits"))).alias("ways"))  # numbers only, a row for each range
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("entries"))
    passed = F.aggregate("ways", start, lambda a, w: F.struct(F.get(w["exits"], a["at"].cast("int")).alias("at"), F.concat(a["entries"], F.array(a["at"])).alias("entries")))
    entries = written(ways.select(*key, F.posexplode(passed["entries"]).alias("range", "entry")), "entries")
    inner = seen.join(entries, [*key, "range"]).repartition(*key, "range").sortWithinPartitions(*key, "range", "n")
    made = written(inner.mapInArrow(over_ranges(cut), f"document_id {doc_type}, part_index {part_type}, range int, k int, text string"), "pieces")
    placed, groups = ranked(made.select(*key, "range", "k", F.sha1(F.encode("text", "UTF-8")).alias("_sha")), key, ["range", "k"])
    ids = uuid5(F.concat_ws("|", "document_id", F.col("part_index").cast("string"), F.col("place").cast("string"), F.substring("_sha", 1, 12)))
    named = written(placed.withColumn("chunk_id", ids).select(*key, "range", "k", F.col("place").cast("int").alias("chunk_index"), "chunk_id"), "named")
    linked = neighbours(named, key, ["chunk_index"], "chunk_id").withColumnsRenamed({"before": "prev_chunk_id", "after": "next_chunk_id"})
    about = parts.drop("text", "_size", "_overlap", "_window", "_language", "strategy").join(groups.withColumn("chunk_total", F.col("length").cast("int")).drop("length"), key)
    rest = {"chunk_strategy": F.lit("structured_text"), "header_path": F.lit(None).cast("string"), "error": F.lit(None).cast("string")}
    return linked.join(made, [*key, "range", "k"]).join(about, key).withColumns(rest)


def build_chunks(segmented: DataFrame) -> DataFrame:
    """One row for each segment, with ids and neighbours. They depend on document, part, place and text only."""
    name = lambda text, i: F.concat_ws("|", "document_id", F.col("part_index").cast("string"), i.cast("string"), F.substring(F.sha1(F.encode(text, "UTF-8")), 1, 12))
    ided = segmented.withColumn("_ids", F.transform("segments", lambda s, i: uuid5(name(s["text"], i))))
    rows = ided.select("*", F.posexplode_outer("segments").alias("chunk_index", "_segment")).drop("segments")
    at = lambda i: F.get("_ids", i)
    return rows.withColumns(
        {
            "chunk_total": F.size("_ids"),
            "chunk_id": at(F.col("chunk_index")),
            "header_path": F.col("_segment.header_path"),
            "text": F.col("_segment.text"),
            "prev_chunk_id": at(F.col("chunk_index") - 1),
            "next_chunk_id": at(F.col("chunk_index") + 1),
        }
    ).drop("_ids", "_segment")


def chunk_id(document_id: Column, part_index: Column, chunk_index: Column, text: Column) -> Column:
    return uuid5(F.concat_ws("|", document_id, part_index.cast("string"), chunk_index.cast("string"), F.substring(F.sha1(F.encode(text, "UTF-8")), 1, 12)))


def neighbour_links(chunks: DataFrame) -> DataFrame:
    """chunk_id, prev_chunk_id, next_chunk_id within a part, from ids alone: a document of any number of chunks lies over many tasks. chunk_id tells chunks apart."""
    ids = chunks.select("chunk_id", "document_id", "part_index", "chunk_index")
    linked = neighbours(ids, ["document_id", "part_index"], ["chunk_index", "chunk_id"], "chunk_id")
    return linked.select("chunk_id", F.col("before").alias("prev_chunk_id"), F.col("after").alias("next_chunk_id"))


def link_neighbours(chunks: DataFrame) -> DataFrame:
    """Adds prev_chunk_id and next_chunk_id to chunks that lack them, within a part."""
    return chunks.join(neighbour_links(chunks), "chunk_id")


def embed_text(chunks: DataFrame, exact: bool = True) -> DataFrame:
    """Adds embed_text: allow-listed metadata by name and the text, or the text alone above the embed limit."""
    limit, _ = budgets(exact)
    known = [c for c in EMBEDDED if c in chunks.columns]
    meta = F.concat_ws("\n", *[F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in known])
    full = F.when(meta == "", F.col("text")).otherwise(F.concat(meta, F.lit("\n\n"), F.col("text")))
    return chunks.withColumn("_full", full).withColumn("embed_text", F.when(count_tokens("_full") > limit, F.col("text")).otherwise(F.col("_full"))).drop("_full")
