"""Files and tables as text parts: discovery, admission, loaders, identity and the cache of parses.

A part has document_id, part_index and text; what else is known of it are columns beside them."""

from __future__ import annotations

import csv
import io
import json
import math
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.text import lines


def visible(path: Column | str, storage: str | None = None) -> Column:
    """No part of a relative path begins with a dot, and it is not in the storage folder."""
    path = F.col(path) if isinstance(path, str) else path
    ok = ~path.rlike(r"(^|/)\.")
    return ok if storage is None else ok & ~path.startswith(f"{storage.strip('/')}/") & (path != storage.strip("/"))


#: Bytes of content that a task reads, and the tasks for each core that there are at least where files are small.
TASK_BYTES, TASKS = 64 << 20, 8


def direct(folder: str) -> bool:
    """Python tasks reach the folder's store themselves: a local or mounted one, or another that pyarrow.fs knows."""
    try:
        FileSystem.from_uri(folder)
    except (OSError, ValueError):
        return False
    return True


def write_files(rows: DataFrame, folder: str) -> None:
    """The content of each row (relative_path, content binary) as a file of its own below folder, a path or URI of a store that is direct() and that all executors see. Tasks write each file where it belongs,
    one that is run again writes the same files anew; Spark's writers would make, and rename in the driver, a folder for each of them."""
    store, root = FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = FileSystem.from_uri(folder)
        made, n = set(), 0
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                full = f"{root}/{path}"
                above = full.rpartition("/")[0]
                if above not in made:
                    store.create_dir(above, recursive=True)
                    made.add(above)
                with store.open_output_stream(full) as out:
                    out.write(content.as_buffer())
            n += batch.num_rows
        yield pa.RecordBatch.from_pydict({"n": [n]})

    rows.select("relative_path", "content").mapInArrow(write, "n bigint").agg(F.sum("n")).collect()  # one row


def discover_files(spark: SparkSession, folder: str, storage: str | None = None) -> DataFrame:
    """relative_path, path, size, mtime_ns, content of all visible files below folder. content is read only if it is used.

    Spark counts 4 MB for opening a file, which makes a task of every few small ones; here tasks are as many as the bytes ask for, and some for each core."""
    root = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    least = TASKS * spark.sparkContext.defaultParallelism
    size = files.select("length").coalesce(least).agg(F.sum("length")).first()[0] or 0
    files = files.coalesce(max(least, math.ceil(size / TASK_BYTES)))
    tail = F.regexp_replace(F.expr("substring_index(path, concat('{0}', '/'), -1)".format(root.split("://")[-1])), r"\\", "/")
    files = files.select(tail.alias("relative_path"), "path", F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), "content")
    return files.where(visible("relative_path", storage))


def admit_files(files: DataFrame, name: str = "name", size: str = "size", max_bytes: int = names.MAX_BYTES) -> DataFrame:
    """Adds clean_name, extension and reject_reason: bad_name, unsupported, too_large, empty, or null for an admitted file."""
    out = files.withColumn("clean_name", names.clean_name(name))
    out = out.withColumn("extension", names.extension("clean_name"))
    reason = F.when(F.col("clean_name").isNull(), "bad_name").when(~F.col("extension").isin(*sorted(names.KINDS)), "unsupported").when(F.col(size) > max_bytes, "too_large").when(F.col(size) < 1, "empty")
    return out.withColumn("reject_reason", reason)


def load_text(files: DataFrame) -> DataFrame:
    """Adds text, the content as UTF-8 without bad bytes; blank files go. An honest replacement sign in the content goes with the bad bytes."""
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\ufffd", "")
    return files.withColumn("text", text).where(F.col("text").rlike(r"\S")).drop("content")


def indented(text: str | None) -> str | None:
    try:
        return json.dumps(json.loads(text), indent=2, ensure_ascii=False)
    except (TypeError, ValueError, RecursionError):
        return text


def load_json(parts: DataFrame) -> DataFrame:
    """text with two spaces of indent, as it is where it can't be parsed."""

    @F.pandas_udf("string")
    def rendered(texts: pd.Series) -> pd.Series:
        return texts.map(indented)

    return parts.withColumn("text", rendered("text"))


def load_delimited(parts: DataFrame, separator: str = ",") -> DataFrame:
    """text with its records as lines of cells joined by ' | '; quoted cells may hold separators and line breaks."""

    @F.pandas_udf("string")
    def rendered(texts: pd.Series) -> pd.Series:
        csv.field_size_limit(2**31 - 1)
        return texts.map(lambda t: None if t is None else "\n".join(" | ".join(r) for r in csv.reader(io.StringIO(t, newline=""), delimiter=separator)))

    return parts.withColumn("text", rendered("text"))


def load_records(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """(key, text): the rows of an already tabular source as lines of cells joined by ' | ', one text for each key."""
    cells = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    ordered = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), cells.alias("line")))).alias("rows"))
    return ordered.select(key, F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text"))


def load_sheets(cells: DataFrame) -> DataFrame:
    """document_id, part_index, sheet_name, text from cells (document_id, sheet_name, sheet_no, row_no, col_no, value).

    Null cells are left out, blank rows and empty sheets dropped; part_index counts the sheets that are kept."""
    present = cells.where("value is not null")
    row = present.groupBy("document_id", "sheet_no", "sheet_name", "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", "value"))).alias("cells"))
    row = row.withColumn("line", F.array_join(F.transform("cells", lambda c: c["value"]), " | ")).where(F.trim("line") != "")
    sheet = row.groupBy("document_id", "sheet_no", "sheet_name").agg(F.array_sort(F.collect_list(F.struct("row_no", "line"))).alias("rows"))
    sheet = sheet.withColumn("text", F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("sheet_no", "sheet_name")) - 1
    return sheet.select("document_id", place.alias("part_index"), "sheet_name", "text")


class _TagText(HTMLParser):
    """Text of every outermost occurrence of a tag, and of the body without scripts and styles."""

    def __init__(self, tag: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.depth, self.muted, self.parts, self.body = tag, 0, 0, [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self.muted += 1
        if tag == self.tag:
            self.depth += 1
            if self.depth == 1:
                self.parts.append([])

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head") and self.muted:
            self.muted -= 1
        if tag == self.tag and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if not self.muted:
            self.body.append(data)
            if self.depth:
                self.parts[-1].append(data)


def html_parts(html: str | None, tag: str) -> list[str]:
    reader = _TagText(tag)
    reader.feed(html or "")
    reader.close()
    clean = lambda pieces: " ".join(" ".join(pieces).split())
    found = [t for t in map(clean, reader.parts) if t]
    return found or [t for t in (clean(reader.body),) if t]


def load_html(pages: DataFrame, html: str = "html", tag: str = "section") -> DataFrame:
    """raw_index and text for every occurrence of tag in a page; a page without one gives the text of its body. Blank parts go."""

    @F.pandas_udf("array<string>")
    def parts(htmls: pd.Series) -> pd.Series:
        return htmls.map(lambda h: html_parts(h, tag))

    return pages.withColumn("_parts", parts(html)).drop(html).select("*", F.posexplode("_parts").alias("raw_index", "text")).drop("_parts")


def attach_identity(parts: DataFrame) -> DataFrame:
    """Parts (relative_path, raw_index, text, hash, size) without blank ones, numbered anew from 0 in each file, with document_id, file_name, extension,
    document_type and language."""
    kept = parts.where(F.trim("text") != "").withColumn("document_id", names.document_id("relative_path"))
    kept = kept.withColumn("part_index", F.row_number().over(Window.partitionBy("document_id").orderBy("raw_index")) - 1)
    kept = kept.withColumn("file_name", names.file_name("relative_path"))
    kept = kept.withColumn("extension", names.extension("file_name"))
    return kept.withColumns({"document_type": names.classify("extension"), "language": names.language("extension")}).drop("raw_index")


def reuse_parses(files: DataFrame, cache: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): files whose content hash the cache (hash, version, ...) holds for this parser version, with what it holds, and one file for each other
    hash, to be parsed once and joined back to every path by hash."""
    own = cache.where(F.col("version") == version).drop("version").dropDuplicates(["hash"])
    return files.join(own, "hash"), files.join(own, "hash", "left_anti").groupBy("hash").agg(F.min("relative_path").alias("relative_path"), F.count("*").alias("paths"))


def prune_parse_cache(cache: DataFrame, manifest: DataFrame, version: str, now: Column, max_age_days: int = 30) -> DataFrame:
    """Adds removed: entries of another version, or of a hash that no manifest record has and that is older than max_age_days. Entries have saved_at."""
    live = manifest.select("hash").distinct().withColumn("live", F.lit(True))
    old = F.col("saved_at") < now - F.expr(f"interval {max_age_days} days")
    return cache.join(live, "hash", "left").withColumn("removed", (F.col("version") != version) | (F.col("live").isNull() & old)).drop("live")


__all__ = ["admit_files", "attach_identity", "discover_files", "lines", "load_delimited", "load_html", "load_json", "load_records", "load_sheets", "load_text", "prune_parse_cache", "reuse_parses", "visible", "write_files"]
