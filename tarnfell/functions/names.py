"""File names: extension, kind, language, clean name, identity."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Extensions by kind, in order of precedence, and the language of code extensions.
PARSED = ".pdf .docx .doc .pptx .ppt .pptm .png .jpg .jpeg".split()
MARKDOWN = ".md .markdown".split()
CODE = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp",
    ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin", ".kts": "kotlin", ".cs": "csharp", ".scala": "scala", ".sql": "sql", ".sh": "bash", ".bash": "bash",
}
TABULAR = ".csv .tsv".split()
SPREADSHEET = ".xlsx .xls".split()
HTML = ".html .htm".split()
TEXT = ".txt .text .log .ini .cfg .conf .env .xml .yaml .yml .toml".split()
KINDS = {**dict.fromkeys(TEXT, "text"), **dict.fromkeys(HTML, "html"), **dict.fromkeys(SPREADSHEET, "spreadsheet"), **dict.fromkeys(TABULAR, "tabular"), ".json": "json", **dict.fromkeys(CODE, "code"), **dict.fromkeys(MARKDOWN, "markdown"), **dict.fromkeys(PARSED, "document")}
#: Other names of languages.
LANGUAGE_ALIASES = {"py": "python", "python3": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "cs": "c_sharp", "csharp": "c_sharp", "c#": "c_sharp", "c++": "cpp", "cc": "cpp", "h": "c", "sh": "bash", "shell": "bash", "rb": "ruby", "rs": "rust", "kt": "kotlin", "golang": "go"}
MAX_BYTES = 100 * 1024 * 1024


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(values.items())))[key]


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(F.regexp_replace(col(path), r"\\", "/"), "/"), -1)


def extension(name: Column | str) -> Column:
    """The last suffix in lower case, with its dot; empty for a name without one, a hidden name, or one that ends in a dot."""
    return F.lower(F.regexp_extract(col(name), r"(?s)[^.].*(\.[^.]+)$", 1))


def classify(ext: Column | str) -> Column:
    return F.coalesce(_lookup(KINDS, F.lower(col(ext))), F.lit("unknown"))


def language(ext: Column | str) -> Column:
    return _lookup(CODE, F.lower(col(ext)))


def normal_language(name: Column | str) -> Column:
    n = F.lower(F.trim(col(name)))
    return F.coalesce(_lookup(LANGUAGE_ALIASES, n), n)


def clean_name(raw: Column | str, max_length: int = 150) -> Column:
    """A flat, harmless name: no directories, odd signs as underscores, the stem shortened and the suffix kept; null for blank and hidden names."""
    plain = F.regexp_replace(file_name(F.regexp_replace(col(raw), r"[/\\]+$", "")), r"(?U)^\s+|\s+$", "")
    name = F.regexp_replace(plain, r"[^\p{L}\p{N}_.\- ()]", "_")
    suffix = F.regexp_extract(name, r"(?s)[^.].*(\.[^.]+)$", 1)
    short = F.concat(F.substring(name, F.lit(1), F.least(F.length(name) - F.length(suffix), F.lit(max_length) - F.length(suffix))), suffix)
    return F.when((name == "") | name.startswith("."), None).when(F.length(name) > max_length, short).otherwise(name)


def document_id(path: Column | str) -> Column:
    return F.sha2(F.lower(F.regexp_replace(col(path), r"\\", "/")), 256)
