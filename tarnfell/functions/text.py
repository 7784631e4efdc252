"""Text expressions: tokens, lines, normal forms. Word characters are letters, digits and the underscore of any script."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a question.
STOP_WORDS = """the a an is are was were what when where who why how did does do and or to of in on for from with about this that these those
it its be by as at which than can could should would will me my you your tell give please there their them has have had""".split()
WORD = r"[\p{L}\p{N}_]+"
#: A default token: a word or a single other sign.
TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
#: Every line break of the Unicode standard, CR LF as one.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(WORD), F.lit(0))


def tokens(text: Column | str) -> Column:
    """Lower-case words; a word with underscores is followed by its non-empty parts if there are two at least."""
    found = words(F.lower(col(text)))

    def with_parts(t):
        parts = F.filter(F.split(t, "_"), lambda p: p != "")
        return F.when(t.contains("_") & (F.size(parts) > 1), F.concat(F.array(t), parts)).otherwise(F.array(t))

    return F.when(col(text).contains("_"), F.flatten(F.transform(found, with_parts))).otherwise(found)


def content_terms(text: Column | str) -> Column:
    """Distinct tokens that are no stop words."""
    return F.array_except(tokens(text), F.array(*map(F.lit, STOP_WORDS)))


def count_tokens(text: Column | str) -> Column:
    """The default counter: words and single signs. A model's own tokenizer can be given instead wherever a counter is an argument."""
    return F.size(F.regexp_extract_all(col(text), F.lit(TOKEN), F.lit(0)))


def lines(text: Column | str) -> Column:
    """Lines without their breaks; a break at the end opens no line, an empty text has none."""
    parts = F.split(col(text), LINE_BREAK, -1)
    return F.when(F.length(F.element_at(parts, -1)) == 0, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def squash(text: Column | str) -> Column:
    """Lower case, words only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(col(text)), r"[^\p{L}\p{N}_]+", " "))


def normal_question(text: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(col(text), r"\s+", " ")))


def uuid5(name: Column, namespace: str = "6ba7b8119dad11d180b400c04fd430c8") -> Column:
    """The name-based UUID of version 5; the default namespace is the one for URLs."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F))).bitwiseOR(F.lit(0x80))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))
