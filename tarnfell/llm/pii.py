"""Personal data by candidate gradient boosting, in column expressions only.

Base spans come from four strict patterns and their checks. Loose generators propose further, overlapping candidates in what the base spans leave: obfuscated
addresses, runs of digits with any separators, long tokens. Boosted trees judge a candidate by format features (lengths, classes of characters, checks)
and context features (words and signs beside it). They are fitted on a bounded sample of documents and on sentences made from templates, on labels that the generators' own rules don't
give. From the sample, base spans in disguise (written out, regrouped, without their prefix) in their true context and secrets named by an assignment are positive, other candidates are
negative. The templates (TEMPLATES) hold both personal data and what only looks like it: years, prices, counts, order numbers, versions, checksums, names of builds. For each kind of
candidate a rising step function on held-back candidates, which come from other templates than the trees have seen, gives probabilities, and the lowest one whose precision is high
enough is the kind's threshold; the detector reports precision and recall of the held-back candidates by kind.

Finding, judging and redacting is one narrow projection, and linear in the length of a text: a found span is marked by moving its characters, one for one, to
private code points of its kind. Places stay as they are, later patterns are told to read or to skip marked characters, and redaction replaces the marked runs.
Characters that a text itself has there (U+F0000 to U+F037F) are read as U+FFFD, which no pattern takes, and are put back, in order, in what is redacted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted, as_column, fit, isotonic
from .shared import unclashed, written

KINDS = ("email", "ip", "card", "phone")
FOUND = (*KINDS, "address", "number", "secret")
#: The base patterns; {x} is a class of characters. Possessive repeats and look-behinds find the same matches in linear time on any text.
CLASSES = {"local": "A-Za-z0-9._%+-", "host": "A-Za-z0-9-", "at": "@", "dot": ".", "digit": "0-9", "gap": " -", "plus": "+", "dial": " ().0-9-"}
PATTERNS = {
    "email": r"(?:\G|(?<!{local})){local}++{at}{host}++(?:{dot}{host}++)++",
    "ip": r"(?<!{digit}){digit}++{dot}{digit}++{dot}{digit}++{dot}{digit}++",
    "card": r"{digit}(?:{gap}?{digit})++",
    "phone": r"{plus}{digit}{dial}+{digit}",
}
#: The generators of further candidates.
GENERATORS = {
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]++)++| at [A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]++)++)",
    "number": r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])|[0-9]{1,3}(?: ?(?:[.]|\(dot\)|\[dot\]|dot) ?[0-9]{1,3}){3}(?![0-9])|[+(]?[0-9](?:[ ().,/_-]{0,3}[0-9]){5,}+)",
    "secret": r"(?<![A-Za-z0-9_+/=-])(?:(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{16,}+|(?<=[=:] ?[\"'`]?)[A-Za-z0-9_+/=-]{8,}+)",
}
#: Words of the context, by what they hint at.
CONTEXT = {
    "says_mail": "mail|contact|kontakt|correo|courriel|write to",
    "says_phone": "phone|phono|telefon|tel\\b|tel[.:]|call|fax|mobil|cell|ruf|appel",
    "says_ip": "\\bip\\b|host|server|addr|\\bssh\\b|ping|login|gateway|dns|network",
    "says_card": "card|visa|credit|karte|tarjeta|carte|iban",
    "says_secret": "token|secret|passw|api.?key|access.?key|auth|bearer|pwd|kennwort|contrase|mot de passe",
    "says_plain": "\\b(order|part|item|chapter|section|kapitel|invoice|page|vol|no|nr|isbn|year|in|jahr|version|release|build|commit|hash|sum|digest|revision|id|uuid|total|price|about|over|from|since|bestellung|artikel|pedido|commande|desde|depuis)[.:#]? ?$",
}
#: What follows an amount, and the last part of host names.
AMOUNT = r"^ ?(people|persons|inhabitants|copies|words|items|units|years|euros?\b|dollars|eur\b|usd\b|km\b|kg\b|percent|einwohner|jahre|habitantes|habitants|personas|personnes|[%€$£])"
TOP = r"(?i)[a-z0-9](\.| \. ?| dot | ?[(\[]dot[)\]] ?)(com|org|net|edu|gov|info|io|co|dev|de|at|ch|es|fr|eu|uk|us|it|nl|example|test)$"
FEATURES = (
    *("is_address", "is_number", "is_secret", "length", "digits", "letters", "upper", "dots", "spaces", "hyphens", "groups", "longest_group", "starts_plus", "starts_zero", "has_at", "has_paren", "distinct"),
    *("luhn", "octets", "mod_97", "hexadecimal", "thousands", "dated", "top", "ends_upper", *CONTEXT, "amount_after", "after_quote", "after_assign", "after_sign", "letter_before", "letter_after", "word_after"),
)
#: Signs in a template that stand for one of these letters; !! are the check digits of an account number.
SIGNS = {"#": "0123456789", "~": "0123456789abcdef", "^": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "&": "abcdefghijklmnopqrstuvwxyz", "%": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
#: Sentences by kind of candidate: what stands in braces is personal in the first ones and is not in the second ones. Every third sentence of a list is held back for calibration.
TEMPLATES = {
    "address": (
        ("write to {&&&&&.&&&& (at) &&&&&& (dot) org} today", "mail {&&&&## at &&&&&&& dot com} for it", "contact {&&&&_&& [at] &&&&& [dot] net} now", "reach me: {&&&&&@&&&&&& . de}", "send it to {&&&.&&&&& @ &&&&&& . com} please", "Kontakt: {&&&&&& (at) &&&&&-&&& (dot) de}")
        + ("correo {&&&&& (at) &&&&&&& (dot) es} para todo", "courriel : {&&&&&& [at] &&&&&& [dot] fr} ou", "({&&&&&## at &&&&& dot io})", "my mail is {&&&&#### @ &&&&& dot net}, thanks", "ask {&&&&&&& (at) &&&&&&& . org}", "E-Mail {&&&& at &&&& dot &&&&&&& dot eu} an"),
        ("we looked {closely at the dot product} of both", "have {lunch @ noon. Then} we go", "she stopped {suddenly at a dot on} the map", "prices {&&&&& @ ##. Each} one", "they met {&&&&& at &&&&&& dot &&&&&&&&&} there", "he paid {### @ #.##} each", "thanks {&&&&& @ &&&&&. We} will see", "look {there at the dot matrix} printer")
        + ("follow {us @ &&&&&&. Good} luck", "es war {heute @ &&&&&. Danach} kam er", "sold {## @ ##.##} yesterday", "a {point at every dot in} the row"),
    ),
    "number": (
        ("call me on {0## #######} after six", "phone {(###) ###-####} or come", "Tel. {0###/#######} ab neun", "mobile: {07## ### ####}", "teléfono {9## ### ###} de noche", "fax {00## ## #######}", "appelez le tél. {0# ## ## ## ##}", "my cell is {###-###-####}", "Telefon: {0## - ### ## ##}", "server {10 . # . ## . ###} is down")
        + ("host at {1## . ## . # . ##} again", "IP {192 (dot) 168 (dot) # (dot) ##}", "addr {172 [dot] 1# [dot] # [dot] ##} up", "die IP {10 . ## . # . #} war", "ssh to {172 . ## . # . ##} and", "ping {1## dot # dot ## dot #} now", "gateway: {192 . 168 . # . #}", "login on {10 [dot] # [dot] # [dot] #}", "transfer to {DE!! #### #### #### #### ##} soon", "IBAN {FR!! #### #### #### #### #### ###}", "Konto {ES!! #### #### #### #### ####} bitte", "account {GB!! %%%% #### #### #### ##}", "iban: {NL!! %%%% #### #### ##},", "pay {IT!! %### #### #### #### #### ###} now", "{PT!! #### #### #### #### #### #} was used", "from {BE!!############} to", "{PL!!########################} und", "the account {IE!!%%%%##############} is open", "nach {AT!! #### #### #### ####}."),
        ("in {1998 and 2004 123456 people} came", "order {#######} has come", "part {#######} of the order", "the order {####-######} is late", "the city has {#,###,###} inhabitants", "it cost {###.###,##} euro", "a total of {###,###.##} dollars", "on {2021-0#-1#} we met", "am {1#.0#.20##} um", "from {1914-1918} and 1939", "version {10.#.#####}", "invoice {##########} is paid")
        + ("ISBN {978-#-###-#####-#}", "about {######} words", "in the years {1998, 2001, 2004} and", "page {######}", "room {### ###} is free", "the number {########} came up", "pi is {3.14159265}", "Artikel {##-###-####} ist da", "pedido {########} listo", "la commande {##########} est", "item no. {###########}", "{## ### ###} habitants")
        + ("since {19## 20##} it was", "scores were {#. 3#, 4#, 5#} then", "{##/##/####} at ten", "between {######} and", "section {# . # . # . ##} says", "kapitel {#. #. #. #} und", "see section {##.# .# .##}", "chapter {1 . 2 . 3 . 4} says", "weights {#.##, #.##, #.##}", "over {###.###.###} einwohner", "{############} people", "and {#######} then", "with {######} birds", "bestellung {########} kommt", "{####} {#### ####} times", "serial %%## {####-####-####}", "batch {%%## %### ##%% ####} went", "code {DE## #### #### #### #### ##} on it", "plate {%%############} was", "{FR## #### #### #### #### #### ###} parts", "model {GB## %%%% #### #### #### ##} sold"),
    ),
    "secret": (
        ("api_key = {^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^}", "password: {&&&&&&#&&&} ok", "the token={~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~}", "SECRET: '{^^^^^^^^^^^^^^^^^^^^^^^^}'", "Passwort: {%&&&&&###}", "auth: {~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~}", "access_key=\"{AKIA%%%%%%##%%%%%%%%}\"", "Authorization: Bearer {^^^^^^^^^^^^^^^^^^^^#^^^^^^^^^}")
        + ("contraseña: {&&&&&####}", "pwd={^^^^^^^#^^}", "mot de passe : {&&&&&##&&&}", "kennwort = {&&&#&&&#&&}", "apikey: {~~~~~~~~~~~~~~~~~~~~~~~~}", "client_secret=\"{^^^^^^^^^^^#^^^^^^^^}\"", "passwd: {&&&&##&&&&&}", "push with {ghp_^^^^^^^^^^^^#^^^^^^^^^^^^^^^^^^^^^^^} as user", "use {AKIA%%%%##%%%%%#%%%%} for it", "my token is {sk_live_^^^^^^^^^^#^^^^^^^^^^^^^}"),
        ("commit {~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~} mends it", "sha256 {~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~}", "checksum: {~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~}", "id: {~~~~~~~~-~~~~-4~~~-~~~~-~~~~~~~~~~~~}", "Note: {Everything} is fine", "Result: {satisfactory} so far", "in {build-2024-0#-1#-release} it", "size: {########} bytes")
        + ("the digest {~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~} differs", "color={~~~~~~~~}", "time: {202#0##5T1####0} utc", "revision {~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~} of main", "he found {~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~} there", "see {usr/local/share/v#/&&&&&&&}", "und {~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~} war", "n={##########}", "title: {&&&&&&&&&&}", "el {&&&&&&&-&&&&&&-&&&&&&-####} de", "a {state-of-the-art-20##} thing", "le {~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~} du", "object {~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~} is"),
    ),
}
COPIES = 60
#: Documents of the training sample, taken by the smallest hash of doc_id, and candidates that are learned from; precision that the threshold must reach.
TRAIN_DOCUMENTS, TRAIN_CANDIDATES, PRECISION = 8_000, 40_000, 0.97
TREES, DEPTH = 28, 3
_BLOCK = 128
_PRIVATE = 0xF0000
_PLAIN = "".join(map(chr, range(32, 127)))


def _marked(k: int) -> str:
    """The printable characters, marked as of kind k."""
    return "".join(chr(_PRIVATE + 128 * k + ord(c)) for c in _PLAIN)


def _range(k: int, n: int = 1) -> str:
    """A class of the marked characters of n kinds from k on."""
    return f"\\x{{{_PRIVATE + 128 * k:X}}}-\\x{{{_PRIVATE + 128 * (k + n) - 1:X}}}"


#: The marked characters.
PRIVATE = f"[{_range(0, len(FOUND))}]"


def _pattern(name: str, kinds: int) -> str:
    """A base pattern that reads characters marked as of the first kinds like plain ones."""

    def one(spec: str) -> str:
        spans, i = [], 0
        while i < len(spec):
            wide = i + 2 < len(spec) and spec[i + 1] == "-"
            spans.append((ord(spec[i]), ord(spec[i + 2 if wide else i])))
            i += 3 if wide else 1
        return "[" + "".join(f"\\x{{{a + base:X}}}-\\x{{{b + base:X}}}" for base in (0, *(_PRIVATE + 128 * k for k in range(kinds))) for a, b in spans) + "]"

    return PATTERNS[name].format(**{k: one(v) for k, v in CLASSES.items()})


@dataclass
class Detector:
    """Trees and, by kind, the margin that a candidate must reach (no margin: nothing of the kind is added) and what the held-back candidates say: how many are personal, precision and recall."""

    trees: Boosted
    margins: dict[str, float]
    report: dict[str, dict[str, float]]


def _placed(hits: Column, gaps: Column) -> Column:
    """Matches beside the gaps around them: array<struct<h, before, after, g>>, null without a match."""
    n = F.size(hits)
    one = lambda i: F.struct(F.get(hits, i).alias("h"), F.substring(F.get(gaps, i), -24, 24).alias("before"), F.substring(F.get(gaps, i + 1), 1, 12).alias("after"), F.length(F.get(gaps, i)).alias("g"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one))


def _positions(pairs: Column) -> Column:
    """array<struct<start, end, value, before, after>> in code points. The running sum goes by blocks, so that a text with very many matches stays cheap."""
    n = F.size(pairs)
    zero = F.lit(0)
    step = lambda acc, p: acc + p["g"] + F.length(p["h"])
    blocks = F.transform(F.sequence(zero, F.floor((n - 1) / _BLOCK).cast("int")), lambda b: F.slice(pairs, b * _BLOCK + 1, _BLOCK))
    with_sums = F.aggregate(
        blocks,
        F.struct(zero.alias("at"), F.array().cast("array<struct<at:int,items:array<struct<h:string,before:string,after:string,g:int>>>>").alias("out")),
        lambda acc, b: F.struct(F.aggregate(b, acc["at"], step).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), b.alias("items")))).alias("out")),
        lambda acc: acc["out"],
    )
    spans = F.transform(
        with_sums,
        lambda b: F.aggregate(
            b["items"],
            F.struct(b["at"].alias("at"), F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>").alias("out")),
            lambda acc, p: F.struct(
                step(acc["at"], p).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + p["g"]).alias("start"), step(acc["at"], p).alias("end"), p["h"].alias("value"), p["before"].alias("before"), p["after"].alias("after")))).alias("out"),
            ),
            lambda acc: acc["out"],
        ),
    )
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")
    return F.when(pairs.isNull() | (n <= 0), none).otherwise(F.flatten(spans))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the 13 to 19 digits of value pass the checksum; false for other numbers of digits."""
    d = _digits(value)
    n = F.length(d)

    def add(acc, i):
        x = F.substring(d, i, 1).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    return F.when((n >= 13) & (n <= 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def octets(value: Column) -> Column:
    """Whether value is numbers joined by dots of which none is above 255."""
    return _bytes(F.split(value, r"\."))


def _bytes(parts: Column) -> Column:
    parts = F.transform(parts, lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def _rest_97(value: Column) -> Column:
    """What an account number of letters and digits leaves when divided by 97, its first four signs moved to the end, letters from A on read as 10 and up."""
    own = F.upper(F.replace(value, F.lit(" "), F.lit("")))
    step = lambda acc, c: F.when(c.between("0", "9"), acc * 10 + c.try_cast("int")).when(c.between("A", "Z"), acc * 100 + F.ascii(c) - 55).otherwise(acc) % 97
    return F.aggregate(F.split(F.concat(F.substring(own, 5, 40), F.substring(own, 1, 4)), ""), F.lit(0), step)


#: What a base match must pass, by its value.
_CHECKS = {"email": lambda v: F.lit(True), "ip": octets, "card": luhn, "phone": lambda v: F.length(_digits(v)).between(9, 15)}


def _features(name: str, s: Column) -> dict[str, Column]:
    value, before, after = s["value"], F.lower(s["before"]), s["after"]
    count = lambda pattern: F.length(F.regexp_replace(value, f"[^{pattern}]", "")).cast("double")
    groups = F.filter(F.split(value, "[^0-9]+"), lambda g: g != "")
    flag = lambda c: c.cast("double")
    return {
        "is_address": F.lit(float(name == "address")),
        "is_number": F.lit(float(name == "number")),
        "is_secret": F.lit(float(name == "secret")),
        "length": F.length(value).cast("double"),
        "digits": count("0-9"),
        "letters": count("A-Za-z"),
        "upper": count("A-Z"),
        "dots": count("."),
        "spaces": count(" "),
        "hyphens": count("_-"),
        "groups": F.size(groups).cast("double"),
        "longest_group": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)).cast("double"),
        "starts_plus": flag(value.startswith("+")),
        "starts_zero": flag(value.rlike(r"^\(?0")),
        "has_at": flag(value.contains("@")),
        "has_paren": flag(value.contains("(")),
        "distinct": F.size(F.array_distinct(F.split(value, ""))).cast("double"),
        "luhn": flag(luhn(value)),
        "octets": flag(value.rlike(r"^[0-9]{1,3}( ?[.,(\[-] ?(dot[)\]] ?)?[0-9]{1,3}){3}$") & _bytes(groups)),
        "mod_97": flag(F.when(value.rlike("^[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"), _rest_97(value) == 1).otherwise(F.lit(False))),
        "hexadecimal": flag(value.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "thousands": flag(value.rlike(r"^[0-9]{1,3}([., ][0-9]{3})+([.,][0-9]{1,2})?$")),
        "dated": flag(value.rlike(r"(^|[^0-9])(1[5-9]|20)[0-9]{2}([^0-9]|$)")),
        "top": flag(value.rlike(TOP)),
        "ends_upper": flag(value.rlike("[^A-Za-z][A-Z][a-z]+$")),
        **{k: flag((F.concat(before, F.lower(value)) if k == "says_secret" else before).rlike(p)) for k, p in CONTEXT.items()},
        "after_quote": flag(before.rlike("[\"'`]$")),
        "amount_after": flag(F.lower(after).rlike(AMOUNT)),
        "after_assign": flag(before.rlike("[=:] ?[\"'`]?$") | value.rlike("^[A-Za-z_-]+=[^=]")),
        "after_sign": flag(before.rlike("[€$£#] ?$")),
        "letter_before": flag(s["before"].rlike(r"\p{L}$")),
        "letter_after": flag(after.rlike(r"^\p{L}")),
        "word_after": flag(after.rlike(r"^ \p{Ll}")),
    }


def _guard(name: str) -> Column:
    """Whether a pattern can match in work; cheaper than the pattern. numeric: whether the body has a digit."""
    has = F.col("work").contains
    if name in ("email", "phone"):
        return (F.size("base") > 0) | has("+") if name == "phone" else has("@")
    if name == "address":
        return has("@") | has("(at)") | has("[at]") | (has(" at ") & (has(" dot ") | has("(dot)") | has("[dot]")))
    return F.col("numeric") | has("=") | has(":") if name == "secret" else F.col("numeric")


def _matched(rows: DataFrame, name: str, extract) -> DataFrame:
    """Adds hits, gaps and places (array<struct<start, end, value, before, after>>) of a pattern in the column work. Steps are columns of their own, so that each is computed once."""
    rows = rows.withColumn("hits", F.when(_guard(name), extract(lambda p: F.regexp_extract_all("work", F.lit(p), F.lit(0)))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("gaps", F.when(F.size("hits") > 0, extract(lambda p: F.split("work", p, -1))))
    rows = rows.withColumn("pairs", _placed(F.col("hits"), F.col("gaps")))
    return rows.withColumn("places", _positions(F.col("pairs"))).drop("pairs")


def _taken(rows: DataFrame, k: int, into: str) -> DataFrame:
    """Adds the spans (start, end, ok) that are ok to the array `into`, and marks them in work."""
    some = F.exists("spans", lambda s: s["ok"])
    piece = lambda i: F.concat(F.get("gaps", i), F.coalesce(F.when(F.get("spans", i)["ok"], F.translate(F.get("hits", i), _PLAIN, _marked(k))).otherwise(F.get("hits", i)), F.lit("")))
    work = F.when(some, F.array_join(F.transform(F.sequence(F.lit(0), F.size("hits")), piece), "")).otherwise(F.col("work"))
    found = F.transform(F.filter("spans", lambda s: s["ok"]), lambda s: F.struct(F.lit(FOUND[k]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.withColumns({"work": work, into: F.concat(into, found)}).drop("hits", "gaps", "places", "spans")


def _based(rows: DataFrame) -> DataFrame:
    """Adds base, array<struct<kind, start, end>> by kind as listed, then start, and work, the body with these spans marked."""
    rows = rows.withColumn("body", F.when(F.col("body").rlike(PRIVATE), F.regexp_replace("body", PRIVATE, "\ufffd")).otherwise(F.col("body")))
    rows = rows.withColumns({"work": F.col("body"), "numeric": F.col("body").rlike("[0-9]"), "base": F.array().cast("array<struct<kind:string,start:int,end:int>>")})
    for k, name in enumerate(KINDS):
        rows = _taken(_checked(rows, k, name), k, "base")
    return rows


def _checked(rows: DataFrame, k: int, name: str) -> DataFrame:
    """Adds hits, gaps and spans (start, end, ok) of the base kind k."""
    touched = F.size("base") > 0
    rows = _matched(rows, name, lambda f: F.when(touched, f(_pattern(name, k))).otherwise(f(_pattern(name, 0))) if k else f(_pattern(name, 0)))
    plain = lambda v: F.when(touched, F.translate(v, "".join(map(_marked, range(k))), _PLAIN * k)).otherwise(v) if k else v
    return rows.withColumn("spans", F.transform("places", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _CHECKS[name](plain(s["value"])).alias("ok"))))


def _candidates(rows: DataFrame, name: str) -> DataFrame:
    """Adds hits, gaps and candidates, array<struct<start, end, value, features...>>, of a generator in the column work."""
    rows = _matched(rows, name, lambda f: f(GENERATORS[name]))
    return rows.withColumn("candidates", F.transform("places", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), *[v.alias(f) for f, v in _features(name, s).items()])))


def _learned_from(rows: DataFrame) -> DataFrame:
    """All candidates of rows (body, work, numeric and others), one a row, with kind."""
    out = None
    for name in GENERATORS:
        # outer: Spark would else infer a filter from the generator and push it, with all patterns, below every step
        found = _candidates(rows, name).select(*[c for c in rows.columns if c not in ("body", "work", "numeric")], F.lit(name).alias("kind"), F.inline_outer("candidates")).where("value is not null")
        out = found if out is None else out.unionByName(found)
    return out


def _disguised(rows: DataFrame) -> DataFrame:
    """Short texts (key, body, low, high) around each base span, from low to high a disguise of it."""
    marked = f"[{_range(0, len(KINDS))}]+"
    rows = _matched(rows, "number", lambda f: f(marked))
    each = rows.select("key", F.inline_outer("places")).where("value is not null")
    back = lambda c: F.translate(c, "".join(map(_marked, range(len(KINDS)))), _PLAIN * len(KINDS))
    kind = F.floor((F.ascii("value") - _PRIVATE) / 128)
    each = each.select("key", kind.alias("kind"), back(F.col("value")).alias("value"), back(F.col("before")).alias("before"), back(F.col("after")).alias("after"), F.pmod(F.xxhash64("key", "start"), F.lit(4)).alias("way"))
    sign = lambda *forms: F.element_at(F.array(*map(F.lit, forms)), (F.col("way") + 1).cast("int"))
    digits = _digits(F.col("value"))
    disguise = (
        F.when(F.col("kind") == 0, F.replace(F.replace("value", F.lit("."), sign(" (dot) ", " dot ", " . ", "[dot]")), F.lit("@"), sign(" (at) ", " at ", " @ ", "[at]")))
        .when(F.col("kind") == 1, F.replace("value", F.lit("."), sign(". ", " .", ",", "-")))
        .when(F.col("kind") == 2, F.call_function("array_join", F.regexp_extract_all(digits, F.lit("[0-9]{1,4}"), F.lit(0)), sign("/", ".", "  ", "_")))
        .otherwise(F.concat(sign("0", "00", "(0)", "0"), F.substring(digits, 3, 20)))
    )
    return each.select("key", F.concat("before", disguise, "after").alias("body"), F.length("before").alias("low"), F.length(F.concat("before", disguise)).alias("high"))


def _made(spark: SparkSession) -> DataFrame:
    """The sentences of TEMPLATES, COPIES of each with other signs (key, body, low, high, label, own, held); low to high is what stood in braces, own its kind."""
    all_of = [(kind, 1 - k, n % 3 == 2, text) for kind, lists in TEMPLATES.items() for k, texts in enumerate(lists) for n, text in enumerate(texts)]
    one = lambda t, kind, label, held, text: F.struct(F.lit(t).alias("t"), F.lit(kind).alias("own"), F.lit(label).alias("label"), F.lit(held).alias("held"), F.lit(text).alias("text"))
    rows = spark.range(COPIES).select("id", F.inline(F.array(*[one(t, *row) for t, row in enumerate(all_of)])))

    def letter(c, i):
        for sign, letters in SIGNS.items():
            c = F.when(c == sign, F.substring(F.lit(letters), (F.pmod(F.xxhash64("t", "id", i), F.lit(len(letters))) + 1).cast("int"), 1)).otherwise(c)
        return c

    rows = rows.withColumn("text", F.array_join(F.transform(F.split("text", ""), letter), ""))
    account = F.regexp_extract("text", r"\{([A-Z]{2}!![^}]*)\}", 1)
    check = F.lpad((98 - _rest_97(F.replace(account, F.lit("!!"), F.lit("00")))).cast("string"), 2, "0")
    rows = rows.withColumn("text", F.when(F.col("text").contains("!!"), F.replace("text", F.lit("!!"), check)).otherwise(F.col("text")))
    low = F.locate("{", F.col("text")) - 1
    body = F.regexp_replace("text", "[{}]", "")
    return rows.select(F.xxhash64("t", "id").alias("key"), body.alias("body"), low.alias("low"), (F.locate("}", F.col("text")) - 2).alias("high"), "label", "own", "held")


def train_detector(docs: DataFrame, documents: int = TRAIN_DOCUMENTS, precision: float = PRECISION, candidates: int = TRAIN_CANDIDATES) -> Detector:
    """Fit on at most `candidates` candidates: those of COPIES sentences of every template, then those of at most `documents` documents, both taken by the smallest hash."""
    own = unclashed(docs, "doc_id", "text")
    chosen = own.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents).distinct()
    rows = own.join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("body"))
    rows = written(_based(rows).select("key", "body", "work", F.lit(True).alias("numeric")), "sample")
    short = _disguised(rows).withColumn("label", F.lit(1)).unionByName(_made(docs.sparkSession), allowMissingColumns=True).withColumns({"work": F.col("body"), "numeric": F.lit(True)})
    found = _learned_from(written(rows.unionByName(short, allowMissingColumns=True), "lessons"))
    found = found.where("low is null or start < high and end > low and coalesce(own = kind, true)")
    named = (F.col("kind") == "secret") & (F.col("after_assign") == 1) & (F.col("says_secret") == 1)
    found = found.withColumn("label", F.coalesce("label", named.cast("int"))).withColumn("turn", F.xxhash64("key", "start", "label"))
    found = found.withColumn("held", F.coalesce("held", F.pmod("turn", F.lit(3)) == 2)).orderBy(F.col("own").isNull(), "turn", "kind", *FEATURES).limit(candidates).select("kind", "label", "held", *FEATURES).toArrow()
    y = np.asarray(found["label"], np.int64)
    x = np.stack([np.asarray(found[f], np.float64) for f in FEATURES], 1)
    held, kinds = np.asarray(found["held"]), np.asarray(found["kind"])
    trees = fit(x[~held], y[~held], list(FEATURES), trees=TREES, depth=DEPTH, rate=0.3)
    margins, report = {}, {}
    for kind in GENERATORS:
        here = held & (kinds == kind)
        margin, true = trees.margin(x[here]), y[here]
        # personal ones first, so that equal margins fall into one pool
        order = np.argsort(-true, kind="stable")
        margin, true = margin[order], true[order]
        knots, levels = isotonic(margin, true)
        good = levels >= precision
        if good.any():
            margins[kind] = float(knots[good][0])
        taken = margin >= margins.get(kind, np.inf)
        report[kind] = {"personal": int(true.sum()), "other": int((1 - true).sum()), "precision": float(true[taken].mean()) if taken.any() else 1.0, "recall": float(taken[true == 1].mean())}
    return Detector(trees, margins, report)


def _judged(rows: DataFrame, detector: Detector) -> DataFrame:
    """Adds base, extra and work; extra are the candidates beside the base spans that the trees accept."""
    own = rows.columns[0]
    rows = _based(rows).withColumn("extra", F.array().cast("array<struct<kind:string,start:int,end:int>>"))
    for k, name in enumerate(FOUND):
        if name in detector.margins:
            rows = _candidates(rows, name)
            rows = rows.withColumn("spans", F.transform("candidates", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), (as_column(detector.trees, lambda n: c[n]) >= detector.margins[name]).alias("ok"))))
            rows = _taken(rows, k, "extra").drop("candidates")
    # Spark would push a user's filter on a result down to the scan, with all steps in it once for each use; it does not push one below a generator
    return rows.select(own, F.inline_outer(F.array(F.struct("base", "extra", "work"))))


def personal_data(docs: DataFrame, detector: Detector) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_extra, base_sha256, spans for every row; narrow, in time linear in the text.

    Null text is empty and has no spans. Ends are exclusive, in code points; base spans come first by kind, then extra ones by kind and start. Spans of one kind never overlap, those of different
    base kinds may. Repeated rows and rows without a doc_id come out as they come in; other columns are left out."""
    rows = _judged(unclashed(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("body")), detector)
    shown = lambda spans: F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    rows = rows.select("doc_id", "base", shown(F.col("base")).alias("names"), shown(F.col("extra")).alias("more"))

    def count(k):
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")

    counts = [count(k) for k in KINDS]
    return rows.select("doc_id", *counts, F.size("more").cast("long").alias("n_extra"), F.sha2(F.array_join("names", ","), 256).alias("base_sha256"), F.array_join(F.concat("names", "more"), ",").alias("spans"))


def redacted(docs: DataFrame, detector: Detector) -> DataFrame:
    """docs with every found span replaced by its kind in brackets, spans that overlap or touch by the first one's, and n_chars, if there is such a column, by the new
    length; all else in a text, private code points too, and all other columns and rows as they are, null texts too; narrow."""
    rows = _judged(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("body")), detector)
    every = _range(0, len(FOUND))
    text = F.col("work")
    for k, name in enumerate(FOUND):
        text = F.regexp_replace(text, f"(?<![{every}])[{_range(k)}][{every}]*+", f"[{name.upper()}]")
    # the text's own private characters, read as U+FFFD and in no span, go back between the pieces around them
    lost = F.regexp_extract_all("row.text", F.lit(f"{PRIVATE}|\ufffd"), F.lit(0))
    back = F.array_join(F.zip_with(F.split(text, "\ufffd", -1), lost, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    text = F.when(F.col("row.text").rlike(PRIVATE), back).otherwise(text)
    rows = rows.withColumn("clean", F.when((F.size("base") == 0) & (F.size("extra") == 0), F.col("row.text")).otherwise(text))
    kinds = {f.name: f.dataType for f in docs.schema}
    new = {"text": F.col("clean"), "n_chars": F.length("clean")}
    return rows.select(*[(new[c].cast(kinds[c]) if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
