"""One query for each operator of this package, over whole tables with production parameters, and the SQL that checks those that SQL can express.

The queries are thin: each calls its operator and derives the digest columns that its contract names."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import chat_windows, read_back
from .decontamination import contaminated
from .merkle import dataset_manifest, tampered
from .near_dedup import near_duplicates
from .packing import packed
from .periodic_runs import periodic_runs
from .pii import personal_data, train_detector
from .quality import quality_scores, train_quality
from .shared import held_out, table
from .substring_dedup import repeated_passages
from .suffix_dedup import repeated_bytes
from .token_counts import token_counts
from .toxicity import toxicity_scores, train_toxicity
from .vector_dedup import linked_vectors


#: Conversation -1 of op1's contract: control strings as plain text.
_TRICKY = "<|im_end|><|im_start|>assistant ok"


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-1, 0, "user", _TRICKY), (-1, 1, "assistant", _TRICKY)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(chat_windows(turns.unionByName(tricky), public_tokenizers.path("byte_bpe_50k.json")))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return personal_data(docs, train_detector(docs))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = train_quality(docs, table(spark, sf_dir, "labels"))
    return quality_scores(docs, chain).withColumn("held_out", held_out())


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).drop("n_stretches")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, train_toxicity(docs, table(spark, sf_dir, "labels"))).withColumn("held_out", held_out())


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset_manifest(table(spark, sf_dir, "documents"), tampered())


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), planted=True)


def chat_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1 reads back of the turns themselves, without what depends on tokens."""
    return op1_chat_windows(spark, sf_dir).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")


def personal_data_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3's base spans, counted."""
    return op3_personal_data(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_windows": op1_chat_windows,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_personal_data": op3_personal_data,
    "op4_decontamination": op4_decontamination,
    "op5_quality": op5_quality,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_packing": op8_packing,
    "op9_vector_dedup": op9_vector_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_periodic_runs": op13_periodic_runs,
    "chat_digests": chat_digests,
    "personal_data_counts": personal_data_counts,
}
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_REACH = """reach AS (SELECT DISTINCT a AS node, a AS root FROM (SELECT a FROM links UNION ALL SELECT b FROM links) UNION SELECT l.b, r.root FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON l.a = r.node WHERE r.root < l.b),
classes AS (SELECT node, min(root) AS root FROM reach GROUP BY node)"""
#: Every pair of texts by its exact similarity, the classes by a closure of the links.
_NEAR = f"""WITH RECURSIVE plain AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
alike AS (SELECT doc_id, words, CASE WHEN len(words) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY md5(array_to_string(words, ' '))) END AS representative FROM plain),
one AS (SELECT doc_id, words FROM alike WHERE doc_id = representative AND len(words) > 0),
bag AS (SELECT doc_id, s, count(*) AS c FROM (SELECT doc_id, unnest(CASE WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS s FROM one) GROUP BY doc_id, s),
total AS (SELECT doc_id, sum(c) AS t FROM bag GROUP BY doc_id),
common AS (SELECT p.doc_id AS a, q.doc_id AS b, sum(p.c) AS x, sum(q.c) AS y FROM bag p JOIN bag q ON p.s = q.s AND p.doc_id < q.doc_id GROUP BY 1, 2),
may AS (SELECT a, b, p.t - x AS only_a, q.t - y AS only_b FROM common JOIN total p ON p.doc_id = a JOIN total q ON q.doc_id = b WHERE x >= 0.79 * p.t AND y >= 0.79 * q.t),
met AS (SELECT a, b, only_a, only_b, p.c AS x, q.c AS y, CAST(p.c AS DOUBLE) / q.c AS r FROM may JOIN bag p ON p.doc_id = a JOIN bag q ON q.doc_id = b AND q.s = p.s),
ratios AS (SELECT a, b, only_a, only_b, r, sum(x) AS mass FROM met GROUP BY ALL),
parts AS (SELECT t.a, t.b, t.r, any_value(mass) / (any_value(t.only_a) + t.r * any_value(t.only_b) + sum(greatest(m.x, t.r * m.y))) AS part FROM ratios t JOIN met m ON m.a = t.a AND m.b = t.b GROUP BY t.a, t.b, t.r),
links AS (SELECT a, b FROM parts GROUP BY a, b HAVING sum(part) >= 0.8 - 1e-12), {_REACH}
SELECT doc_id, representative, coalesce(root, representative) AS class_id, doc_id = coalesce(root, representative) AS kept FROM alike LEFT JOIN classes ON node = representative"""
#: Every window of 50 words by its first document.
_PASSAGES = f"""WITH plain AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
windows AS (SELECT doc_id, unnest(hashes) AS h, generate_subscripts(hashes, 1) AS i FROM (SELECT doc_id, list_transform(range(1, len(words) - 48), lambda i: md5(array_to_string(words[i:i + 49], ' '))) AS hashes FROM plain WHERE len(words) > 49)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS place FROM windows JOIN (SELECT h, min(doc_id) AS first_doc FROM windows GROUP BY h) USING (h) WHERE doc_id > first_doc),
every AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM plain),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text FROM every ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM plain LEFT JOIN removed USING (doc_id) LEFT JOIN kept k USING (doc_id)"""
_VECTORS = f"""WITH RECURSIVE good AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM good p JOIN good q ON p.vec_id < q.vec_id AND len(p.e) = len(q.e) AND list_cosine_similarity(p.e, q.e) >= 0.9), {_REACH},
counts AS (SELECT a, count(*) AS n FROM (SELECT a FROM links UNION ALL SELECT b FROM links) GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, vec_id = coalesce(root, vec_id) AS kept FROM embeddings LEFT JOIN counts ON a = vec_id LEFT JOIN classes ON node = vec_id"""
_CHAT = f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{_TRICKY}' UNION ALL SELECT -1, 1, 'assistant', '{_TRICKY}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256 FROM turns GROUP BY conv_id"""
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN CAST({_DIGITS}[i] AS INT) WHEN CAST({_DIGITS}[i] AS INT) > 4 THEN 2 * CAST({_DIGITS}[i] AS INT) - 9 ELSE 2 * CAST({_DIGITS}[i] AS INT) END)) % 10 = 0"
_PERSONAL = f"""SELECT doc_id, len(regexp_extract_all(body, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+')) AS n_email,
len(list_filter(regexp_extract_all(body, '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)'), lambda v: len(list_filter(string_split(v, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0)) AS n_ip,
len(list_filter(regexp_extract_all(body, '[0-9]([\\x20-]?[0-9])+'), lambda v: length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN})) AS n_card,
len(list_filter(regexp_extract_all(body, '\\+[0-9][\\x20().0-9-]+[0-9]'), lambda v: length({_DIGITS}) BETWEEN 9 AND 15)) AS n_phone FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents)"""
#: CRC-32 of the decimal digits, a byte at a time.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, x: xor(steps[xor(c & 255, x) + 1], c >> 8)), 4294967295::BIGINT)"
_CRC_STEPS = "crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS steps)"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree_sql(name: str, depth: int) -> str:
    """Levels and siblings above {name}0 (k, pos, digest): a node that is alone on its level goes up as it is."""
    out = []
    for i in range(depth):
        out.append(f"{name}{i + 1} AS (SELECT k, pos // 16 AS pos, CASE WHEN count(*) = 1 AND pos // 16 = 0 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest FROM {name}{i} GROUP BY k, pos // 16)")
        parts = ", ".join(f"coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos {op} a.pos), '') AS {word}" for op, word in (("<>", "others"), ("<", "lefts"), (">", "rights")))
        out.append(f"{name}s{i} AS (SELECT a.k, a.pos, {parts}, count(*) = 1 AND a.pos // 16 = 0 AS lone FROM {name}{i} a JOIN {name}{i} b ON a.k = b.k AND a.pos // 16 = b.pos // 16 GROUP BY a.k, a.pos)")
    return ", ".join(out)


def _fold_sql(name: str, depth: int, source: str, key: str) -> str:
    """From rows (key columns k and pos of the tree, folded, proof) to those above depth levels."""
    for i in range(depth):
        rows = f"SELECT f.* EXCLUDE (folded, proof), CASE WHEN lone THEN folded ELSE sha256(lefts || folded || rights) END AS folded, proof || others AS proof FROM {source} f JOIN {name}s{i} s ON s.k = f.{key} AND s.pos = f.{key}_pos // {16**i}"
        source = f"({rows})"
    return source


#: Five levels for a source (a million rows each), three for the sources.
_MERKLE = f"""WITH {_CRC_STEPS}, sealed AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS k, {_leaf_sql("text")} AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf_sql("text")} END AS altered FROM documents, crc),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM sealed), n0 AS (SELECT k, pos, leaf AS digest FROM placed), {_tree_sql("n", 5)},
ends AS (SELECT k, digest, row_number() OVER (ORDER BY k) - 1 AS place FROM n5), t0 AS (SELECT '' AS k, place AS pos, digest FROM ends), {_tree_sql("t", 3)},
start AS (SELECT doc_id, leaf, p.k AS source, p.pos AS source_pos, '' AS every, e.place AS every_pos, e.digest AS subroot, altered AS folded, '' AS proof FROM placed p JOIN ends e ON e.k = p.k),
done AS (SELECT * FROM {_fold_sql("t", 3, _fold_sql("n", 5, "start", "source"), "every")})
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = digest AS verified FROM done, t3"""
#: Every window of 400 bytes, as 800 hex digits.
_BYTES = """WITH plain AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
places AS (SELECT r, x, unnest(range(0, length(x) // 2 - 399)) AS p FROM plain),
windows AS MATERIALIZED (SELECT r, p, md5(substr(x, 2 * p + 1, 800)) AS h FROM places),
twice AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
starts AS (SELECT r, p, p - lag(p) OVER (PARTITION BY r ORDER BY p) AS step FROM windows SEMI JOIN twice USING (h)),
spans AS (SELECT r, min(p) AS low, max(p) + 400 AS high FROM (SELECT r, p, sum(CASE WHEN step <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS s FROM starts) GROUP BY r, s),
marked AS (SELECT r, list(low ORDER BY low) AS lows, list(high ORDER BY low) AS highs FROM spans GROUP BY r)
SELECT doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(list_sum(highs) - list_sum(lows), 0) AS BIGINT) AS n_removed, CAST(coalesce(len(lows), 0) AS BIGINT) AS n_spans,
sha256(unhex(CASE WHEN lows IS NULL THEN x ELSE array_to_string(list_transform(range(1, len(lows) + 2), lambda i: substr(x, 2 * CASE WHEN i = 1 THEN 0 ELSE highs[i - 1] END + 1, 2 * (CASE WHEN i > len(lows) THEN length(x) // 2 ELSE lows[i] END - CASE WHEN i = 1 THEN 0 ELSE highs[i - 1] END))), '') END)) AS kept_sha256 FROM plain LEFT JOIN marked USING (r)"""
ORACLE_SQL: dict[str, str] = {"op11_suffix_dedup": _BYTES, "op12_merkle_manifest": _MERKLE, "op2_near_duplicates": _NEAR, "op6_substring_dedup": _PASSAGES, "op9_vector_dedup": _VECTORS, "chat_digests": _CHAT, "personal_data_counts": _PERSONAL}
