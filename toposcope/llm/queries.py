"""One query per operator over the whole test tables, and SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toposcope.llm import archives, chat, codes, decontaminate, jaccard, neighbours, pieces, quality, repair, secrets, sharding, substring, toxicity

PIECE_MODEL = os.environ.get("TOPOSCOPE_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words left after cutting every 50-word window that a smaller document holds too."""
    return substring.remove_repeats(table(spark, folder, "documents"), width=50, keep_text=False).drop("intervals")


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items found in documents, verbatim or with other numbers, names and units."""
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates for secrets in all documents, scored by the forest."""
    return secrets.find_secrets(table(spark, folder, "documents"))


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Ledger of all rules, the base policy's verdict and the current policy's."""
    rows = quality.ledger(table(spark, folder, "documents"))
    return quality.apply_policy(rows, quality.CURRENT).withColumn("base_failed", ~quality.passes(quality.BASE)).drop("policy")


def op5_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Preference pairs of all conversations; masks as text."""
    rows = chat.format_preferences(chat.paired_conversations(table(spark, folder, "conversations")))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias(c)
    return rows.withColumns({c: text(c) for c in ("chosen_mask", "rejected_mask")})


def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return jaccard.similar_groups(table(spark, folder, "documents"), width=4, percent=85).drop("node")


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 16 shards of near equal size; equal texts stay together."""
    return sharding.pack(table(spark, folder, "documents"), shards=16)


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels that are not held out."""
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """A sampled segmentation of every document, checked by decoding it."""
    return pieces.encode(table(spark, folder, "documents"), PIECE_MODEL)


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages through ARC into WARC files and back."""
    return archives.convert_pages(table(spark, folder, "pages"), least_bytes=0)


def op11_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest found by the adaptive dimension scan for every embedding whose id is divisible by 100."""
    return neighbours.nearest(table(spark, folder, "embeddings"), k=10)


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation damaged by its keys, its faults, and the cheapest legal repair with its audit."""
    return repair.audit(table(spark, folder, "conversations"))


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """All usable embeddings as 16 integer part codes of 64 entries after two rounds; errors and codebook hash."""
    return codes.encode(table(spark, folder, "embeddings")).drop("codes")


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_secret_scan": op3_secret_scan,
    "op4_quality_rules": op4_quality_rules,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_sharding": op7_sharding,
    "op8_toxicity": op8_toxicity,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_warc": op10_warc,
    "op11_nearest_neighbours": op11_nearest_neighbours,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_vector_codes": op13_vector_codes,
}

SQL = {
    "op13_vector_codes": """
WITH v AS (
  SELECT vec_id::BIGINT AS vec_id, label, list_transform(embedding, lambda x: floor(x * 256)::BIGINT) AS q, len(embedding) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
wd AS (SELECT w, w // 16 AS s FROM v ORDER BY vec_id NULLS LAST, q LIMIT 1),
k AS (SELECT v.vec_id, v.label, v.q, wd.s, row_number() OVER () AS rid FROM v, wd WHERE v.w = wd.w AND wd.w % 16 = 0),
comp AS (SELECT rid, (i - 1) // s AS part, (i - 1) % s AS pos, q[i] AS x FROM (SELECT rid, s, q, unnest(range(1, len(q) + 1)) AS i FROM k)),
init AS (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1 AS entry FROM k QUALIFY entry < 64),
cb0 AS (SELECT part, entry, pos, x FROM comp JOIN init USING (rid)),
d0 AS (SELECT c.rid, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS d FROM comp c JOIN cb0 b USING (part, pos) GROUP BY ALL),
a0 AS (SELECT rid, part, entry, d FROM d0 QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY d, entry) = 1),
u0 AS (SELECT c.part, a.entry, c.pos, sum(c.x) AS sx, count(*) AS n FROM comp c JOIN a0 a USING (rid, part) GROUP BY ALL),
cb1 AS (SELECT b.part, b.entry, b.pos, coalesce(((u.sx - ((u.sx % u.n + u.n) % u.n)) // u.n)::BIGINT, b.x) AS x FROM cb0 b LEFT JOIN u0 u USING (part, entry, pos)),
d1 AS (SELECT c.rid, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS d FROM comp c JOIN cb1 b USING (part, pos) GROUP BY ALL),
a1 AS (SELECT rid, part, entry, d FROM d1 QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY d, entry) = 1),
u1 AS (SELECT c.part, a.entry, c.pos, sum(c.x) AS sx, count(*) AS n FROM comp c JOIN a1 a USING (rid, part) GROUP BY ALL),
cb2 AS (SELECT b.part, b.entry, b.pos, coalesce(((u.sx - ((u.sx % u.n + u.n) % u.n)) // u.n)::BIGINT, b.x) AS x FROM cb1 b LEFT JOIN u1 u USING (part, entry, pos)),
d2 AS (SELECT c.rid, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS d FROM comp c JOIN cb2 b USING (part, pos) GROUP BY ALL),
a2 AS (SELECT rid, part, entry, d FROM d2 QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY d, entry) = 1),
rows AS (SELECT rid, string_agg(format('{:02x}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY rid),
books AS (SELECT sha256(coalesce(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos), '')) AS h FROM cb2)
SELECT k.vec_id, k.label, rows.code, rows.error, (sum(rows.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, books.h AS codebooks_sha256
FROM k JOIN rows USING (rid), books""",
    "op1_substring_dedup": rf"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i FROM win JOIN least USING (s) WHERE doc_id > m), range(0, 50) AS t(k)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
    "op4_quality_rules": rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, s FROM win GROUP BY doc_id, s HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i FROM win JOIN twice USING (doc_id, s)), range(0, 8) AS t(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
  coalesce(len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])), 0)::BIGINT AS n_stutter,
  length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g'))::BIGINT AS n_lower
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (100 * n_symbols > 20 * n_words)::BIGINT + 8 * (100 * n_stutter > 30 * n_words)::BIGINT
  + 16 * (100 * n_upper > 60 * (n_upper + n_lower))::BIGINT + 32 * (100 * n_dup_lines > 60 * n_lines)::BIGINT + 64 * (word_chars > 15 * n_words)::BIGINT + 128 * (2 * n_words > word_chars)::BIGINT AS fail_bits FROM m)
SELECT *, fail_bits & 3 <> 0 AS base_failed, fail_bits & 31 = 0 AS kept FROM b""",
    "op6_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, array_to_string(ws[i:i + 3], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 4)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') || ' ' FROM w WHERE len(ws) BETWEEN 1 AND 3)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT a AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(b) AS component_id FROM reach LEFT JOIN n ON n.doc_id = a GROUP BY a""",
}
