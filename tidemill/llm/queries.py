"""The registered queries of this subpackage, and their DuckDB SQL where SQL expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import exact_dedup, lm, mixing, near_dedup, packing, pii, quality_rank, quality_rules, toxicity, warc
from .common import table
from .training import remainder


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def op2_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality_rank.score(docs, quality_rank.train(docs, table(spark, sf_dir, "labels")))
    return out.select(F.col("id").alias("doc_id"), (remainder("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= quality_rank.THRESHOLD).cast("int").alias("predicted"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.groups(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), byte_bpe(), ids="crc32(ids)", remembered=160 << 20)
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("ids").alias("ids_crc32"), "sequence_id", "offset")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.verdicts(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.spans(table(spark, sf_dir, "documents"))
    counts = [pii.count_of("base", k).alias(f"n_{k}") for k in pii.KINDS]
    return out.select(F.col("id").alias("doc_id"), *counts, F.sha2(pii.written("base"), 256).alias("base_sha256"), pii.written("spans").alias("spans"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows, vocabulary = lm.encoded(docs, remainder("doc_id", 5) != 1)
    model = lm.grown(rows, vocabulary)
    return lm.scored(rows, model).select(F.col("id").alias("doc_id"), (remainder("id", 5) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model[1]).cast("long").alias("train_tokens"), "base_score", "score")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), remembered=48 << 20)
    return out.select(F.col("id").alias("doc_id"), (remainder("id", 3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.linked(table(spark, sf_dir, "documents"), n=2)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


QUERIES = {
    "op1_warc": op1_warc,
    "op2_quality_rank": op2_quality_rank,
    "op3_mixing": op3_mixing,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_packing": op5_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_pii": op7_pii,
    "op8_language_model": op8_language_model,
    "op9_toxicity": op9_toxicity,
    "op10_near_dedup": op10_near_dedup,
}

ORACLE_SQL = {
    "op1_warc": r"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to FROM f
""",
    "op3_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    (-ln((CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(text), '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE))
      / (1.0::DOUBLE / (1.0::DOUBLE + 50.0::DOUBLE * len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) / greatest(length(coalesce(text, '')), 1))) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, w * (SELECT level FROM l WHERE cap / w >= level ORDER BY cap / w, source NULLS LAST LIMIT 1)) AS target FROM l),
f AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
o AS (SELECT d.doc_id, d.size, f.source_size, f.target, f.whole, f.target - f.whole * f.source_size AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN before + size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o
""",
    "op6_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang IS NULL AS no_lang, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, no_lang, lang, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS l FROM d)),
g AS (SELECT r, i, [w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o] AS g, lead(w, 4) OVER o IS NOT NULL AS whole FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
again AS (SELECT r, i FROM g WHERE whole QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(5) x(k) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
p AS (SELECT r, length(t) AS a0, length(regexp_replace(t, '[a-z]+', '', 'g')) AS a1, length(regexp_replace(t, '[a-z\x20\x09-\x0D]+', '', 'g')) AS a2,
    length(regexp_replace(t, '[a-zA-Z\x20\x09-\x0D]+', '', 'g')) AS a3, length(regexp_replace(t, '[a-zA-Z\x20\x09-\x0D.,;:?!''"()-]+', '', 'g')) AS a4,
    length(regexp_replace(t, '[a-zA-Z0-9\x20\x09-\x0D.,;:?!''"()-]+', '', 'g')) AS a5, length(regexp_replace(t, '[a-zA-Z0-9\x20\x09-\x0D.,;:?!''"()-]+|[^\x00-\x7F]+', '', 'g')) AS a6 FROM d),
c AS (SELECT r, unnest([a0 - a1, a1 - a2, a2 - a3, a3 - a4, a4 - a5, a5 - a6, a6]) AS n, unnest(range(7)) AS k FROM p),
cs AS (SELECT no_lang, lang, k, sum(n) AS n FROM c JOIN d USING (r) GROUP BY 1, 2, 3),
cref AS (SELECT no_lang, lang, k, n / greatest(sum(n) OVER (PARTITION BY no_lang, lang), 1) AS q FROM cs),
cdist AS (SELECT r, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS x
  FROM (SELECT r, q, n / length(t) AS p FROM c JOIN d USING (r) JOIN cref USING (no_lang, lang, k) WHERE length(t) >= 200) GROUP BY r),
wc AS (SELECT no_lang, lang, lower(w) AS w, count(*) AS n, sum(count(*)) OVER (PARTITION BY no_lang, lang) AS total FROM w GROUP BY 1, 2, 3),
top AS (SELECT no_lang, lang, w, n / total AS q FROM wc WHERE total >= 1000 QUALIFY row_number() OVER (PARTITION BY no_lang, lang ORDER BY n DESC, w) <= 20),
many AS (SELECT r, no_lang, lang, count(*) AS n, sum(length(w)) AS chars FROM w GROUP BY 1, 2, 3),
f AS (SELECT r, lower(w) AS w, count(*) AS n FROM w GROUP BY 1, 2),
pq AS (SELECT r, top.w, coalesce(f.n, 0) AS n, many.n AS m, q FROM many JOIN top USING (no_lang, lang) LEFT JOIN f USING (r, w) WHERE many.n >= 50),
shares AS (SELECT r, n / m AS p, q FROM pq UNION ALL SELECT r, (any_value(m) - sum(n)) / any_value(m), 1 - sum(q) FROM pq GROUP BY r),
wdist AS (SELECT r, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS x FROM shares GROUP BY r),
m AS (SELECT doc_id, coalesce(many.n, 0) AS n_words, CAST(coalesce(many.chars, 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, cdist.x AS cx, wdist.x AS wx
  FROM d LEFT JOIN many USING (r) LEFT JOIN lines USING (r) LEFT JOIN covered USING (r) LEFT JOIN cdist USING (r) LEFT JOIN wdist USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(cx, 0) <= sqrt(0.10) AND coalesce(wx, 0) <= sqrt(0.17) AS kept, round(cx, 6) AS char_distance, round(wx, 6) AS word_distance FROM m
""",
    "op4_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t, length(coalesce(text, '')) AS cp FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY t ORDER BY cp DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY t ORDER BY cp DESC, doc_id) AS kept, sha256(t) AS text_sha256
FROM n
""",
    "op10_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE len(w) WHEN 0 THEN [] WHEN 1 THEN w ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, b FROM reached r JOIN ways ON r.other = a),
least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN n USING (doc_id)
""",
}
