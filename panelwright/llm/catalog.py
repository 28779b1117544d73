"""One query for each text operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import decontamination, html_extract, line_dedup, lm_scoring, mixing, ngram_join, quality_rules, secret_scan, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


LINE_DEDUP_SQL = r"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
pages AS (SELECT source, coalesce(text, '') AS text, count(*) AS copies FROM documents GROUP BY ALL),
total AS (SELECT source, sum(copies) AS n FROM pages GROUP BY source),
line AS (SELECT source, copies, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM pages),
often AS (SELECT source, line, sum(copies) AS n FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY source, line HAVING count(*) >= 3),
bad AS (SELECT o.source, list(o.line) AS drops FROM often o JOIN total t ON o.source IS NOT DISTINCT FROM t.source WHERE CAST(o.n AS DOUBLE) > CAST(0.005 AS DOUBLE) * CAST(t.n AS DOUBLE) GROUP BY o.source),
k AS (SELECT d.doc_id, d.text, d.ls, b.drops, list_filter(d.ls, lambda x: NOT list_contains(b.drops, x)) AS kept FROM d LEFT JOIN bad b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id,
  CASE WHEN text IS NULL OR drops IS NULL THEN text ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text,
  CAST(CASE WHEN text IS NULL THEN 0 ELSE len(ls) END AS BIGINT) AS n_lines,
  CAST(CASE WHEN text IS NULL OR drops IS NULL THEN 0 ELSE len(ls) - len(kept) END AS BIGINT) AS n_dropped
FROM k
"""


@_query("op1_line_dedup", LINE_DEDUP_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return line_dedup.drop_boilerplate(docs, counts=True).select("doc_id", "text", "n_lines", "n_dropped")


MIXING_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    greatest(0.1::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE * coalesce((length(text) - length(translate(text, '#*$%&|<>', '')))::DOUBLE / nullif(length(text), 0), 0.0)) AS w,
    (('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u FROM documents),
k AS (SELECT doc_id, source, size, -ln(u) / w AS draw FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
p AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS w FROM s),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS r FROM p),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - (sum(cap) OVER (ORDER BY r, source ROWS UNBOUNDED PRECEDING) - cap)) / sum(w) OVER (ORDER BY r, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM c),
t AS (SELECT source, source_size, least(w * max(lev) OVER (), cap) AS target FROM l),
j AS (SELECT k.doc_id, k.source, k.size, t.source_size, t.target,
    CAST(coalesce(floor(t.target / nullif(t.source_size, 0)), 0) AS BIGINT) AS epochs,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.draw, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) AS upto
    FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, floor(target - epochs * source_size) - (upto - size))) AS BIGINT) AS taken
FROM j
"""


@_query("op2_mixing", MIXING_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_query("op3_quality_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = quality_rules.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@_query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.limit_table(token_counts.length_histogram(_read(spark, sf_dir, "documents")))


NGRAM_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM w),
size AS (SELECT doc_id, len(s) AS n FROM sets),
held AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM held x JOIN held y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM size UNION SELECT link.b, reach.r FROM reach JOIN link ON link.a = reach.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, min(r) AS component_id FROM reach JOIN size USING (doc_id) GROUP BY doc_id, n
"""


@_query("op10_ngram_join", NGRAM_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_read(spark, sf_dir, "documents"))


@_query("op4_secret_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_read(spark, sf_dir, "documents"))


@_query("op7_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


@_query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    chain, vocabulary = toxicity.fit(docs, _read(spark, sf_dir, "labels"), [("low_quality", F.col("quality") == 0), ("toxic", F.col("toxic") == 1)])
    return toxicity.score(docs, chain, vocabulary).withColumn("toxic", F.col("p_toxic") >= 0.5)


@_query("op5_lm_scoring")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return lm_scoring.score(docs, lm_scoring.fit(docs))


@_query("op6_html_extraction")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_read(spark, sf_dir, "pages"))


# Parts of operators that SQL can state although it cannot state the whole.


QUALITY_BASE_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, row_number() OVER () AS r FROM documents),
win AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) AS g FROM w),
often AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM win),
again AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS p FROM often WHERE k >= 2) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words, len(ws) < 50 OR 100 * coalesce(again.n, 0) > 50 * len(ws) AS base_failed
FROM w LEFT JOIN again ON again.r = w.r
"""


@_query("quality_base_counts", QUALITY_BASE_SQL)
def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = quality_rules.document_counts(_read(spark, sf_dir, "documents"))
    return counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality_rules.base_failed().alias("base_failed"))


SECRET_BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, CAST(len(list_filter(regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS BIGINT) AS n_access,
  CAST(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS BIGINT) AS n_hex
FROM d
"""


@_query("secret_base_counts", SECRET_BASE_SQL)
def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_read(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex")


LENGTH_LIMITS_SQL = """
WITH h AS (SELECT length(coalesce(text, '')) AS length, count(*) AS docs FROM documents GROUP BY 1),
s AS (SELECT length, docs, length * docs AS tokens, coalesce(sum(docs) OVER above, 0) AS docs_longer, coalesce(sum(length * docs) OVER above, 0) AS tokens_longer, sum(docs) OVER () AS total_docs, sum(length * docs) OVER () AS total_tokens FROM h WINDOW above AS (ORDER BY length DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT CAST(length AS BIGINT) AS length, CAST(docs AS BIGINT) AS docs, CAST(tokens AS BIGINT) AS tokens, CAST(docs_longer AS BIGINT) AS docs_longer, CAST(tokens_longer AS BIGINT) AS tokens_longer, CAST(total_docs AS BIGINT) AS total_docs, CAST(total_tokens AS BIGINT) AS total_tokens,
  CAST(total_tokens - tokens_longer + length * docs_longer AS BIGINT) AS truncated_tokens, CAST(total_docs - docs_longer AS DOUBLE) / CAST(total_docs AS DOUBLE) AS quantile FROM s
"""


@_query("limits_of_character_lengths", LENGTH_LIMITS_SQL)
def length_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit table of ``op9`` over lengths that SQL can take: characters."""
    lengths = _read(spark, sf_dir, "documents").groupBy(F.length(F.coalesce("text", F.lit(""))).cast("long").alias("length")).agg(F.count(F.lit(1)).alias("docs"))
    return token_counts.limit_table(lengths)
