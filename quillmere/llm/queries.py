"""The registered queries of this folder, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from . import dedup, infill, language, lm, mixing, pieces, pii, quality, secret_scan, setjoin, toxicity, urls

if TYPE_CHECKING:
    from pyspark.sql import Column, DataFrame, SparkSession


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toxicity.scored(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rows.select("doc_id", (toxicity.fold(F.col("doc_id")) == toxicity.HELD_OUT).alias("held_out"), "score", "predicted")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines", "lost_words"
    )


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.classes(documents(spark, sf_dir).select("doc_id", "text"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(documents(spark, sf_dir).select("doc_id", "text"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoder = pieces.Encoder()
    rows = encoder.encoded(documents(spark, sf_dir).select("doc_id", "text"))
    spelt = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    back = encoder.decoded(F.col("ids")) == F.translate(F.coalesce("text", F.lit("")), pieces.MARK, " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), spelt.alias("ids_sha256"), back.alias("round_trip"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_classes(documents(spark, sf_dir).select("doc_id", "text"))


def span_text(spans) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def span_columns(spans, kinds: tuple[str, ...]) -> list[Column]:
    """The counts of the base kinds, the digest of their spans, all spans, and their number."""

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in kinds]
    base = span_text(F.filter(spans, lambda x: x["kind"].isin(*kinds)))
    return [*counts, F.sha2(base, 256).alias("base_sha256"), span_text(spans).alias("spans"), F.size(spans).cast("long").alias("n_spans")]


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", pii.found(F.col("text")).alias("found"))
    return rows.select("doc_id", *span_columns(F.col("found"), pii.BASE))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return urls.judged(pages).select("page_id", "host", "path", "rule", "verdict", "score")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", secret_scan.found(F.col("text")).alias("found"))
    return rows.select("doc_id", *span_columns(F.col("found"), secret_scan.BASE))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = language.identified(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    return rows.select("doc_id", (toxicity.fold(F.col("doc_id")) == toxicity.HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = infill.infilled(documents(spark, sf_dir).select("doc_id", "text"))
    back = F.sha2(infill.restored(F.col("output"), F.col("form")), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), back.alias("restored_sha256"))


WORD_SQL = r"'[^\x20\x09-\x0D]+'"
RE2_CLOSED = quality.CLOSED.replace("'", "''")

SQL_OP2 = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, {WORD_SQL}) AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {WORD_SQL})) AS lines FROM t),
win AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) > 2),
win2 AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS x FROM win),
rep AS (SELECT r, i FROM win2 QUALIFY count(*) OVER (PARTITION BY r, x) > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
l AS (SELECT r, unnest(lines) AS line FROM w),
j AS (SELECT r, line, len(regexp_extract_all(line, {WORD_SQL})) AS n, lower(line) AS low FROM l),
k AS (SELECT r, n,
  (length(regexp_replace(line, '[^{quality.SEPARATORS[1:]}+', '', 'g')) >= greatest(2, n / 10)
   OR regexp_matches(low, '{quality.MENU_LINE}'))
  OR (length(regexp_replace(line, '{quality.SYMBOLS}', '', 'g')) > n AND n > 2)
  OR regexp_matches(low, '{quality.BOILERPLATE}')
  OR NOT (regexp_matches(line, '{RE2_CLOSED}') OR regexp_matches(line, '{quality.SENTENCE_END}')) AS bad FROM j),
s AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE bad) AS n_failed_lines, coalesce(sum(n) FILTER (WHERE bad), 0)::BIGINT AS lost_words FROM k GROUP BY r),
b AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, ''))  AS word_chars,
  length(regexp_replace(text, '{quality.SYMBOLS}', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
  coalesce(s.n_lines, 0) AS n_lines, coalesce(s.n_failed_lines, 0) AS n_failed_lines, coalesce(s.lost_words, 0) AS lost_words
  FROM w LEFT JOIN cov USING (r) LEFT JOIN s USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_words <= 0.5 * n_words AS kept FROM b
"""

SQL_OP6 = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {WORD_SQL})), 0) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3 AS weight FROM s),
o AS (SELECT *, row_number() OVER o AS k,
  ((sum(source_size) OVER ())::BIGINT - coalesce((sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0))::DOUBLE
    / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level
  FROM w WINDOW o AS (ORDER BY 3 * source_size / weight, source COLLATE C NULLS LAST)),
f AS (SELECT level AS lvl FROM o WHERE level * weight <= 3 * source_size ORDER BY k LIMIT 1),
g AS (SELECT source, source_size, coalesce(least(lvl * weight, (3 * source_size)::DOUBLE), 0.0) AS target FROM o LEFT JOIN f ON true),
r AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 8))::BIGINT / 4294967296.0 AS u
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS taken FROM r
"""

SQL_OP7 = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text),
r AS (SELECT t.doc_id, g.keep_id, g.group_size, sha256(t.text) AS text_sha256,
  row_number() OVER (PARTITION BY t.text ORDER BY t.doc_id DESC NULLS LAST) AS k FROM t JOIN g USING (text))
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM r
"""

SQL_OP12 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || substr(h, 1, 8))::BIGINT AS h1,
  ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM o
"""

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_rules": op2_quality_rules,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_lm_scores": op4_lm_scores,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_mix_sources": op6_mix_sources,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_personal_data": op8_personal_data,
    "op9_url_filters": op9_url_filters,
    "op10_secret_scan": op10_secret_scan,
    "op11_language": op11_language,
    "op12_fill_in_middle": op12_fill_in_middle,
}
ORACLES = {"op2_quality_rules": SQL_OP2, "op6_mix_sources": SQL_OP6, "op7_exact_dedup": SQL_OP7, "op12_fill_in_middle": SQL_OP12}
