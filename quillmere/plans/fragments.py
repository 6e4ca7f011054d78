"""SQL pieces that several oracles share, and the frames that several queries share."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from ..providers import embedding
from ..session import table
from ..sources.files import document_pages

if TYPE_CHECKING:
    from pyspark.sql import DataFrame, SparkSession


def tok(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+(?:[-/][a-z0-9]+)*'), lambda t: length(t) >= 2)"


def strip_sql(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def sentences_sql(text: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({text}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {strip_sql('x')}), lambda x: x <> '')"


def words_sql(text: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({text}, '\s+'), lambda w: w <> ''))"


BUCKET = "('0x' || substr(md5(t), 1, 8))::BIGINT % 64"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text collection: documents as pages, embedded."""
    rows = document_pages(table(spark, sf_dir, "documents"))
    return rows.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "file_name", "page_num", embedding(F.col("text")).alias("embedding"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image collection: web pages, each as a picture described by its headline."""
    title = F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)
    host = F.regexp_extract("url", "://([^/]*)", 1)
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), title.alias("content"), host.alias("file_name"), (F.col("page_id") + 1).cast("int").alias("page_num"), F.col("url").alias("image_path"))
    return rows.withColumn("embedding", embedding(F.col("content")))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return rows.withColumn("embedding", embedding(F.col("query")))


TEXTS_SQL = "SELECT doc_id AS id, text AS content, source AS file_name, (doc_id + 1)::INT AS page_num, NULL::VARCHAR AS image_path FROM documents"
IMAGES_SQL = "SELECT page_id AS id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS content, regexp_extract(url, '://([^/]*)', 1) AS file_name, (page_id + 1)::INT AS page_num, url AS image_path FROM pages"


def hybrid_sql(collection: str, p: str = "") -> str:
    """CTEs up to {p}hyb: all candidates of each query with scores and rank."""
    return f"""
{p}q AS (SELECT item_id AS query_id, text AS query FROM benchmark),
{p}coll AS ({collection}),
{p}qt AS (SELECT query_id, unnest({tok("query")}) AS t FROM {p}q),
{p}ct AS (SELECT id, unnest({tok("content")}) AS t FROM {p}coll),
{p}qe AS (SELECT query_id, {BUCKET} AS b, count(*)::DOUBLE AS v FROM {p}qt GROUP BY ALL),
{p}ce AS (SELECT id, {BUCKET} AS b, count(*)::DOUBLE AS v FROM {p}ct GROUP BY ALL),
{p}qn AS (SELECT query_id, sum(v * v) AS n FROM {p}qe GROUP BY ALL),
{p}cn AS (SELECT id, sum(v * v) AS n FROM {p}ce GROUP BY ALL),
{p}dots AS (SELECT query_id, id, sum(x.v * y.v) AS d FROM {p}qe x JOIN {p}ce y USING (b) GROUP BY ALL),
{p}dist AS (SELECT q.query_id, c.id, round(1 - coalesce(d / sqrt(qn.n * cn.n), 0), 6) AS distance
  FROM {p}q q CROSS JOIN {p}coll c LEFT JOIN {p}dots USING (query_id, id) LEFT JOIN {p}qn qn USING (query_id) LEFT JOIN {p}cn cn USING (id)),
{p}cand AS (SELECT * FROM {p}dist QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 40),
{p}ctk AS (SELECT query_id, id, {tok("content")} AS toks FROM {p}cand JOIN {p}coll USING (id)),
{p}stats AS (SELECT query_id, count(*) AS n, avg(len(toks)) AS avgdl FROM {p}ctk GROUP BY ALL),
{p}post AS (SELECT query_id, id, len(toks) AS dl, unnest(toks) AS t FROM {p}ctk),
{p}tf AS (SELECT query_id, id, dl, t, count(*) AS tf FROM {p}post GROUP BY ALL),
{p}df AS (SELECT query_id, t, count(*) AS df FROM {p}tf GROUP BY ALL),
{p}idf AS (SELECT query_id, t, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM {p}df JOIN {p}stats USING (query_id)),
{p}w AS (SELECT query_id, t, avgdl, CASE WHEN idf < 0 THEN 0.25 * avg(idf) OVER (PARTITION BY query_id) ELSE idf END AS w FROM {p}idf),
{p}qc AS (SELECT query_id, t, count(*) AS times FROM {p}qt GROUP BY ALL),
{p}bm AS (SELECT tf.query_id, tf.id, sum(times * w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25
  FROM {p}tf tf JOIN {p}w USING (query_id, t) JOIN {p}qc USING (query_id, t) GROUP BY ALL),
{p}kw AS (SELECT query_id, id, distance, coalesce(bm25, 0.0) AS bm25 FROM {p}cand LEFT JOIN {p}bm USING (query_id, id)),
{p}sc AS (SELECT query_id, id, distance, bm25,
  round(bm25 / CASE WHEN max(bm25) OVER p > 0 THEN max(bm25) OVER p ELSE 1 END, 6) AS keyword_score,
  CASE WHEN max(distance) OVER p > min(distance) OVER p
    THEN round(1 - (distance - min(distance) OVER p) / (max(distance) OVER p - min(distance) OVER p), 6) ELSE 1.0::DOUBLE END AS semantic_score
  FROM {p}kw WINDOW p AS (PARTITION BY query_id)),
{p}ra AS (SELECT *, round(0.7::DOUBLE * semantic_score + (1 - 0.7::DOUBLE) * keyword_score, 7) AS score FROM {p}sc),
{p}hyb AS (SELECT r.*, c.content, c.file_name, c.page_num, c.image_path, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, distance, r.id)::INT AS rank
  FROM {p}ra r JOIN {p}coll c ON r.id = c.id)"""


def gated_sql(p: str = "i_") -> str:
    """After hybrid_sql of the images: the gated ones, ranked anew."""
    return f"""{p}top AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM {p}hyb WHERE rank <= 3),
{p}gate AS (SELECT * EXCLUDE (rank, best), row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank)::INT AS rank FROM {p}top WHERE score >= best - 0.05::DOUBLE)"""
