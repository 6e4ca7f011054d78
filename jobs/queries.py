"""The jobs as queries: each runs twice into one new folder and returns the whole output after the second run."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from quillmere.plans.fragments import tok
from quillmere.plans.text_queries import chunk_sql
from quillmere.session import new_folder

from . import ingest_documents, keyword_index

if TYPE_CHECKING:
    from pyspark.sql import DataFrame, SparkSession


def job1_ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks, their vectors spelt as numbers with commas."""
    folder = new_folder(spark, "job1")
    for _ in range(2):
        out = ingest_documents.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/chunks", f"{folder}/checkpoint")
    spelt = F.array_join(F.transform("embedding", lambda x: x.cast("bigint").cast("string")), ",")
    return out.select("id", "doc_id", "file_name", "page_num", "content", spelt.alias("embedding"), "bucket")


def job2_keyword_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "job2")
    for _ in range(2):
        out = keyword_index.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/pages.parquet", f"{folder}/index")
    return out.select("collection", "bucket", "term", "id", "n", "length", "n_rows", "n_all")


BUCKET_OF = "(('0x' || substr(md5({}), 1, 8))::BIGINT % {})::INT"
PAGES = r"pg AS (SELECT * REPLACE (regexp_replace(text, '[\x00-\x08\x0B-\x1F\x7F\x{80}-\x{9F}]', '', 'g') AS text) FROM documents WHERE doc_id IS NOT NULL),"
SQL_JOB1 = f"""{chunk_sql(True).replace("FROM documents", "FROM pg").replace("WITH", "WITH " + PAGES, 1)},
o AS (SELECT doc_id, chunk_index, array_to_string(sents[x.s:x.e], ' ') AS content FROM u),
ot AS (SELECT doc_id, chunk_index, unnest({tok("content")}) AS t FROM o),
ob AS (SELECT doc_id, chunk_index, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS b, count(*) AS v FROM ot GROUP BY ALL),
om AS (SELECT doc_id, chunk_index, map_from_entries(list((b, v))) AS m FROM ob GROUP BY ALL)
SELECT coalesce(source, '') || '_p' || (o.doc_id + 1) || '_c' || o.chunk_index AS id, o.doc_id, coalesce(source, '') AS file_name, (o.doc_id + 1)::INT AS page_num, content,
  array_to_string(list_transform(range(0, 64), lambda b: coalesce(m[b], 0)), ',') AS embedding, {BUCKET_OF.format("o.doc_id::VARCHAR", 16)} AS bucket
FROM o JOIN documents d ON d.doc_id = o.doc_id LEFT JOIN om ON om.doc_id = o.doc_id AND om.chunk_index = o.chunk_index"""
SQL_JOB2 = f"""
WITH r AS (SELECT 'text_chunks' AS collection, doc_id AS id, text AS content FROM documents
  UNION ALL SELECT 'image_descriptions', page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) FROM pages),
k AS (SELECT collection, id, {tok("content")} AS tokens FROM r),
t AS (SELECT collection, id, len(tokens) AS size, unnest(tokens) AS term FROM k),
p AS (SELECT collection, term, id, count(*) AS n, max(size) AS length FROM t GROUP BY ALL)
SELECT collection, {BUCKET_OF.format("term", 32)} AS bucket, term, id, n, length, count(*) OVER w AS n_rows, (sum(n) OVER w)::BIGINT AS n_all
FROM p WINDOW w AS (PARTITION BY collection, term)"""

QUERIES = {"job1_ingest_documents": job1_ingest_documents, "job2_keyword_index": job2_keyword_index}
ORACLES = {"job1_ingest_documents": SQL_JOB1, "job2_keyword_index": SQL_JOB2}
