"""Queries over vectors, keywords, fused search, images and stores."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from ..functions.text import wants_image
from ..functions.vectors import cosine
from ..operators import images as I
from ..operators import retrieval as R
from ..operators import vector_index as V
from ..operators.prompts import search_report as report
from ..operators.store import collection_counts as counts_of
from ..operators.store import new_rows
from ..session import new_folder, table
from .fragments import IMAGES_SQL, TEXTS_SQL, asked, gated_sql, hybrid_sql, images, texts

if TYPE_CHECKING:
    from pyspark.sql import DataFrame, SparkSession


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 50."""
    return vectors(spark, d).where("id % 50 = 0").withColumnRenamed("id", "query_id")


def _knn(spark: SparkSession, d: str, metric: str, k: int = 10) -> DataFrame:
    return R.knn(vector_queries(spark, d), vectors(spark, d), k, metric).select("query_id", "id", "distance", F.col("rank").cast("long"))


def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, "cosine")


def knn_l2(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, "l2")


def knn_ip(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, "ip")


def _indexed(spark: SparkSession, d: str, metric: str, exact: bool) -> DataFrame:
    """The same searches by an inverted-file index, which is built anew."""
    index = V.build(vectors(spark, d), new_folder(spark, "index"), metric)
    return V.search(index, vector_queries(spark, d), 10, exact=exact).select("query_id", "id", "distance", F.col("rank").cast("long"))


def ann_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _indexed(spark, d, "cosine", False)


def ann_l2(spark: SparkSession, d: str) -> DataFrame:
    return _indexed(spark, d, "l2", False)


def index_knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _indexed(spark, d, "cosine", True)


def index_knn_l2(spark: SparkSession, d: str) -> DataFrame:
    return _indexed(spark, d, "l2", True)


def image_knn(spark: SparkSession, d: str) -> DataFrame:
    return R.knn(asked(spark, d), images(spark, d), 5).select("query_id", "id", "distance", F.col("rank").cast("long"))


def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    a = vectors(spark, d)
    b = a.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("other"))
    return a.join(b, "id").select("id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return R.candidates(asked(spark, d), texts(spark, d), 40)


def bm25_candidates(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25(_candidates(spark, d)).select("query_id", "id", F.round("bm25", 6).alias("bm25"))


def minmax_semantic(spark: SparkSession, d: str) -> DataFrame:
    return R.semantic_scores(R.knn(asked(spark, d), texts(spark, d), 40)).select("query_id", "id", "semantic_score")


def hybrid_rerank(spark: SparkSession, d: str) -> DataFrame:
    return R.reranked(_candidates(spark, d)).select("query_id", "id", "score", "semantic_score", "keyword_score", F.col("rank").cast("long"))


def text_results(spark: SparkSession, d: str) -> DataFrame:
    return R.hybrid_search(asked(spark, d), texts(spark, d))


def image_results(spark: SparkSession, d: str) -> DataFrame:
    return R.hybrid_search(asked(spark, d), images(spark, d), 3)


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return text_results(spark, d).select("query_id", F.col("rank").cast("long"), "id", "score", "semantic_score", "keyword_score", "distance", "file_name", "page_num", F.md5("content").alias("content_md5"))


def image_score_gate(spark: SparkSession, d: str) -> DataFrame:
    return R.gated(image_results(spark, d)).select("query_id", F.col("rank").cast("long"), "id", "score")


def search_report(spark: SparkSession, d: str) -> DataFrame:
    return report(text_results(spark, d))


def query_intent(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", wants_image(F.concat("text", F.when(F.col("item_id") % 3 == 0, " See the Figure.").otherwise(""))).alias("wants_image"))


def placements(spark: SparkSession, d: str) -> DataFrame:
    """Image placements made of line items by arithmetic; they stand in for the images of real pages."""
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("manual "), F.col("l_suppkey").cast("string"), F.lit(".pdf")).alias("file_name"), F.col("l_linenumber").alias("page_num"), F.col("l_orderkey").alias("img_num"),
        F.col("l_partkey").alias("xref"), (F.col("l_tax") * 2500).alias("y0"), (F.col("l_tax") * 2500 + F.col("l_quantity") * 18).alias("y1"), F.lit(1000.0).alias("page_height"),
        (F.col("l_partkey") % 400).alias("width"), (F.col("l_orderkey") % 300 + 20).alias("height"), ((F.col("l_partkey") + F.col("l_linenumber")) % 5).alias("n_colors"),
    )


KEY = ("file_name", "page_num", "img_num", "xref")


def image_bounds_filter(spark: SparkSession, d: str) -> DataFrame:
    return placements(spark, d).where(I.within_bounds(F.col("y0"), F.col("y1"), F.col("page_height"))).select(*KEY)


def image_keep_filter(spark: SparkSession, d: str) -> DataFrame:
    return I.kept(placements(spark, d)).select(*KEY)


def image_colors(spark: SparkSession, d: str) -> DataFrame:
    """Line items stand in for runs of pixels: their part is the colour, and their supplier tells the image."""
    runs = table(spark, d, "lineitem").select((F.col("l_suppkey") % 40).alias("image"), (F.col("l_partkey") * 7 + F.col("l_linenumber") % 3).alias("color"))
    return I.color_counts(runs, ["image"]).select("image", F.col("n_colors").cast("long").alias("n_colors"))


def image_dedup(spark: SparkSession, d: str) -> DataFrame:
    return I.first_per_file(I.kept(placements(spark, d))).select(*KEY)


def image_row_ids(spark: SparkSession, d: str) -> DataFrame:
    return placements(spark, d).select(*KEY, I.row_id(F.col("file_name"), F.col("page_num"), F.col("img_num")).alias("id"))


def image_path(spark: SparkSession, d: str) -> DataFrame:
    return placements(spark, d).select(*KEY, I.image_path("images", F.col("file_name"), F.col("page_num"), F.col("img_num")).alias("image_path"))


def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return new_rows(rows, table(spark, d, "labels").select(F.col("doc_id").alias("id")))


def collection_counts(spark: SparkSession, d: str) -> DataFrame:
    return counts_of({"text_chunks": table(spark, d, "documents"), "image_descriptions": table(spark, d, "pages")})


QUERIES = {
    f.__name__: f
    for f in (knn_cosine, knn_l2, knn_ip, ann_cosine, ann_l2, index_knn_cosine, index_knn_l2, image_knn, cosine_pairs, bm25_candidates, minmax_semantic, hybrid_rerank, hybrid_search, image_score_gate, search_report, query_intent,
              image_bounds_filter, image_keep_filter, image_colors, image_dedup, image_row_ids, image_path, insert_ignore, collection_counts)
}


def knn_sql(distance: str) -> str:
    return f"""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT a.id AS query_id, b.id, round({distance}, 6) AS distance FROM e a CROSS JOIN e b WHERE a.id % 50 = 0)
SELECT query_id, id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d) WHERE rank <= 10"""


PLACED = """p AS (SELECT 'manual ' || l_suppkey || '.pdf' AS file_name, l_linenumber AS page_num, l_orderkey AS img_num, l_partkey AS xref, l_tax * 2500 AS y0, l_tax * 2500 + l_quantity * 18 AS y1,
  1000.0::DOUBLE AS page_height, l_partkey % 400 AS width, l_orderkey % 300 + 20 AS height, (l_partkey + l_linenumber) % 5 AS n_colors FROM lineitem),
b AS (SELECT * FROM p WHERE y0 > page_height * 0.1::DOUBLE AND y1 < page_height * (1 - 0.1::DOUBLE)),
k AS (SELECT * FROM b WHERE width >= 100 AND height >= 100 AND NOT n_colors <= 1)"""
WITH = f"WITH {hybrid_sql(TEXTS_SQL)}"
POINTS = lambda x: f"{x}::DECIMAL(18, 7)::DECIMAL(18, 3)::VARCHAR"
ORACLES = {
    "search_report": f"""WITH {hybrid_sql(TEXTS_SQL)}
SELECT query_id, rank, '[' || rank || '] Score: ' || {POINTS("score")} || ' (Semantic: ' || {POINTS("semantic_score")} || ', Keyword: ' || {POINTS("keyword_score")} || ')' || chr(10)
  || 'Source: ' || file_name || ', Page: ' || page_num || chr(10) || 'Content: ' || left(content, 200) || CASE WHEN length(content) > 200 THEN '...' ELSE '' END AS report
FROM hyb WHERE rank <= 10""",
    "knn_cosine": knn_sql("1 - list_cosine_similarity(a.v, b.v)"),
    "knn_l2": knn_sql("list_distance(a.v, b.v) * list_distance(a.v, b.v)"),
    "index_knn_cosine": knn_sql("1 - list_cosine_similarity(a.v, b.v)"),
    "index_knn_l2": knn_sql("list_distance(a.v, b.v) * list_distance(a.v, b.v)"),
    "knn_ip": knn_sql("1 - list_inner_product(a.v, b.v)"),
    "image_knn": f"WITH {hybrid_sql(IMAGES_SQL)} SELECT query_id, id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM dist) WHERE rank <= 5",
    "cosine_pairs": "SELECT a.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "bm25_candidates": f"{WITH} SELECT query_id, id, round(bm25, 6) AS bm25 FROM hyb",
    "minmax_semantic": f"{WITH} SELECT query_id, id, semantic_score FROM hyb",
    "hybrid_rerank": f"{WITH} SELECT query_id, id, score, semantic_score, keyword_score, rank::BIGINT AS rank FROM hyb",
    "hybrid_search": f"{WITH} SELECT query_id, rank::BIGINT AS rank, id, score, semantic_score, keyword_score, distance, file_name, page_num, md5(content) AS content_md5 FROM hyb WHERE rank <= 10",
    "image_score_gate": f"WITH {hybrid_sql(IMAGES_SQL, 'i_')}, {gated_sql()} SELECT query_id, rank::BIGINT AS rank, id, score FROM i_gate",
    "query_intent": """SELECT item_id, regexp_matches(lower(text || CASE WHEN item_id % 3 = 0 THEN ' See the Figure.' ELSE '' END), 'figure|diagram|image|screenshot|shown|picture') AS wants_image FROM benchmark""",
    "image_bounds_filter": f"WITH {PLACED} SELECT file_name, page_num, img_num, xref FROM b",
    "image_keep_filter": f"WITH {PLACED} SELECT file_name, page_num, img_num, xref FROM k",
    "image_colors": "SELECT l_suppkey % 40 AS image, least(count(DISTINCT l_partkey * 7 + l_linenumber % 3), 1025) AS n_colors FROM lineitem GROUP BY 1",
    "image_dedup": f"WITH {PLACED} SELECT file_name, page_num, img_num, xref FROM k QUALIFY row_number() OVER (PARTITION BY file_name, xref ORDER BY page_num, img_num) = 1",
    "image_row_ids": f"WITH {PLACED} SELECT file_name, page_num, img_num, xref, file_name || '_p' || page_num || '_i' || img_num AS id FROM p",
    "image_path": rf"WITH {PLACED} SELECT file_name, page_num, img_num, xref, 'images/' || regexp_replace(file_name, '[^a-zA-Z0-9_\-.]', '_', 'g') || '_p' || page_num || '_i' || img_num || '.png' AS image_path FROM p",
    "insert_ignore": "SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "collection_counts": "SELECT 'text_chunks' AS collection, count(*) AS n FROM documents UNION ALL SELECT 'image_descriptions', count(*) FROM pages",
}
