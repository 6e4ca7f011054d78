"""Exact vector search, BM25 within each query's candidates, fusion, and gating; all batched over query_id."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Retrieval
from ..functions.text import keyword_tokens
from ..session import new_folder

#: Queries up to this number are sent to every task; more are answered in blocks of about so many.
QUERY_BLOCK = 4096
#: Rows of the collection in a unit beside a block of queries, and distances that a task holds at once.
PART_ROWS, CELLS = 50_000, 4_000_000
K1, B, EPSILON = 1.5, 0.75, 0.25


def distances(queries: np.ndarray, batch: np.ndarray, metric: str) -> np.ndarray:
    """Of each query to each row, smaller being nearer: 1 - cosine, squared l2, or 1 - dot."""
    dot = queries @ batch.T
    if metric == "ip":
        return 1 - dot
    q, b = (queries**2).sum(axis=1)[:, None], (batch**2).sum(axis=1)[None, :]
    if metric == "l2":
        return np.maximum(q + b - 2 * dot, 0)
    size = np.sqrt(q * b)
    return 1 - np.divide(dot, size, out=np.zeros_like(dot), where=size > 0)


def nearest_rows(names: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of distances (queries x rows): the queries and rows of the k nearest of each, equal distances by name."""
    if d.shape[1] > k:
        bar = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        query, row = np.nonzero(d <= bar)
    else:
        query, row = (x.ravel() for x in np.indices(d.shape))
    by_name = np.empty(len(names), dtype=np.int64)
    by_name[np.argsort(names, kind="stable")] = np.arange(len(names))
    order = np.lexsort((by_name[row], d[query, row], query))
    query, row = query[order], row[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return query[place < k], row[place < k]


def nearest(ids: np.ndarray, matrix: np.ndarray, names: np.ndarray, rows: np.ndarray, k: int, metric: str) -> pd.DataFrame:
    """query_id, id, distance of the k nearest rows of each query; at most CELLS distances are held at once."""
    out, step = [], max(1, CELLS // max(1, len(names)))
    for at in range(0, len(ids), step):
        d = np.round(distances(matrix[at : at + step], rows, metric), 6) + 0.0
        query, row = nearest_rows(names, d, k)
        out.append(pd.DataFrame({"query_id": ids[at : at + step][query], "id": names[row], "distance": d[query, row]}))
    return pd.concat(out)


def knn(queries: DataFrame, collection: DataFrame, k: int, metric: str = "cosine", block: int = QUERY_BLOCK) -> DataFrame:
    """Of queries (query_id, embedding) and collection (id, embedding): query_id, id, distance, rank for the k nearest.

    Up to block queries are sent to all tasks, and the collection is not shuffled. More queries are cut into blocks, and
    the collection into parts of PART_ROWS; each pair of a block and a part is one unit, so what a task holds is bounded.
    Either way only the k nearest of a batch or unit go on. Distances are rounded to 6 places before ranking; equal ones
    rank by id.
    """
    collection, queries = collection.select("id", "embedding"), queries.select("query_id", "embedding")
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {collection.schema['id'].dataType.simpleString()}, distance double"
    few = queries.limit(block + 1).collect()

    def vectors(column: pd.Series) -> np.ndarray:
        return np.stack(column.to_numpy()).astype(float)

    if len(few) <= block:
        ids = np.array([r.query_id for r in few], dtype=object)
        matrix = np.array([r.embedding for r in few], dtype=float) if few else np.zeros((0, 1))

        def scan(batches):
            for batch in batches:
                if len(batch) and len(ids):
                    yield nearest(ids, matrix, batch["id"].to_numpy(), vectors(batch["embedding"]), k, metric)

        out = collection.mapInPandas(scan, kinds)
    else:
        blocks, parts = -(-queries.count() // block), max(1, -(-collection.count() // PART_ROWS))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = queries.withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("p", every(parts))
        right = collection.withColumn("p", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("b", every(blocks))

        def unit(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if not len(asked) or not len(rows):
                return pd.DataFrame({"query_id": [], "id": [], "distance": []})
            return nearest(asked["query_id"].to_numpy(), vectors(asked["embedding"]), rows["id"].to_numpy(), vectors(rows["embedding"]), k, metric)

        out = left.groupBy("b", "p").cogroup(right.groupBy("b", "p")).applyInPandas(unit, kinds)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def known(queries: DataFrame, block: int = QUERY_BLOCK) -> DataFrame:
    """Queries whose vectors are made once: up to block of them as a local table, more as a checkpoint."""
    spark, few = queries.sparkSession, queries.limit(block + 1).collect()
    if len(few) <= block:
        return spark.createDataFrame(few, queries.schema)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(new_folder(spark, "queries"))
    return queries.checkpoint()


def bm25(candidates: DataFrame, query_column: str = "query", text_column: str = "content") -> DataFrame:
    """Of candidates (query_id, id, query, content): query_id, id, bm25, with the statistics of each query's candidates.

    Terms in over half of the candidates have a negative weight, raised to EPSILON times the mean weight; repeated query
    terms count repeatedly; documents without tokens count in the averages; without any tokens scores are 0. Candidates with
    a column tokens, as a store has it, are not tokenised again.
    """
    tokens = F.col("tokens") if "tokens" in candidates.columns else keyword_tokens(F.col(text_column))
    base = candidates.select("query_id", "id", tokens.alias("tokens"), keyword_tokens(F.col(query_column)).alias("asked"))
    base = base.withColumn("length", F.size("tokens"))
    stats = base.groupBy("query_id").agg(F.count("*").alias("n"), F.avg("length").alias("average"))
    postings = base.select("query_id", "id", "length", F.explode("tokens").alias("token")).groupBy("query_id", "id", "length", "token").agg(F.count("*").alias("tf"))
    terms = postings.groupBy("query_id", "token").agg(F.count("*").alias("df")).join(stats, "query_id")
    terms = terms.withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = F.avg("idf").over(Window.partitionBy("query_id"))
    terms = terms.withColumn("mean", mean).withColumn("weight", F.when(F.col("idf") < 0, EPSILON * F.col("mean")).otherwise(F.col("idf")))
    asked = base.groupBy("query_id").agg(F.first("asked").alias("asked")).select("query_id", F.explode("asked").alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    used = terms.join(asked, ["query_id", "token"]).select("query_id", "token", "weight", "times", "average")
    hit = postings.join(used, ["query_id", "token"])
    part = F.col("times") * F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    scores = hit.groupBy("query_id", "id").agg(F.sum(part).alias("bm25"))
    return base.select("query_id", "id").join(scores, ["query_id", "id"], "left").select("query_id", "id", F.coalesce("bm25", F.lit(0.0)).alias("bm25"))


def keyword_scores(candidates: DataFrame) -> DataFrame:
    """bm25 over the best of the query, if that is positive."""
    best = F.max("bm25").over(Window.partitionBy("query_id"))
    return bm25(candidates).withColumn("keyword_score", F.round(F.col("bm25") / F.when(best > 0, best).otherwise(F.lit(1.0)), 6)).drop("bm25")


def semantic_scores(candidates: DataFrame) -> DataFrame:
    """1 for the nearest, 0 for the farthest; 1 for all where distances are equal."""
    w = Window.partitionBy("query_id")
    low, high = F.min("distance").over(w), F.max("distance").over(w)
    return candidates.withColumn("semantic_score", F.when(high > low, F.round(1 - (F.col("distance") - low) / (high - low), 6)).otherwise(F.lit(1.0)))


def reranked(candidates: DataFrame, weight: float = 0.7) -> DataFrame:
    """Candidates (query_id, id, query, distance, content) with the three scores and their new rank."""
    scored = semantic_scores(candidates).join(keyword_scores(candidates), ["query_id", "id"], "left")
    scored = scored.withColumn("keyword_score", F.coalesce("keyword_score", F.lit(0.0)))
    scored = scored.withColumn("score", F.round(weight * F.col("semantic_score") + (1 - weight) * F.col("keyword_score"), 7))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "distance", "id")))


def candidates(queries: DataFrame, collection: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """The k nearest of each query with its text and their contents and metadata.

    queries: query_id, query, embedding; collection: id, content, embedding and metadata.
    """
    near = knn(queries, collection, k, metric).drop("rank")
    few = queries.limit(QUERY_BLOCK + 1).count() <= QUERY_BLOCK
    near = near.join(queries.select("query_id", "query"), "query_id")
    return (F.broadcast(near) if few else near).join(collection.drop("embedding"), "id")


def hybrid_search(queries: DataFrame, collection: DataFrame, k: int | None = None, c: Retrieval = Retrieval()) -> DataFrame:
    """The k best of each query after vector search and reranking."""
    found = reranked(candidates(queries, collection, c.top_k_candidates, c.metric), c.semantic_weight)
    return found.where(F.col("rank") <= (c.top_k_final if k is None else k)).drop("tokens")


def gated(results: DataFrame, delta: float = 0.05) -> DataFrame:
    """Of scored results: those within delta of their query's best, ranked anew; a missing score is the lowest."""
    score = F.coalesce(F.col("score"), F.lit(float("-inf")))
    best = F.max(score).over(Window.partitionBy("query_id"))
    kept = results.withColumn("__best", best).where(score >= F.col("__best") - F.lit(delta)).drop("__best")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("score", F.lit(float("-inf")))), "rank")))
