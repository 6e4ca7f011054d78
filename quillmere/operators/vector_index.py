"""An inverted-file index of vectors: lists around centroids, stored as partitions; a search reads the lists it probes.

Centroids come from k-means on a sample that is drawn by a hash of the ids, of at most ``SAMPLE_CELLS`` numbers, which the
driver holds. Every vector of the collection is stored, in the list of its nearest centroid; a list's rows are dealt to
several tasks by their ids, so a list that holds a third of all rows is written and read by many. Beside each centroid
stand the number of its vectors and its radius, the largest distance of one of them.

A search probes, for each query, the lists of the nearest centroids; by default as many as held ``RECALL`` of the ``K``
nearest vectors of those sampled vectors that were asked when the index was built. Only these partitions are read, and distances are
exact, by the metric of the index; the vectors are not shuffled. With exact, a second round reads the lists that may still
hold a nearer vector than the k-th found: by the triangle inequality those whose centroid is nearer than the k-th distance
plus the radius. Its result is that of a whole scan.

Distances for lists are Euclidean: of the vectors as they are for l2 and ip, and of unit vectors for cosine; for ip the
radius bounds the dot product. Cases: an empty collection has one empty list; without queries the result is empty; null ids
and null vectors are not indexed; equal distances rank by id; repeated rows are stored and found repeatedly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .retrieval import QUERY_BLOCK, distances, nearest_rows

#: Numbers in the sample that k-means sees, rows of it for each list, and lists at most.
SAMPLE_CELLS, ROWS_A_LIST, LISTS = 1 << 24, 64, 4096
ROUNDS, CELLS = 12, 1 << 22
#: Share of the K nearest that ASKED sampled vectors find among the sample, by which the number of probes is set.
RECALL, K, ASKED = 0.95, 10, 256
#: Rows of a list that one task writes.
LIST_ROWS = 100_000


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0)


def placed(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and the distance to it; at most CELLS distances are held at once."""
    at, far = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows))
    step = max(1, CELLS // len(centroids))
    for low in range(0, len(rows), step):
        d = squared(rows[low : low + step], centroids)
        best = d.argmin(axis=1)
        at[low : low + step], far[low : low + step] = best, np.sqrt(d[np.arange(len(d)), best])
    return at, far


def k_means(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of rows; the first k different rows are the first ones, and an empty one moves to the farthest row."""
    _, first = np.unique(rows, axis=0, return_index=True)
    centroids = rows[np.sort(first)[:k]]
    for _ in range(rounds):
        at, far = placed(rows, centroids)
        sizes = np.bincount(at, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, rows)
        centroids = sums / np.maximum(sizes, 1)[:, None]
        empty = np.flatnonzero(sizes == 0)
        centroids[empty] = rows[np.argsort(-far, kind="stable")[: len(empty)]]
    return centroids


def matrix(column: pd.Series, metric: str) -> np.ndarray:
    rows = np.stack(column.to_numpy()).astype(float)
    return unit(rows) if metric == "cosine" else rows


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


@dataclass(frozen=True)
class VectorIndex:
    """The folder of an index: `lists` (of this schema), partitioned by list, `centroids`, and `settings`."""

    spark: SparkSession
    folder: str
    metric: str
    schema: str
    probes: int

    @property
    def lists(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/lists")

    def centroids(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """list numbers, centroids and radii of the lists that hold vectors; bounded by LISTS."""
        rows = self.spark.read.parquet(f"{self.folder}/centroids").orderBy("list").toPandas()
        if not len(rows):
            return np.zeros(0, dtype=np.int64), np.zeros((0, 1)), np.zeros(0)
        return rows["list"].to_numpy(), np.stack(rows["centroid"].to_numpy()).astype(float), rows["radius"].to_numpy()


def opened(spark: SparkSession, folder: str) -> VectorIndex:
    """The index of a folder that `build` has written."""
    row = spark.read.parquet(f"{folder.rstrip('/')}/settings").first()
    return VectorIndex(spark, folder.rstrip("/"), row.metric, row.schema, row.probes)


def nearest_lists(queries: np.ndarray, centroids: np.ndarray, metric: str) -> np.ndarray:
    """Of each query (of unit vectors for cosine) the places of all centroids, the nearest first."""
    return np.argsort(-(queries @ centroids.T) if metric == "ip" else squared(queries, centroids), axis=1, kind="stable")


def needed_probes(rows: np.ndarray, centroids: np.ndarray, metric: str) -> int:
    """How many lists hold RECALL of the nearest other rows of the first rows."""
    at, _ = placed(rows, centroids)
    ranks, step = [], max(1, CELLS // len(rows))
    for low in range(0, min(ASKED, len(rows)), step):
        asked = rows[low : min(low + step, ASKED)]
        d = distances(asked, rows, metric)
        d[np.arange(len(asked)), low + np.arange(len(asked))] = np.inf
        near = np.argpartition(d, min(K, len(rows) - 1), axis=1)[:, :K]
        place = np.argsort(nearest_lists(asked, centroids, metric), axis=1)
        ranks.append(np.take_along_axis(place, at[near], axis=1).ravel())
    return int(np.quantile(np.concatenate(ranks), RECALL, method="higher")) + 1


def fitted(collection: DataFrame, metric: str, lists: int | None = None) -> tuple[np.ndarray, int]:
    """Centroids from a bounded sample, by default about as many as the square root of the number of vectors; and the probes."""
    n = collection.count()
    if not n:
        return np.zeros((1, 1)), 1
    dim = collection.select(F.max(F.size("embedding"))).first()[0]
    k = max(1, min(lists or round(n**0.5), LISTS))
    bar = int(min(1.0, min(ROWS_A_LIST * k, SAMPLE_CELLS // dim) / n) * (1 << 40))
    draw = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 40))
    sample = collection.select(draw.alias("h"), "id", "embedding").where(F.col("h") < max(bar, 1)).toPandas().sort_values(["h", "id"])
    if not len(sample):  # a draw from few rows
        sample = collection.orderBy("id").limit(1).toPandas()
    rows = matrix(sample["embedding"], metric)
    centroids = k_means(rows, k)
    return centroids, needed_probes(rows, centroids, metric)


def build(collection: DataFrame, folder: str, metric: str = "cosine", lists: int | None = None) -> VectorIndex:
    """Stores the vectors of collection (id, embedding) by list; a folder that holds an index is replaced."""
    spark, folder = collection.sparkSession, folder.rstrip("/")
    rows = collection.select("id", "embedding").where("id is not null and embedding is not null")
    centroids, probes = fitted(rows, metric, lists)
    kind = f"id {rows.schema['id'].dataType.simpleString()}, embedding array<double>, far double, list int"

    def place(batches):
        for batch in batches:
            if len(batch):
                at, far = placed(matrix(batch["embedding"], metric), centroids)
                yield batch.assign(far=far, list=at.astype(np.int32))

    made = rows.mapInPandas(place, kind)
    # rows of a list go to one of several slices; how many is known from the number of rows, not from the list's
    slices = max(1, -(-rows.count() // LIST_ROWS))
    dealt = made.repartition("list", F.pmod(F.xxhash64("id"), F.lit(min(slices, 64))))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "static").option("maxRecordsPerFile", LIST_ROWS).partitionBy("list").parquet(f"{folder}/lists")
    index = VectorIndex(spark, folder, metric, kind, probes)
    table = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "list int, centroid array<double>")
    sizes = index.lists.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    table.join(F.broadcast(sizes), "list").coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{folder}/centroids")
    settings = spark.createDataFrame([(metric, kind, probes)], "metric string, schema string, probes int")
    settings.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{folder}/settings")
    return index


def probed(queries: np.ndarray, index: VectorIndex, probes: int) -> list[np.ndarray]:
    """Of each query the numbers of its nearest lists."""
    names, centroids, _ = index.centroids()
    q = unit(queries) if index.metric == "cosine" else queries
    return [names[row] for row in nearest_lists(q, centroids, index.metric)[:, :probes]] if len(names) else [names] * len(q)


def possible(queries: np.ndarray, index: VectorIndex, worst: np.ndarray) -> list[np.ndarray]:
    """Of each query the lists that may hold a vector as near as its k-th so far (worst, in the metric's distance)."""
    names, centroids, radii = index.centroids()
    if not len(names):
        return [names] * len(queries)
    slack = 1e-5  # distances are rounded before they are compared
    if index.metric == "ip":  # q.x <= q.c + |q| r
        most = queries @ centroids.T + np.sqrt((queries * queries).sum(axis=1))[:, None] * radii[None, :]
        return [names[row] for row in 1 - most <= worst[:, None] + slack]
    q = unit(queries) if index.metric == "cosine" else queries
    # of unit vectors the squared distance is twice the cosine distance; with a zero vector it is less than that
    reach = np.sqrt((worst + slack) * (2 if index.metric == "cosine" else 1))
    near = np.sqrt(squared(q, centroids)) <= reach[:, None] + radii[None, :] + slack
    return [names[row] for row in near]


def scanned(index: VectorIndex, ids: np.ndarray, queries: np.ndarray, wanted: list[np.ndarray], k: int, kinds: str) -> DataFrame:
    """query_id, id, distance of the k nearest of each batch, in the lists wanted by each query; other partitions are not read."""
    asking: dict[int, list[int]] = {}
    for place, lists in enumerate(wanted):
        for name in lists.tolist():
            asking.setdefault(int(name), []).append(place)
    rows, metric = index.lists.where(F.col("list").isin(sorted(asking))), index.metric

    def scan(batches):
        for batch in batches:
            for name, part in batch.groupby("list"):
                places = np.array(asking[int(name)])
                names, vectors = part["id"].to_numpy(), np.stack(part["embedding"].to_numpy()).astype(float)
                step = max(1, CELLS // max(1, len(names)))
                for low in range(0, len(places), step):
                    some = places[low : low + step]
                    d = np.round(distances(queries[some], vectors, metric), 6) + 0.0
                    query, row = nearest_rows(names, d, k)
                    yield pd.DataFrame({"query_id": ids[some[query]], "id": names[row], "distance": d[query, row]})

    return rows.select("id", "embedding", "list").mapInPandas(scan, kinds)


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
    """query_id, id, distance, rank of the k nearest in the probed lists (with exact, of all) of up to QUERY_BLOCK queries.

    The queries are sent to all tasks; raises ValueError for more, which are to be asked in blocks.
    """
    rows = queries.select("query_id", "embedding").limit(QUERY_BLOCK + 1).collect()
    if len(rows) > QUERY_BLOCK:
        raise ValueError(f"more than {QUERY_BLOCK} queries; ask them in blocks, or search without an index")
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {index.lists.schema['id'].dataType.simpleString()}, distance double"
    if not rows:
        return index.spark.createDataFrame([], f"{kinds}, rank int")
    ids, asked = np.array([r.query_id for r in rows], dtype=object), np.array([r.embedding for r in rows], dtype=float)
    first = probed(asked, index, probes or index.probes)
    found = scanned(index, ids, asked, first, k, kinds)
    if exact:
        # k rows a query: bounded by QUERY_BLOCK times k, and read by both rounds
        best = ranked(found, k).toPandas()
        place = {name: at for at, name in enumerate(ids)}
        worst, held = np.full(len(ids), np.inf), best.groupby("query_id")["distance"].agg(["max", "size"])
        for name, row in held.iterrows():
            worst[place[name]] = row["max"] if row["size"] >= k else np.inf
        more = [np.setdiff1d(a, b) for a, b in zip(possible(asked, index, worst), first, strict=True)]
        found = index.spark.createDataFrame(best[["query_id", "id", "distance"]], kinds) if len(best) else found.limit(0)
        if any(len(m) for m in more):
            found = found.unionByName(scanned(index, ids, asked, more, k, kinds))
    return ranked(found, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
