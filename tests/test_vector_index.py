"""The inverted-file index against the whole scan: recall, pruning, exactness, and odd collections."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.operators import retrieval
from quillmere.operators import vector_index as V

SF = "/root/testdata/sf0.1"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v) for i, v in rows], "id long, embedding array<double>")


def clustered(n, dim, groups, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dim)) * 3
    return [(i, (centres[i % groups] + r.normal(size=dim)).tolist()) for i in range(n)]


def pairs(frame):
    return {(r.query_id, r.id, r.distance) for r in frame.collect()}


def test_recall_on_the_given_vectors(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = rows.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    for metric in ("cosine", "l2", "ip"):
        index = V.build(rows, str(tmp_path / metric), metric)
        assert index.lists.count() == rows.count()
        whole = {x[:2] for x in pairs(retrieval.knn(asked, rows, 10, metric))}
        found = {x[:2] for x in pairs(V.search(index, asked, 10))}
        recall = len(whole & found) / len(whole)
        print(metric, recall, index.probes, len(index.centroids()[0]))
        assert V.opened(spark, index.folder) == index
        assert recall >= 0.9


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_exact_search_equals_the_whole_scan(spark, tmp_path, metric):
    rows = clustered(1500, 6, 20) + [(5000, [0.0] * 6), (5001, [0.0] * 6), (5002, [1e-9] * 6)] + [(6000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(300)]
    table = vectors(spark, rows).repartition(4)
    asked = table.where("id % 100 = 0 or id > 5000 and id < 5003").withColumnRenamed("id", "query_id")
    index = V.build(table, str(tmp_path / "i"), metric, 30)
    for probes in (1, 3):
        assert pairs(V.search(index, asked, 7, probes, exact=True)) == pairs(retrieval.knn(asked, table, 7, metric))


def test_only_probed_lists_are_read(spark, tmp_path):
    table = vectors(spark, clustered(1000, 8, 25))
    index = V.build(table, str(tmp_path / "i"), "l2", 25)
    asked = table.where("id = 3").withColumnRenamed("id", "query_id")
    plan = V.search(index, asked, 5, 2)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*list#\d+ (IN|INSET)", plan)
    wanted = V.probed(np.array([asked.first().embedding]), index, 2)
    read = index.lists.where(F.col("list").isin([int(x) for x in wanted[0]]))
    assert read.select("list").distinct().count() == 2
    assert read.count() < 200


def test_odd_collections(spark, tmp_path):
    none = vectors(spark, [])
    asked = vectors(spark, [(1, [1.0, 0.0])]).withColumnRenamed("id", "query_id")
    index = V.build(none, str(tmp_path / "a"))
    assert V.search(index, asked, 3).count() == V.search(index, asked, 3, exact=True).count() == 0
    same = spark.createDataFrame([(1, [1.0, 0.0])] * 40 + [(None, [1.0, 1.0]), (2, None), (3, [0.0, 0.0])], "id long, embedding array<double>")
    index = V.build(same, str(tmp_path / "b"), "cosine", 5)
    assert index.lists.count() == 41
    found = V.search(index, asked, 45, exact=True).collect()
    assert sorted(r.id for r in found) == [1] * 40 + [3]
    assert V.search(index, asked.where("false"), 3).count() == 0
    again = V.build(same.where("id = 3"), str(tmp_path / "b"), "cosine")
    assert again.lists.count() == 1


def test_k_means_of_separate_groups():
    rows = np.array([v for _, v in clustered(600, 5, 6, seed=4)])
    centroids = V.k_means(rows, 6)
    _, far = V.placed(rows, centroids)
    assert len(centroids) == 6 and np.isfinite(centroids).all() and far.mean() < 4
    assert len(V.k_means(np.ones((10, 3)), 4)) == 1
