"""Buckets of a store, and capped counts of colours."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillmere.config import Images
from quillmere.operators import images as I
from quillmere.operators import retrieval as R
from quillmere.operators.store import Store, bucket_of
from quillmere.providers import embedding


def chunks(spark, ids):
    return spark.createDataFrame([(f"c{i}", f"text {i}") for i in ids], "id string, content string")


def add(store, rows):
    store.add_text_chunks(rows, rows.select("id", embedding(F.col("content")).alias("embedding")))


def test_additions_touch_their_buckets_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=8)
    add(store, chunks(spark, range(200)))
    add(store, chunks(spark, range(100, 300)))
    add(store, chunks(spark, [*range(5), *range(5)]))
    rows = store.read("text_chunks")
    assert rows.count() == rows.select("id").distinct().count() == 300
    assert {p.name for p in (tmp_path / "s" / "text_chunks").glob("bucket=*")} == {f"bucket={k}" for k in range(8)}
    some = store.read("text_chunks", [3])
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ = 3", some._jdf.queryExecution().executedPlan().toString())
    assert some.count() == rows.where(bucket_of(F.col("id"), 8) == 3).count() > 0
    again = Store(spark, str(tmp_path / "s"))
    assert again.buckets == 8
    with pytest.raises(ValueError, match="8 buckets"):
        Store(spark, str(tmp_path / "s"), buckets=4)


def test_stored_tokens_serve_the_search(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    add(store, spark.createDataFrame([("a", "The red fox, part A320-200."), ("b", "red red bird"), ("c", ""), ("d", "a quiet fox")], "id string, content string"))
    stored = store.read("text_chunks")
    assert {r.id: r.tokens for r in stored.collect()} == {"a": ["the", "red", "fox", "part", "a320-200"], "b": ["red", "red", "bird"], "c": [], "d": ["quiet", "fox"]}
    pairs = spark.createDataFrame([(q, t, i) for q, t in ((1, "red fox"), (2, "A320-200 bird")) for i in "abcd"], "query_id int, query string, id string")
    found = pairs.join(stored, "id")
    by_tokens, by_text = (R.bm25(x) for x in (found, found.drop("tokens")))
    assert sorted(map(tuple, by_tokens.collect())) == sorted(map(tuple, by_text.collect()))
    plan = lambda frame: frame._jdf.queryExecution().optimizedPlan().toString()
    assert "lower(coalesce(content" in plan(by_text) and "lower(coalesce(content" not in plan(by_tokens)


def test_a_broken_addition_can_be_repeated(spark, tmp_path):
    store, rows = Store(spark, str(tmp_path / "s"), buckets=4), chunks(spark, range(40))
    broken = embedding(F.when(F.col("id") == "c7", F.raise_error("down")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="down"):
        store.add_text_chunks(rows, rows.select("id", broken.alias("embedding")))
    assert store.read("text_chunks").count() == 0 and not list((tmp_path / "s").glob("_staged/*"))
    add(store, rows.limit(20))
    add(store, rows)
    assert store.read("text_chunks").count() == 40
    store.clear("text_chunks")
    assert store.read("text_chunks").count() == 0


@pytest.mark.parametrize("held", [1, I.HELD])
def test_capped_colors(spark, monkeypatch, held):
    monkeypatch.setattr(I, "HELD", held)
    r = random.Random(4)
    rows = [("a", k) for k in range(1024)] * 2 + [("b", k) for k in range(1025)] * 2 + [("c", k) for k in range(3000)] + [("d", 5)] * 400 + [("e", None), (None, 1), (None, 2)]
    r.shuffle(rows)
    runs = spark.createDataFrame(rows, "image string, color long").repartition(4)
    found = {x.image: x.n_colors for x in I.color_counts(runs, ["image"]).collect()}
    assert found == {"a": 1024, "b": 1025, "c": 1025, "d": 1, None: 2}
    single = {x.image: x.s for x in I.color_counts(runs, ["image"]).select("image", I.single_color(F.col("n_colors")).alias("s")).collect()}
    assert single == {"a": False, "b": False, "c": False, "d": True, None: False}
    few = I.color_counts(runs.where("image = 'c'"), ["image"], c=Images(max_colors=10))
    assert few.first().n_colors == 11 and I.color_counts(runs.where("false"), ["image"]).count() == 0
