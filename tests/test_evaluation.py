"""Judged evaluation: each prompt is sent once, and failures are rows' own."""

import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmere.functions.text import SLICE_ROWS, clean, sliced
from quillmere.operators import evaluation as E
from quillmere.plans.answer_queries import LengthJudge, triplets
from quillmere.providers import HashedEmbedder, embedding, neighbour_similarity

SF = "/root/testdata/sf0.001"


class Logged(LengthJudge):
    def __init__(self, folder):
        self.folder = folder

    def generate(self, prompt, *args, **options):
        open(f"{self.folder}/{prompt.split()[0]}{prompt.split()[3]}~{uuid.uuid4().hex}", "w").close()
        return super().generate(prompt, *args, **options)


def test_each_prompt_is_sent_once(spark, tmp_path):
    rows = triplets(spark, SF)
    n = rows.count()
    out = E.evaluated(rows, Logged(str(tmp_path))).collect()
    assert len(out) == n > 10
    calls = Counter(p.name.split("~")[0] for p in tmp_path.iterdir())
    assert set(calls.values()) == {n} and len(calls) == 3
    assert all(0 <= r.faithfulness_score <= 1 and 0 <= r.context_relevancy_score <= 1 for r in out)


class Few(HashedEmbedder):
    """Fails where it gets more texts at once than slices of a batch hold."""

    def embed(self, texts):
        if len(texts) > 2 * SLICE_ROWS:
            raise MemoryError(len(texts))
        return super().embed(texts)


def test_a_slice_of_a_batch_becomes_python_objects(spark):
    rows = spark.range(0, 6000, 1, 1).select("id", F.concat(F.lit("alpha beta "), "id").alias("text")).withColumn("text", F.when(F.col("id") % 7 > 0, F.col("text")))
    some = rows.withColumn("texts", F.when(F.col("id") % 5 > 0, F.array(F.lit("one"), F.lit("one two"))))
    out = some.select("id", "text", "texts", embedding(F.col("text"), Few()).alias("v"), E.embedded(F.col("texts"), Few()).alias("w"), neighbour_similarity(F.col("texts"), Few()).alias("s")).collect()
    whole = HashedEmbedder()
    assert len(out) == 6000
    for r in out:
        assert r.v == whole.embed([r.text])[0].tolist()
        assert r.w == whole.embed(r.texts or []).tolist()
        assert r.s == ([] if r.texts is None else pytest.approx([0.0, 0.707107]))


def test_slices_are_bounded_in_bytes(spark):
    import pyarrow as pa

    seen = []
    batch = pa.array(["x" * 100_000] * 50 + [None])
    assert sliced(batch, lambda rows: seen.append(len(rows)) or pa.array(rows, pa.string()), pa.string()) == batch
    assert sum(seen) == 51 and max(seen) <= 11 and len(sliced(batch[:0], lambda rows: 1 / 0, pa.string())) == 0
    texts = [None, "", "ﬁ" * 3000, "x\x01y"] * 500
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    assert [r.c for r in rows.select("i", clean(F.col("t")).alias("c")).orderBy("i").collect()] == [None, "", "fi" * 3000, "xy"] * 500
