"""Semantic chunks as contiguous ranges of sentences, found by one fold over each text's sentences.

The fold's state is the start of the open chunk and the ranges so far; sentences are sliced afterwards. With prefix sums
of tokens, the size of the open chunk and the overlap are differences, so no text is carried along. The token counter is
a function from an array of sentences to their sizes. Where the embedder fails on a text, its similarities are null, and
the text is cut by tokens alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Chunking
from ..functions.text import sentences, word_sizes
from ..providers import Embedder, neighbour_similarity, running


def chunk_ranges(sizes: Column, sums: Column, similar: Column | None, c: Chunking = Chunking()) -> Column:
    """array<struct<s,e>> of 1-based inclusive ranges; similar: of each sentence with the one before, or None."""
    n = F.size(sizes)
    upto = lambda i: F.element_at(sums, i)  # noqa: E731  tokens of the sentences before i

    def step(state: Column, i: Column) -> Column:
        used = upto(i) - upto(state["s"])
        split = used + F.element_at(sizes, i) > c.max_tokens
        if similar is not None:
            split = split | F.coalesce((used >= c.min_tokens) & (F.element_at(similar, i) < c.threshold), F.lit(False))
        fits = F.filter(F.sequence(state["s"], i), lambda j: upto(i) - upto(j) <= c.overlap)
        closed = F.struct(state["s"].alias("s"), (i - 1).alias("e"))
        opened = F.struct(F.get(fits, F.lit(0)).alias("s"), F.concat(state["r"], F.array(closed)).alias("r"))
        return F.when(split, opened).otherwise(state)

    begin = F.struct(F.lit(1).alias("s"), F.array().cast("array<struct<s:int,e:int>>").alias("r"))
    rest = F.when(n >= 2, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
    ended = F.aggregate(rest, begin, step, lambda state: F.concat(state["r"], F.array(F.struct(state["s"].alias("s"), n.alias("e")))))
    return F.when(n == 0, F.array().cast("array<struct<s:int,e:int>>")).otherwise(ended)


def ranged(docs: DataFrame, semantic: bool, c: Chunking = Chunking(), tokens: Callable[[Column], Column] = word_sizes, model: Embedder | None = None) -> DataFrame:
    """docs (with text) with sentences, sizes, sums and ranges."""
    out = docs.withColumn("sentences", sentences(F.coalesce("text", F.lit(""))))
    out = out.withColumn("sizes", tokens(F.col("sentences"))).withColumn("sums", running(F.col("sizes")))
    if semantic:
        out = out.withColumn("similar", neighbour_similarity(F.col("sentences"), model))
    return out.withColumn("ranges", chunk_ranges(F.col("sizes"), F.col("sums"), F.col("similar") if semantic else None, c))


def chunks(docs: DataFrame, semantic: bool = True, c: Chunking = Chunking(), tokens: Callable[[Column], Column] = word_sizes, model: Embedder | None = None) -> DataFrame:
    """One row per chunk: the columns of docs but text, chunk_index, s, e, n_tokens, content."""
    keep = [x for x in docs.columns if x != "text"]
    rows = ranged(docs, semantic, c, tokens, model).select(*keep, "sentences", "sums", F.posexplode_outer("ranges").alias("chunk_index", "range"))
    rows = rows.where("chunk_index is not null")  # an inner explode would push a test of the ranges below, and compute them twice
    s, e = F.col("range.s"), F.col("range.e")
    return rows.select(
        *keep, "chunk_index", s.alias("s"), e.alias("e"), (F.element_at("sums", e + 1) - F.element_at("sums", s)).alias("n_tokens"),
        F.array_join(F.slice("sentences", s, e - s + 1), " ").alias("content"),
    )


def overlaps(docs: DataFrame, c: Chunking = Chunking()) -> DataFrame:
    """Per chunk but the first: how many sentences and tokens it repeats of the one before."""
    keep = [x for x in docs.columns if x != "text"]
    pair = lambda i: F.struct(F.get("ranges", i)["s"].alias("s"), F.get("ranges", i - 1)["e"].alias("e"), i.alias("chunk_index"))
    more = F.when(F.size("ranges") > 1, F.transform(F.sequence(F.lit(1), F.size("ranges") - 1), pair))
    rows = ranged(docs, False, c).select(*keep, "sums", F.explode_outer(more).alias("x")).where("x is not null")
    s, e = F.col("x.s"), F.col("x.e")
    return rows.select(*keep, "x.chunk_index", (e - s + 1).alias("overlap_sentences"), (F.element_at("sums", e + 1) - F.element_at("sums", s)).alias("overlap_tokens"))
