"""Mixing sources to target weights.

Tokens are summed per source (map-side partial sums, so a hot source costs one row a task). The targets share the sum
of all sizes by weight; a target stops at ``max_rate`` times its source's size, and the excess is shared again by
weight among the rest. That fixed point has a closed form over the sources ordered by size / weight: the first source
whose share stays below its cap sets the level of all that come after it. Each document is then emitted floor(rate)
times plus one copy with a probability equal to the fraction, drawn from a hash of its id, so reruns agree.

Cases: a null text has size 0; null is a source of its own, last in order; a source of size 0 has target 0; all sizes
0: all targets 0; a null id is drawn as the empty string; repeated rows are drawn alike; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, written

#: Up to this many sources (a short name and a few numbers each) their table is broadcast; beyond, the join shuffles.
BROADCAST_SOURCES = 10_000
WEIGHTS = (1, 2, 3)


def targets(sized: DataFrame, weights=WEIGHTS, max_rate: int = 3) -> DataFrame:
    """Per source of sized (source, size): source, source_size, weight, target."""
    by = sized.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    at = F.row_number().over(named) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(at, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("weight", weight.cast("long"))
    order = Window.orderBy((max_rate * F.col("source_size")) / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    capped = F.coalesce(F.sum(max_rate * F.col("source_size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(every) - capped).cast("double") / rest
    by = by.withColumn("level", level).withColumn("at", F.row_number().over(order))
    free = F.col("level") * F.col("weight") <= F.col("source_size") * max_rate
    first = F.min(F.when(free, F.struct("at", "level"))).over(every)["level"]
    target = F.least(first * F.col("weight"), (F.col("source_size") * max_rate).cast("double"))
    return by.select("source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def draw(id_column: str = "doc_id", seed: str = "mix"):
    """A number in [0, 1) from the first 32 bits of a hash of the id."""
    key = F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit(":" + seed))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def taken(docs: DataFrame, weights=WEIGHTS, max_rate: int = 3, seed: str = "mix") -> DataFrame:
    """docs with __mix, a struct of size, source_size, target and copies; no other column is touched."""
    sized = docs.withColumn("__size", word_count(F.col("text")).cast("long"))
    by = targets(sized.select("source", F.col("__size").alias("size")), weights, max_rate)
    sources = written(by.select(F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target")))
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    out = sized.join(F.broadcast(sources) if few else sources, sized["source"].eqNullSafe(sources["__source"]), "left")
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(draw(seed=seed) < rate - F.floor(rate), 1).otherwise(0)
    mix = F.struct(F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), copies.cast("int").alias("copies"))
    return out.select(*docs.columns, mix.alias("__mix"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs with size, source_size, target and copies, which replace columns of these names."""
    rows = taken(docs, **options)
    for name in ("size", "source_size", "target", "copies"):
        rows = rows.withColumn(name, F.col(f"__mix.{name}"))
    return rows.drop("__mix")


def emitted(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs as they are."""
    rows = taken(docs, **options).where("__mix.copies > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__mix.copies")))).select(*docs.columns)
