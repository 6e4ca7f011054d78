"""The keyword index of a collection: postings by term, and the statistics of each term."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from ..functions.text import keyword_tokens

if TYPE_CHECKING:
    from pyspark.sql import Column, DataFrame


def term_bucket(term: Column, buckets: int) -> Column:
    """By the first 32 bits of the term's md5."""
    return (F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def postings(rows: DataFrame, buckets: int, slices: int = 1) -> DataFrame:
    """Of rows (collection, id, content): collection, bucket, term, id, n (times in the row), length (terms of the row).

    Of several rows with one id the times are summed, and the length is the longest's.
    One shuffle: terms go to their bucket and, by their row's id, to a slice of it, and are counted there. So a term that
    all rows have is counted in `slices` tasks, and a bucket is written by as many.
    """
    tokens = rows.select("collection", "id", keyword_tokens(F.col("content")).alias("tokens"))
    terms = tokens.select("collection", "id", F.size("tokens").alias("size"), F.posexplode("tokens").alias("at", "term"))
    terms = terms.withColumn("bucket", term_bucket(F.col("term"), buckets)).withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)))
    dealt = terms.repartition(buckets * slices, "collection", "bucket", "slice")
    counted = dealt.groupBy("collection", "bucket", "slice", "term", "id").agg(F.count("*").alias("n"), F.max("size").cast("long").alias("length"))
    return counted.drop("slice").sortWithinPartitions("collection", "bucket", "term", "id")


def term_statistics(made: DataFrame) -> DataFrame:
    """Of postings: collection, bucket, term, n_rows that have the term, and n_all, its number in all of them."""
    by = made.groupBy("collection", "bucket", "term").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_all"))
    return by.repartition("collection", "bucket").sortWithinPartitions("collection", "bucket", "term")
