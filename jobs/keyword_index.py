"""Builds the keyword index of both collections: postings by term, and the statistics of each term.

Texts are those of the documents, images are the web pages' headlines. Postings say how often a term stands in a row of a
collection, and how many terms that row has; terms say in how many rows they stand. Both are partitioned by collection and
by a hash bucket of the term, so a search reads the buckets of its own terms. A bucket is dealt by its rows' ids to
`slices` tasks, or to as many more as keep a task's share of the texts at about `chars_per_task`, so that a task's memory
does not grow with the input; files are cut at `rows_per_file`.

A null or empty text has no postings; of several rows with one id the times are summed. Columns other than the ids, the
documents' text and the pages' html are not read.
A run replaces the whole index; with the same input it writes the same rows.

    python -m jobs.keyword_index --documents DOCUMENTS --pages PAGES --output INDEX --config jobs/keyword_index.toml
"""

from __future__ import annotations

import logging
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Observation
from pyspark.sql import functions as F

from quillmere.operators.postings import postings, term_statistics
from quillmere.session import session

from .settings import arguments, load

if TYPE_CHECKING:
    from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("keyword_index")


@dataclass(frozen=True)
class Settings:
    buckets: int = 32
    slices: int = 4
    rows_per_file: int = 5_000_000
    chars_per_task: int = 4_000_000


def rows_of(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """collection, id, content."""
    headline = F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)
    texts = documents.select(F.lit("text_chunks").alias("collection"), F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return texts.unionByName(pages.select(F.lit("image_descriptions").alias("collection"), F.col("page_id").alias("id"), headline.alias("content")))


def written(frame: DataFrame, path: str, s: Settings) -> int:
    """Replaces a table, partitioned by collection and bucket; the number of rows written."""
    seen = Observation()
    counted = frame.observe(seen, F.count(F.lit(1)).alias("rows"))
    writer = counted.write.mode("overwrite").option("partitionOverwriteMode", "static").option("maxRecordsPerFile", s.rows_per_file)
    writer.partitionBy("collection", "bucket").parquet(path)
    return seen.get["rows"]


def slices_of(rows: DataFrame, s: Settings) -> int:
    """Into how many slices a bucket is dealt."""
    chars = rows.agg(F.sum(F.length("content"))).first()[0] or 0
    return max(s.slices, -(-chars // (s.buckets * s.chars_per_task)))


def run(spark: SparkSession, documents: str, pages: str, output: str, settings: Settings = Settings()) -> DataFrame:
    """Builds the index; returns its postings with the number of rows that have each term."""
    rows = rows_of(spark.read.parquet(documents), spark.read.parquet(pages))
    slices = slices_of(rows, settings)
    n = written(postings(rows, settings.buckets, slices), f"{output}/postings", settings)
    made = spark.read.parquet(f"{output}/postings")
    m = written(term_statistics(made), f"{output}/terms", settings)
    log.info("read %s and %s; wrote %d postings in %d slices and %d terms to %s", documents, pages, n, slices, m, output)
    return made.join(spark.read.parquet(f"{output}/terms"), ["collection", "bucket", "term"])


def main() -> None:
    a = arguments(__doc__, "documents", "pages", "output")
    spark = session("keyword_index")
    try:
        run(spark, a.documents, a.pages, a.output, load(Settings, a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
