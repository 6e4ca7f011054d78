"""Ingests new document files: pages are cleaned, cut into chunks, embedded, and each document is stored once.

A streaming job that ends when all files present at its start are read (availableNow). Its checkpoint names the files it
has read, so the next run takes new ones only. A document that is stored already is left as it is, whichever file it comes
in again; of one id twice in a micro-batch the row with the smallest text stays, then the smallest source. Rows without an
id are skipped and counted; a document without text has no chunks.

The output is partitioned by a hash bucket of the document's id and by micro-batch. A micro-batch reads the stored ids of
its own buckets only, from earlier micro-batches, and replaces its own partitions; so one that runs again after a failure
writes the same rows to the same place. A bucket's documents are dealt to `slices` tasks, so chunks are made and written in
more tasks than there are buckets.

    python -m jobs.ingest_documents --input DOCUMENTS --output CHUNKS --checkpoint FOLDER --config jobs/ingest_documents.toml
"""

from __future__ import annotations

import logging
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Observation
from pyspark.sql import functions as F

from quillmere.config import Chunking, Config
from quillmere.providers import embedding
from quillmere.session import session
from quillmere.streaming.ingest import page_chunks

from .settings import arguments, load

if TYPE_CHECKING:
    from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("ingest_documents")
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CHUNKS = "id string, doc_id bigint, file_name string, page_num int, content string, embedding array<double>, bucket int, batch bigint"


@dataclass(frozen=True)
class Settings:
    buckets: int = 16
    files_per_batch: int = 1000
    slices: int = 8
    semantic: bool = True
    max_tokens: int = 512
    min_tokens: int = 180
    threshold: float = 0.6
    overlap: int = 30

    @property
    def config(self) -> Config:
        return Config(chunking=Chunking(self.max_tokens, self.min_tokens, self.threshold, self.overlap))


def bucket(doc_id, buckets: int):
    return (F.conv(F.substring(F.md5(doc_id.cast("string")), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def distinct_documents(rows: DataFrame, buckets: int) -> DataFrame:
    """One row per id; of repeats the first by text, then by source. Repeats are dropped in each task before the shuffle."""
    first = rows.groupBy("doc_id").agg(F.min(F.struct("text", "source")).alias("row"))
    return first.select("doc_id", "row.text", "row.source", bucket(F.col("doc_id"), buckets).alias("bucket"))


def stored(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(CHUNKS).parquet(output)


def watched(path: str) -> str:
    """The path as a pattern that matches it alone; file streams take a single file only by a pattern."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def ingest_batch(batch: DataFrame, batch_id: int, output: str, s: Settings) -> None:
    spark, seen = batch.sparkSession, Observation()
    counted = batch.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("doc_id").isNull()).alias("unnamed"))
    documents = distinct_documents(counted.where("doc_id is not null").select("doc_id", "text", "source"), s.buckets)
    touched = [r.bucket for r in batch.where("doc_id is not null").select(bucket(F.col("doc_id"), s.buckets).alias("bucket")).distinct().collect()]
    known = stored(spark, output).where(F.col("bucket").isin(touched) & (F.col("batch") != batch_id)).select("doc_id", "bucket").distinct()
    new = documents.join(known, ["bucket", "doc_id"], "left_anti").repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(s.slices)))
    pages = new.select("doc_id", "bucket", F.coalesce("source", F.lit("")).alias("file_name"), (F.col("doc_id") + 1).cast("int").alias("page_num"), "text")
    chunks = page_chunks(pages, s.semantic, s.config, keep=("doc_id", "bucket"))
    rows = chunks.select("id", "doc_id", "file_name", "page_num", "content", embedding(F.col("content")).alias("embedding"), "bucket", F.lit(batch_id).cast("bigint").alias("batch"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(output)
    made = stored(spark, output).where(F.col("batch") == batch_id).agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents")).first()
    log.info("micro-batch %d: read %d rows, %d without an id; wrote %d chunks of %d documents to %s", batch_id, seen.get["rows"], seen.get["unnamed"], made.chunks, made.documents, output)


def run(spark: SparkSession, source: str, output: str, checkpoint: str, settings: Settings = Settings()) -> DataFrame:
    """Ingests what is new in source and waits for its end; returns the whole output."""
    spark.createDataFrame([], CHUNKS).write.mode("append").partitionBy("bucket", "batch").parquet(output)
    new = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", settings.files_per_batch).parquet(watched(source))
    write = new.writeStream.foreachBatch(lambda batch, batch_id: ingest_batch(batch, batch_id, output, settings))
    query = write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %s: %d rows in %d micro-batches", source, sum(p["numInputRows"] for p in query.recentProgress), sum(p["numInputRows"] > 0 for p in query.recentProgress))
    return stored(spark, output)


def main() -> None:
    a = arguments(__doc__, "input", "output", "checkpoint")
    spark = session("ingest_documents")
    try:
        run(spark, a.input, a.output, a.checkpoint, load(Settings, a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
