"""The corpus pipeline: toxicity, exact and near duplicates, mixing, and encoding, each stage on all that the last one kept.

Every stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; the last returns the piece ids of each row of the mix.
Each stage handles nulls, empty and very long texts, ties, repeated rows, empty tables and further columns as its operator
states. For the near-duplicate stage a document is a doc_id with its text: repeats of one row stay or go together, and of
linked documents the one with the smallest doc_id stays, a null one being the largest; of equal ids, the smallest hash of
the text. An empty table stays empty in all stages.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from quillmere.llm import dedup, mixing, pieces, setjoin, toxicity
from quillmere.llm.common import lasting, scratch, written

if TYPE_CHECKING:
    from pyspark.sql import DataFrame, SparkSession

#: Up to this many dropped documents (16 bytes each) are broadcast; beyond, the anti-join shuffles.
BROADCAST_IDS = 500_000
#: Near copies share 80 of 100 of their five-word shingles or more; op3's own query has other defaults.
WIDTH, NUM, DEN = 5, 80, 100


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier predicts toxic go."""
    score = toxicity.score_of(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(score < toxicity.THRESHOLD)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles (a Jaccard similarity of 0.8 or more), the one with the smallest doc_id stays."""
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"))
    classes = setjoin.classes(docs.select(key.alias("doc_id"), "text"), width=WIDTH, num=NUM, den=DEN)
    away = written(classes.where("doc_id <> component_id").select("doc_id.id", "doc_id.th").distinct())
    small = away.count() <= BROADCAST_IDS
    gone = docs["doc_id"].eqNullSafe(away["id"]) & (F.xxhash64(docs["text"]) == away["th"])
    return docs.join(F.broadcast(away) if small else away, gone, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.emitted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: doc_id, source, n_pieces and the piece ids of its text."""
    rows = pieces.Encoder().encoded(docs.select("doc_id", "source", "text"))
    return rows.select("doc_id", "source", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode),
]

#: SQL can express neither the classifier nor the encoding; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents. What a stage wrote for itself goes once its result is written; that goes after the next."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        with scratch(spark):
            docs, path = lasting(stage(spark, docs, sf_dir), path, outlives=True)
    return docs
