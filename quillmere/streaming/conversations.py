"""Conversation logs as a stream: questions are paired with the answers that follow, in whatever order turns arrive.

A stream joined with itself: the user turn n of a conversation waits in the state for the assistant turn n + 1, and the
other way round; the state is dealt by conversation and turn, so a conversation of any length is no task's alone. With a
time column, turns wait for at most `late`: the watermark drops those whose other half did not come, and repeated turns
within that time count once. Without one, turns wait for ever, and a repeated turn makes its pair again.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import functions as F

if TYPE_CHECKING:
    from pyspark.sql import DataFrame, SparkSession
    from pyspark.sql.streaming import StreamingQuery

TURNS = "conv_id bigint, turn bigint, role string, text string, ts timestamp"
PAIRS = "conv_id bigint, turn bigint, question string, answer string"


def turn_pairs(turns: DataFrame, late: str = "1 day") -> DataFrame:
    """Of turns (conv_id, turn, role, text and perhaps ts): conv_id, turn, question, answer."""
    timed = "ts" in turns.columns
    if timed:
        turns = turns.withWatermark("ts", late).dropDuplicatesWithinWatermark(["conv_id", "turn"])
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), *([F.col("ts").alias("asked")] if timed else []))
    replied = turns.where("role = 'assistant'").select(
        F.col("conv_id").alias("__conv"), (F.col("turn") - 1).alias("__turn"), F.col("text").alias("answer"), *([F.col("ts").alias("replied")] if timed else [])
    )
    same = (F.col("conv_id") == F.col("__conv")) & (F.col("turn") == F.col("__turn"))
    if timed:
        same = same & F.expr(f"replied BETWEEN asked - INTERVAL {late} AND asked + INTERVAL {late}")
    return asked.join(replied, same).select("conv_id", "turn", "question", "answer")


def pair_stream(spark: SparkSession, source: str, output: str, checkpoint: str, schema: str = TURNS, late: str = "1 day") -> StreamingQuery:
    """Pairs the turns of new Parquet files below source; each pair is written to output once."""
    pairs = turn_pairs(spark.readStream.schema(schema).parquet(source), late)
    return pairs.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
