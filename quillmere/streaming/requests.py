"""Requests as a stream: new questions are answered from a store, and every request gets one response with its status.

A micro-batch takes each request id once (of repeats the first by its text) and leaves out ids that have a response. Blank
questions are rejected without a model's work; where the model fails, the response has the error; neither stops the stream.
Responses are partitioned by micro-batch, and a micro-batch that runs again replaces its own partition, so a restart after
a failure leaves one response for each request.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from ..functions.text import is_blank

if TYPE_CHECKING:
    from pyspark.sql import DataFrame, SparkSession
    from pyspark.sql.streaming import StreamingQuery

    from ..service import Engine

REQUESTS = "request_id string, query string"
RESPONSES = (
    "request_id string, query string, status string, answer string, error string, sources array<struct<isImage:boolean,position:int,documentName:string,pageNumber:int,"
    "relevance:double,excerpt:string,fullText:string,imagePath:string>>, batch bigint"
)
BLANK = "The query must not be blank"


def responses(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(RESPONSES).parquet(output)


def answer_batch(batch: DataFrame, batch_id: int, engine: Engine, output: str, **options) -> None:
    """Answers the requests of a micro-batch that have no response from another one."""
    spark = batch.sparkSession
    first = batch.where("request_id is not null").groupBy("request_id").agg(F.min("query").alias("query"))
    done = responses(spark, output).where(F.col("batch") != batch_id).select("request_id")
    with engine.store.staged(first.join(done, "request_id", "left_anti")) as new:
        blank = new.where(is_blank(F.col("query"))).withColumns({"status": F.lit("rejected"), "error": F.lit(BLANK)})
        asked = new.where(~is_blank(F.col("query"))).withColumnRenamed("request_id", "query_id")
        answered = engine.answers(asked, **options).withColumnRenamed("query_id", "request_id")
        answered = answered.withColumn("status", F.when(F.col("error").isNull(), "answered").otherwise("failed"))
        made = answered.unionByName(blank, allowMissingColumns=True).withColumn("batch", F.lit(batch_id).cast("bigint"))
        made.select("request_id", "query", "status", "answer", "error", "sources", "batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(output)


def answer_stream(spark: SparkSession, engine: Engine, source: str, output: str, checkpoint: str, **options) -> StreamingQuery:
    """Answers the requests of new JSON files below source; ends when those present at its start are answered."""
    spark.createDataFrame([], RESPONSES).write.mode("append").partitionBy("batch").parquet(output)
    new = spark.readStream.schema(REQUESTS).json(source)
    write = new.writeStream.foreachBatch(lambda batch, batch_id: answer_batch(batch, batch_id, engine, output, **options))
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
