"""Collections as Parquet folders: append what is new, count, clear, and check."""

from __future__ import annotations

import contextlib
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import keyword_tokens
from .images import row_id

KEY, NUMBER, TEXT = (T.StructField(n, t()) for n, t in (("id", T.StringType), ("page_num", T.IntegerType), ("content", T.StringType)))
#: The keyword tokens of the content, made when it is stored, so that no search makes them again.
TOKENS = T.StructField("tokens", T.ArrayType(T.StringType()))
SCHEMAS = {
    "text_chunks": T.StructType([KEY, TEXT, T.StructField("file_name", T.StringType()), NUMBER, T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("embedding", T.ArrayType(T.DoubleType())), TOKENS]),
    "image_descriptions": T.StructType([KEY, TEXT, T.StructField("file_name", T.StringType()), NUMBER, T.StructField("img_num", T.IntegerType()), T.StructField("image_path", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("embedding", T.ArrayType(T.DoubleType())), TOKENS]),
}


def stored_schema(name: str) -> T.StructType:
    return T.StructType([*SCHEMAS[name].fields, T.StructField("bucket", T.IntegerType())])


def new_rows(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose id is not stored yet; of equal new ids the first by the other columns that have an order."""
    others = [f.name for f in rows.schema if f.name != "id" and isinstance(f.dataType, T.AtomicType)]
    order = Window.partitionBy("id").orderBy(*others) if others else Window.partitionBy("id").orderBy("id")
    first = rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    return first.join(stored.select("id"), "id", "left_anti")


#: Buckets of a new store: as many tasks write one collection at once.
BUCKETS = 16


def bucket_of(name: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")


class Store:
    """Two collections under one folder; metric and buckets are fixed when the store is made, and kept beside the data.

    A collection is partitioned by a hash bucket of its ids. An addition reads the stored ids of the buckets that it touches,
    and no others. Spark's committer shows the files of an addition when all are written; should it fail in between, the
    same addition made again adds what is missing, as known ids are left as they are. One writer at a time: two that add the
    same new id at the same moment would both store it.
    """

    def __init__(self, spark: SparkSession, folder: str, metric: str | None = None, buckets: int | None = None):
        if metric not in (None, "cosine", "l2", "ip"):
            raise ValueError(f"unknown metric {metric}")
        self.spark, self.folder = spark, folder.rstrip("/")
        kind = "metric string, buckets int"
        if not self._exists("settings"):
            spark.createDataFrame([(metric or "cosine", buckets or BUCKETS)], kind).coalesce(1).write.parquet(f"{self.folder}/settings")
        row = spark.read.schema(kind).parquet(f"{self.folder}/settings").first()
        self.metric, self.buckets = row.metric, row.buckets
        if buckets not in (None, self.buckets):
            raise ValueError(f"the store was made with {self.buckets} buckets, not {buckets}")
        if metric not in (None, self.metric):
            raise ValueError(f"the store was made for {self.metric}, not {metric}")
        for name in SCHEMAS:
            if not self._exists(name):
                self.clear(name)

    @staticmethod
    def exists(spark: SparkSession, folder: str, name: str = "settings") -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    def _exists(self, name: str) -> bool:
        return self.exists(self.spark, self.folder, name)

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A collection, or the rows of some of its buckets."""
        rows = self.spark.read.schema(stored_schema(name)).parquet(f"{self.folder}/{name}")
        return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).drop("bucket")

    def clear(self, *names: str) -> None:
        """Empties these collections, or all."""
        for name in names or SCHEMAS:
            empty = self.spark.createDataFrame([], stored_schema(name)).write.mode("overwrite").option("partitionOverwriteMode", "static")
            empty.partitionBy("bucket").parquet(f"{self.folder}/{name}")

    def _add(self, name: str, rows: DataFrame, vectors: DataFrame) -> None:
        rows = rows.withColumn("tokens", keyword_tokens(F.col("content")))
        joined = rows.withColumn("__row", F.lit(1)).join(vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding")), "id", "full")
        columns = [joined[f.name].cast(f.dataType).alias(f.name) if f.name in joined.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]]
        # written once, so that no model runs again for the checks
        with self.staged(joined.select(*columns, "__row")) as made:
            both = made.agg(F.count("__row").alias("rows"), F.count("embedding").alias("vectors"), F.count("*").alias("n")).first()
            if both.rows and both.vectors and not both.rows == both.vectors == both.n:
                raise ValueError("rows and embeddings differ in number or ids")
            if both.rows and both.vectors:
                placed = made.drop("__row").withColumn("bucket", bucket_of(F.col("id"), self.buckets))
                touched = [r.bucket for r in placed.select("bucket").distinct().collect()]
                new_rows(placed, self.read(name, touched)).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.folder}/{name}")

    @contextlib.contextmanager
    def staged(self, frame: DataFrame):
        """A frame, written below the store's folder and read again, until the block ends; what made it runs once."""
        path = f"{self.folder}/_staged/{uuid.uuid4().hex}"
        try:
            frame.write.parquet(path)
            yield self.spark.read.schema(frame.schema).parquet(path)
        finally:
            self._remove(path)

    def _remove(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def add_text_chunks(self, chunks: DataFrame, vectors: DataFrame) -> None:
        """chunks: id, content, file_name, page_num, metadata; vectors: id, embedding. Known ids are left as they are."""
        self._add("text_chunks", with_metadata(chunks, ["file_name", "page_num"]), vectors)

    def add_images(self, images: DataFrame, vectors: DataFrame) -> None:
        """images: file_name, page_num, img_num, content (the description), image_path, metadata; ids follow from these."""
        named = images.withColumn("id", row_id(F.col("file_name"), F.col("page_num"), F.col("img_num")))
        self._add("image_descriptions", with_metadata(named, ["file_name", "page_num", "img_num", "image_path"]), vectors)

    def counts(self) -> DataFrame:
        return collection_counts({n: self.read(n) for n in SCHEMAS})

    def require_content(self) -> None:
        """Raises ValueError where both collections are empty."""
        if all(self.read(n).isEmpty() for n in SCHEMAS):
            raise ValueError("the store holds neither texts nor images; ingest documents first")


def collection_counts(collections: dict[str, DataFrame]) -> DataFrame:
    """Per collection its name and number of rows."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("collection"), "n") for name, df in collections.items()]
    return reduce(DataFrame.unionByName, parts)


def flattened(fixed: dict, metadata):
    """The fixed fields as strings, overridden by metadata of the same name."""
    given = F.coalesce(metadata, F.create_map().cast("map<string,string>"))
    own = F.create_map(*(x for k, v in fixed.items() for x in (F.lit(k), v.cast("string")))).cast("map<string,string>")
    return F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(given, k)), given)


def with_metadata(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows whose metadata holds these columns too, as far as they are there."""
    given = F.col("metadata") if "metadata" in rows.columns else F.lit(None).cast("map<string,string>")
    return rows.withColumn("metadata", flattened({n: F.col(n) for n in names if n in rows.columns}, given))
