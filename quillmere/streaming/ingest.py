"""Ingestion of folders of PDF files with their images, and of new page files, each micro-batch once per id."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import clean, is_blank, word_sizes
from ..operators.chunking import chunks
from ..operators.images import first_per_file, image_path, kept, row_id
from ..providers import DEFAULT_DOMAIN, Embedder, Generator, described, embedding
from ..sources import files
from ..sources.page_units import page_units, unit_images, unit_pages

if TYPE_CHECKING:
    from pyspark.sql import DataFrame, SparkSession
    from pyspark.sql.streaming import StreamingQuery

    from ..operators.store import Store

PAGES = "file_name string, page_num int, text string"


def page_chunks(pages: DataFrame, semantic: bool = True, c: Config = Config(), tokens=word_sizes, model: Embedder | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of pages with ids `{file}_p{page}_c{index}`, and the columns to keep of their pages."""
    out = chunks(pages.withColumn("text", clean(F.col("text"))), semantic, c.chunking, tokens, model)
    name = F.concat("file_name", F.lit("_p"), F.col("page_num").cast("string"), F.lit("_c"), F.col("chunk_index").cast("string"))
    return out.select(name.alias("id"), "content", "file_name", "page_num", F.create_map().cast("map<string,string>").alias("metadata"), *keep)


def ingest(store: Store, pages: DataFrame, model: Embedder | None = None, semantic: bool = True, c: Config = Config(), tokens=word_sizes) -> None:
    """Chunks, embeds and stores pages; ids already stored are left as they are, so a repeated batch changes nothing."""
    with store.staged(page_chunks(pages, semantic, c, tokens, model)) as rows:
        store.add_text_chunks(rows, rows.select("id", embedding(F.col("content"), model).alias("embedding")))


def page_images(found: DataFrame, pages: DataFrame, folder: str, domain: str = DEFAULT_DOMAIN, model: Generator | None = None, c: Config = Config()) -> DataFrame:
    """Of placed images (with content) and pages: the rows of the image collection, described, and their content.

    Images are filtered first, so a model sees kept ones only; the first CONTEXT characters of the page are its context.
    """
    some = first_per_file(kept(found, c.images)).join(pages.select("file_name", "page_num", F.left("text", F.lit(CONTEXT)).alias("context")), ["file_name", "page_num"], "left")
    told = described(F.col("content"), F.coalesce("context", F.lit("")), domain, model)
    numbers = {"width": F.col("width"), "height": F.col("height"), "xref": F.col("xref"), "dpi": F.lit(c.images.dpi)}
    metadata = F.create_map(*(x for k, v in numbers.items() for x in (F.lit(k), v.cast("string"))))
    path = image_path(folder.rstrip("/"), F.col("file_name"), F.col("page_num"), F.col("img_num"))
    return some.select("file_name", "page_num", "img_num", path.alias("image_path"), metadata.alias("metadata"), told.alias("description"), "content")


#: Characters of a page that describe an image's surroundings.
CONTEXT = 500


def ingest_folder(
    spark: SparkSession, store: Store, folder: str, image_folder: str, model: Embedder | None = None, generator: Generator | None = None, domain: str = DEFAULT_DOMAIN, c: Config = Config(),
    page_reader=files.fitz_pages, image_reader=files.fitz_images, tokens=word_sizes, page_count=None,
) -> DataFrame:
    """Reads all PDF files of a folder: texts and images go to the store, images to image_folder. Returns the totals.

    With page_count (content to number of pages; given for the default readers), files are read by ranges of pages, by
    readers (content, first, last); without it, each file as a whole.
    """
    count = page_count or (files.fitz_count if page_reader is files.fitz_pages else None)
    if count is None:
        found = files.pdf_files(spark, folder)
        return _ingest(spark, store, files.pages(found, page_reader), files.images(found, image_reader), image_folder, model, generator, domain, c, tokens)
    with store.staged(page_units(files.pdf_paths(spark, folder), count)) as units:
        return _ingest(spark, store, unit_pages(units, page_reader), unit_images(units, image_reader), image_folder, model, generator, domain, c, tokens)


def _ingest(spark, store, pages, images, image_folder, model, generator, domain, c, tokens) -> DataFrame:
    """Stores pages and images. What a reader or a model has made is written before it is used twice."""
    folder = files.qualified(spark, image_folder)
    with store.staged(pages) as pages:
        ingest(store, pages, model, True, c, tokens)
        with store.staged(page_images(images, pages, folder, domain, generator, c)) as described_images, store.staged(files.saved_images(described_images).drop("content")) as pictures:
            rows = pictures.select("file_name", "page_num", "img_num", "image_path", "metadata", F.col("description").alias("content"))
            name = row_id(F.col("file_name"), F.col("page_num"), F.col("img_num"))
            store.add_images(rows, rows.select(name.alias("id"), embedding(F.col("content"), model).alias("embedding")))
            return spark.createDataFrame(totals(pages, rows).collect(), TOTALS)


def watch_folder(
    spark: SparkSession, store: Store, folder: str, image_folder: str, checkpoint: str, page_count=files.fitz_count, page_reader=files.fitz_pages, image_reader=files.fitz_images,
    model: Embedder | None = None, generator: Generator | None = None, domain: str = DEFAULT_DOMAIN, c: Config = Config(), tokens=word_sizes,
) -> StreamingQuery:
    """As ingest_folder, for the files that the checkpoint has not seen; ends when those present at its start are read."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    paths = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.pdf").load(folder).select("path")

    def batch(rows: DataFrame, _: int) -> None:
        with store.staged(page_units(rows, page_count)) as units:
            _ingest(rows.sparkSession, store, unit_pages(units, page_reader), unit_images(units, image_reader), image_folder, model, generator, domain, c, tokens)

    return paths.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


TOTALS = "n_pages long, n_files long, n_empty long, n_images long"


def totals(pages: DataFrame, images: DataFrame) -> DataFrame:
    """One row: pages, files, pages without text, and kept images."""
    counted = pages.agg(F.count("*").alias("n_pages"), F.countDistinct("file_name").alias("n_files"), F.count(F.when(is_blank(F.col("text")), 1)).alias("n_empty"))
    return counted.join(images.agg(F.count("*").alias("n_images")), F.lit(True))


def stream(spark: SparkSession, folder: str, store: Store, checkpoint: str, model: Embedder | None = None) -> StreamingQuery:
    """Watches a folder of page tables in Parquet."""
    pages = spark.readStream.schema(PAGES).parquet(folder)
    return pages.writeStream.foreachBatch(lambda batch, _: ingest(store, batch, model)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
