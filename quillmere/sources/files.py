"""Sources: pages of PDF files, images by path, query sets in JSON, and page tables made from stored documents."""

from __future__ import annotations

import io
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import functions as F

from ..functions.text import basename, clean

if TYPE_CHECKING:
    from collections.abc import Callable, Iterable

    from pyspark.sql import DataFrame, SparkSession

#: struct of what a page reader yields for each image it finds.
FOUND = "file_name string, page_num int, img_num int, xref int, y0 double, y1 double, page_height double, width int, height int, n_colors int, content binary"


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """The PDF files of a folder, without those of its subfolders: file_name, content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return files.select(basename(F.col("path")).alias("file_name"), "content")


def fitz_count(content: bytes) -> int:
    """The number of pages, by the optional PDF library."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        return doc.page_count


def fitz_pages(content: bytes, first: int = 1, last: int | None = None) -> Iterable[str]:
    """The text of each page of a range, by the optional PDF library."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        for page in doc.pages(first - 1, last or doc.page_count):
            yield page.get_text()


def fitz_images(content: bytes, first: int = 1, last: int | None = None, dpi: int = 150) -> Iterable[tuple]:
    """(page, image, xref, y0, y1, page height, width, height, colours, PNG) of each placed image; images that fail are left out."""
    import fitz
    from PIL import Image

    with fitz.open(stream=content, filetype="pdf") as doc:
        for p, page in enumerate(doc.pages(first - 1, last or doc.page_count), first):
            for n, found in enumerate(page.get_images(full=True), 1):
                try:
                    box = page.get_image_bbox(found)
                    png = page.get_pixmap(clip=box, matrix=fitz.Matrix(dpi / 72, dpi / 72)).tobytes("png")
                    picture = Image.open(io.BytesIO(png)).convert("RGB")
                    colors = picture.getcolors(1024)
                    yield p, n, found[0], box.y0, box.y1, page.rect.height, picture.width, picture.height, len(colors) if colors else 1025, png
                except Exception:  # noqa: BLE001,S112  a broken image is no reason to lose the file
                    continue


def store_and_name(path: str):
    """Arrow's file system of a path, and the path in it; a path without a scheme is one of the local disk."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def content_of(path: str) -> bytes:
    """The bytes of a file, for a task that is given its path."""
    at, name = store_and_name(path)
    with at.open_input_stream(name) as source:
        return source.read()


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that Spark takes it from, so that tasks write where Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def pdf_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The paths of the PDF files of a folder, without those of its subfolders; no content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path")


def pages(files: DataFrame, reader: Callable[[bytes], Iterable[str]] = fitz_pages) -> DataFrame:
    """One row per page, cleaned; pages without text stay."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["file_name"], batch["content"], strict=True):
                texts = list(reader(content))
                yield pd.DataFrame({"file_name": name, "page_num": range(1, len(texts) + 1), "text": texts})

    return files.mapInPandas(run, "file_name string, page_num int, text string").withColumn("text", clean(F.col("text")))


def images(files: DataFrame, reader: Callable[[bytes], Iterable[tuple]] = fitz_images) -> DataFrame:
    """One row per placed image of each file, with its PNG."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["file_name"], batch["content"], strict=True):
                rows = [(name, *r) for r in reader(content)]
                yield pd.DataFrame(rows, columns=["file_name", "page_num", "img_num", "xref", "y0", "y1", "page_height", "width", "height", "n_colors", "content"])

    return files.mapInPandas(run, FOUND)


def query_set(spark: SparkSession, path: str) -> DataFrame:
    """query_id, query of a JSON file {"queries": [{"id": ..., "query": ...}]}."""
    raw = spark.read.schema("queries array<struct<id:bigint,query:string>>").option("multiLine", True).json(path)
    return raw.select(F.explode("queries").alias("q")).select(F.col("q.id").alias("query_id"), F.col("q.query").alias("query"))


def plain_path(path: Column) -> Column:
    """A path without the scheme of the local file system."""
    return F.regexp_replace(path, "^file:/+", "/")


def image_bytes(spark: SparkSession, results: DataFrame, folder: str, limit: int = 3) -> DataFrame:
    """Per query the bytes of the first limit images by rank; missing files are left out and not replaced.

    image_path is a whole path, or one below folder. The folder is listed first, and only files that are asked for are
    read; up to LISTED of them by name, more by a join.
    """
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true")
    there = listing.load(folder).select(plain_path(F.col("path")).alias("__p"))
    whole = F.when(F.col("image_path").rlike("^(/|[a-z0-9]+:)"), F.col("image_path")).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), "image_path"))
    top = results.where(F.col("rank") <= limit).select("query_id", "rank", plain_path(whole).alias("__p"))
    some = [r[0] for r in top.select("__p").distinct().join(there, "__p").limit(LISTED + 1).collect()]
    read = spark.read.format("binaryFile").load(some) if 0 < len(some) <= LISTED else listing.load(folder).limit(0) if not some else listing.load(folder)
    stored = read.select(plain_path(F.col("path")).alias("__p"), "content")
    found = top.join(stored, "__p").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "content"))).alias("x"))
    return found.select("query_id", F.transform("x", lambda x: x["content"]).alias("images"))


#: Files that are named one by one when they are read.
LISTED = 10_000


def saved_images(images: DataFrame) -> DataFrame:
    """Writes the content of each row to its image_path, on any file system that Arrow knows; returns the rows written.

    Rows are written by the tasks that make them; a task that runs again writes the same bytes to the same path.
    """

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["image_path"], batch["content"], strict=True):
                at, name = store_and_name(path)
                at.create_dir(name.rsplit("/", 1)[0], recursive=True)
                with at.open_output_stream(name) as out:
                    out.write(content)
            yield batch

    return images.mapInPandas(run, images.schema)


def served_image(spark: SparkSession, folder: str, name: str) -> bytes | None:
    """The bytes of one image by its file name, or None."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", basename_only(name)).load(folder).select("content").limit(1).collect()
    return bytes(rows[0].content) if rows else None


def basename_only(name: str) -> str:
    return name.replace("\\", "/").rsplit("/", 1)[-1]


def document_pages(documents: DataFrame) -> DataFrame:
    """A page table over stored documents: the source as file, the id (from 1) as page."""
    return documents.select(F.col("source").alias("file_name"), (F.col("doc_id") + 1).cast("int").alias("page_num"), "doc_id", "text")
