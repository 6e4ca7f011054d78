"""Files by ranges of pages: spread over tasks, equal to whole files, incremental, with stand-in readers."""

import pytest
from pyspark.sql import functions as F

from quillmere.operators.images import first_per_file, kept
from quillmere.operators.store import Store
from quillmere.sources import files
from quillmere.sources.page_units import page_units, unit_images, unit_pages
from quillmere.streaming.ingest import watch_folder

FEED = "\x0c"


def count(content):
    return len(content.decode().split(FEED)) if content else 0


def read(content, first, last):
    return content.decode().split(FEED)[first - 1 : last]


def images(content, first, last):
    """Each page shows an image of its own and one that all pages share."""
    for page in range(first, last + 1):
        for n, xref in ((1, 7), (2, 1000 + page)):
            yield page, n, xref, 20.0, 50.0, 100.0, 200, 200, 9, f"{xref}".encode()


def test_a_long_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "long.pdf").write_bytes(FEED.join(f"page {i}" for i in range(1, 5001)).encode())
    (tmp_path / "short.pdf").write_bytes(b"one\x0ctwo")
    (tmp_path / "empty.pdf").write_bytes(b"")
    paths = files.pdf_paths(spark, str(tmp_path))
    assert paths.count() == 2  # Spark lists no empty file
    units = page_units(paths, count)
    rows = [(files.basename_only(r.path), r.first, r.last) for r in units.collect()]
    assert len(rows) == 101 and ("short.pdf", 1, 2) in rows and ("long.pdf", 4951, 5000) in rows
    pages = unit_pages(units, read)
    assert {(r.file_name, r.page_num, r.text) for r in pages.collect()} == {("long.pdf", i, f"page {i}") for i in range(1, 5001)} | {("short.pdf", 1, "one"), ("short.pdf", 2, "two")}
    tasks = pages.where("file_name = 'long.pdf'").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 8 and max(t["count"] for t in tasks) < 1500
    found = first_per_file(kept(unit_images(units, images)))
    by_file = {r.file_name: (r.n, r.first) for r in found.groupBy("file_name").agg(F.count("*").alias("n"), F.min(F.when(F.col("xref") == 7, F.col("page_num"))).alias("first")).collect()}
    assert by_file == {"long.pdf": (5001, 1), "short.pdf": (3, 1)}


def test_files_that_fail(spark, tmp_path):
    (tmp_path / "bad.pdf").write_bytes(b"\xff")
    (tmp_path / "good.pdf").write_bytes(b"fine")
    paths = files.pdf_paths(spark, str(tmp_path))
    with pytest.raises(Exception, match="bad.pdf can't be read"):
        page_units(paths, count).collect()
    assert [files.basename_only(r.path) for r in page_units(paths, count, skip=True).collect()] == ["good.pdf"]
    assert page_units(paths.where("false"), count).count() == 0


class Counting:
    def __init__(self, folder):
        self.folder = folder

    def describe(self, prompt, images, temperature, max_tokens):
        import uuid

        open(f"{self.folder}/{uuid.uuid4().hex}", "w").close()
        return "described"


def test_watched_folder(spark, tmp_path):
    source, calls = tmp_path / "in", tmp_path / "calls"
    source.mkdir()
    calls.mkdir()
    (source / "a.pdf").write_bytes(FEED.join(f"Text of page {i}." for i in range(1, 121)).encode())
    store = Store(spark, str(tmp_path / "store"))
    run = lambda: watch_folder(spark, store, str(source), str(tmp_path / "png"), str(tmp_path / "mark"), count, read, images, generator=Counting(str(calls))).awaitTermination()
    totals = lambda: {r.collection: r.n for r in store.counts().collect()}
    run()
    assert totals() == {"text_chunks": 120, "image_descriptions": 121}
    assert len(list(calls.iterdir())) == 121  # each kept image once
    run()
    assert totals() == {"text_chunks": 120, "image_descriptions": 121} and len(list(calls.iterdir())) == 121
    (source / "b.pdf").write_bytes(b"Another file.")
    run()
    assert totals() == {"text_chunks": 121, "image_descriptions": 123} and len(list(calls.iterdir())) == 123
    assert len(list((tmp_path / "png").glob("*.png"))) == 123
    paths = {r.image_path for r in store.read("image_descriptions").collect()}
    assert all(p.startswith("file:") for p in paths)
    assert not list((tmp_path / "store" / "_staged").iterdir())
