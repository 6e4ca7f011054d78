"""Files read by ranges of pages, so that one long file is the work of many tasks.

Two steps: every file is opened once to count its pages, and becomes rows (path, first, last) of at most `size` pages; these
are dealt to tasks by path and range, and each task opens the file by its path and reads its ranges alone. The driver sees
neither contents nor ranges. Ranges of one file that meet in a task open it once.

Cases: a file without pages has no rows; a file that can't be read fails the job with its path, unless `skip` is set, which
leaves it out; files with one name in different folders are read each, and share the names of their pages.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import functions as F

from ..functions.text import basename, clean
from .files import FOUND, content_of

if TYPE_CHECKING:
    from collections.abc import Callable, Iterable

    from pyspark.sql import DataFrame

#: Pages of a unit, and tasks for each core of the cluster that the units are dealt to.
SIZE, TASKS_A_CORE = 50, 4


def page_units(paths: DataFrame, count: Callable[[bytes], int], size: int = SIZE, skip: bool = False) -> DataFrame:
    """Of paths (path): path, first, last, pages counting from 1."""

    def run(batches):
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    rows.append((path, count(content_of(path))))
                except Exception as e:
                    if not skip:
                        raise ValueError(f"{path} can't be read") from e
            yield pd.DataFrame(rows, columns=["path", "n"])

    spread = dealt(paths.select("path"), "path")
    counted = spread.mapInPandas(run, "path string, n int").where("n > 0")
    first = F.explode(F.sequence(F.lit(1), F.col("n"), F.lit(size)))
    return counted.select("path", "n", first.alias("first")).select("path", "first", F.least(F.col("first") + size - 1, F.col("n")).alias("last"))


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by their keys to a fixed number of tasks: they are short, but the work behind them is long."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism * TASKS_A_CORE, *keys)


def ranges(units: DataFrame, reader: Callable[[bytes, int, int], Iterable[tuple]], schema: str) -> DataFrame:
    """The rows of a reader (content, first, last) of each unit, with the file's name before them."""
    columns = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        known, content = None, b""
        for batch in batches:
            for path, first, last in zip(batch["path"], batch["first"], batch["last"], strict=True):
                if path != known:
                    known, content = path, content_of(path)
                yield pd.DataFrame([(path, *row) for row in reader(content, first, last)], columns=columns)

    placed = dealt(units, "path", "first").sortWithinPartitions("path", "first")
    return placed.mapInPandas(run, schema).withColumn("file_name", basename(F.col("file_name")))


def unit_pages(units: DataFrame, reader: Callable[[bytes, int, int], Iterable[str]]) -> DataFrame:
    """One row per page, cleaned: file_name, page_num, text."""
    numbered = lambda content, first, last: enumerate(reader(content, first, last), int(first))
    return ranges(units, numbered, "file_name string, page_num int, text string").withColumn("text", clean(F.col("text")))


def unit_images(units: DataFrame, reader: Callable[[bytes, int, int], Iterable[tuple]]) -> DataFrame:
    """One row per placed image, with its PNG; an image that stands on pages of several units is found in each."""
    return ranges(units, reader, FOUND)
