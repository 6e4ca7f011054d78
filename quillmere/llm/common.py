"""Helpers that the operators of this folder share: written intermediate tables, hashes, span digests."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from pyspark.sql import Column, DataFrame, SparkSession

#: The separators of words: space and the bytes 0x09 to 0x0D, so words are `[^\x20\x09-\x0D]+`.
SPACES = "\\x20\\x09-\\x0D"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see, from spark.checkpoint.dir; only a local session may do without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quillmere-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/quillmere-{spark.sparkContext.applicationId}"


#: The paths that `written` makes, for each scratch that is open.
_open: list[list[str]] = []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared storage."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end what is written within it; the result must have been written elsewhere, or by `lasting`."""
    made: list[str] = []
    _open.append(made)
    try:
        yield
    finally:
        _open.remove(made)
        for path in made:
            remove(spark, path)


def clean_up(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; frames that read them can't be used any more."""
    remove(spark, shared_folder(spark))


def lasting(frame: DataFrame, replaces: str | None = None, outlives: bool = False) -> tuple[DataFrame, str]:
    """Cuts the lineage as `written` does; names the folder, and deletes the one that it replaces.

    With outlives, the table stays when the scratch ends in which it is made.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    if replaces:
        remove(spark, replaces)
    if _open and not outlives:
        _open[-1].append(path)
    return spark.read.schema(frame.schema).parquet(path), path


def written(frame: DataFrame) -> DataFrame:
    """Cuts the lineage: writes a frame as Parquet to the shared folder and reads it again."""
    return lasting(frame)[0]


#: A key is hot with more than one row in HOT; so fewer than HOT keys are, whatever the input.
HOT = 1000
#: Tables of up to this many short rows are broadcast whole.
BROADCAST_KEYS = 50_000


def spread_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", count: str = "n") -> DataFrame:
    """Joins rows with a table of one row a key and n (or count), the key's number of rows, so that no task gets a hot key's rows.

    A table of at most BROADCAST_KEYS rows is broadcast, and rows stay where they are. Of a larger one the fewer than HOT
    hot keys are broadcast; the others, of at most one row in HOT each, are joined by a shuffle. Both frames are read
    twice, so they should be written ones.
    """
    keys, total = table.agg(F.count("*"), F.sum(count)).first()
    if keys <= BROADCAST_KEYS:
        return rows.join(F.broadcast(table), key, how)
    bar = total / HOT
    hot = table.where(F.col(count) > bar).withColumn("__hot", F.lit(True))
    found = rows.join(F.broadcast(hot), key, "left")
    rest = found.where("__hot is null").select(*rows.columns).join(table.where(F.col(count) <= bar), key, how)
    return found.where("__hot").drop("__hot").unionByName(rest)


#: Bits of a filter at most, in blocks of 1024: 32 MB, and a third more as a hash table.
FILTER_BITS = 1 << 28


def key_filter(keys: DataFrame) -> tuple[DataFrame, int]:
    """A bitmap of the hashes h of keys: blocks of 16 words, and the number of bits. Its size is bounded by FILTER_BITS."""
    bits = 1 << 16
    n = keys.count()
    while bits < min(16 * n, FILTER_BITS):
        bits *= 2
    at = F.pmod("h", F.lit(bits))
    one = F.expr(f"shiftleft(1L, cast(pmod(h, {bits}) % 64 as int))")
    word = F.floor(at / 64) % 16
    words = [F.coalesce(F.bit_or(F.when(word == k, one)), F.lit(0).cast("bigint")) for k in range(16)]
    return keys.groupBy(F.floor(at / 1024).alias("__block")).agg(F.array(*words).alias("__words")), bits


def maybe_in(rows: DataFrame, h: Column, made: tuple[DataFrame, int]) -> DataFrame:
    """rows with __maybe: false only where the hash h is not among the filter's keys. The filter is broadcast."""
    blocks, bits = made
    rows = rows.withColumn("__at", F.pmod(h, F.lit(bits))).withColumn("__block", F.floor(F.col("__at") / 1024))
    bit = F.expr("getbit(get(__words, cast(floor(__at / 64) % 16 as int)), __at % 64)")
    out = rows.join(F.broadcast(blocks), "__block", "left").withColumn("__maybe", F.coalesce(bit == 1, F.lit(False)))
    return out.drop("__block", "__words", "__at")


def let(value: Column, then) -> Column:
    """Evaluates value once per row and hands it on."""
    return F.transform(F.array(value), then)[0]


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+"), lambda w: w != ""))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (multiply, shift and xor)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def trim() -> None:
    """Gives memory that a worker no longer uses back to the system; workers stay alive between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    """Null-safe equality of columns with the same names in two frames."""
    out = F.lit(True)
    for name in names:
        out = out & a[name].eqNullSafe(b[name])
    return out
