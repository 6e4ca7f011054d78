r"""Exact deduplication by composable polynomial fingerprints.

A text's UTF-8 bytes are cut into chunks of ``chunk_bytes``. Each chunk gets its polynomial value and its shift
``base ** length`` modulo two primes, in one vectorised pass (Arrow batches). The fingerprint of the whole is composed
from those of its chunks in the JVM, ``value(ab) = value(a) * shift(b) + value(b)``. A text of over ``huge_bytes`` is
exploded to its chunks first: these are dealt to all tasks, hashed apart, and composed by an ordered aggregation.

Texts with equal fingerprint and length are only candidates: each candidate is compared, chunk by chunk, with the
representative of its group, in a join on (group, salt, chunk). The salts spread a hot group, and the representative is
repeated once a salt (once per ``salt_rows`` members). Texts that differ from their representative form the next round's
groups, until no difference is left, so the result never depends on the fingerprint being free of collisions. Only
candidate texts are shuffled: a bitmap of the candidates, of bounded size, is broadcast and drops the other rows first.
Joins back to groups broadcast the few hot ones and shuffle the rest.

Cases: a null text counts as empty; empty texts are equal to each other; rows with the same id and text are repeats of
one row, of which exactly one is kept; a null id is smaller than any other; very long texts are hashed and compared by
chunks; only doc_id and text are read, and keep_one returns all other columns as they are; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import key_filter, maybe_in, same, spread_join, written

#: Two primes below 2**31, so that a chunk of 64 KiB sums without overflow in 64 bits, and the bases.
PRIMES = (2147483629, 2147483587)
BASES = (1000003, 998244353)
CHUNK_BYTES = 1 << 16
#: Texts beyond this size are hashed by several tasks.
HUGE_BYTES = 4 << 20


def fingerprint_parts(primes: tuple[int, int] = PRIMES, bases: tuple[int, int] = BASES, chunk_bytes: int = CHUNK_BYTES):
    """An Arrow UDF: binary -> array of the chunks' (value, shift) for both primes."""
    kind = "array<struct<h1:bigint,s1:bigint,h2:bigint,s2:bigint>>"

    @F.arrow_udf(kind)
    def parts(column: pa.Array) -> pa.Array:
        powers = []
        for prime, base in zip(primes, bases, strict=True):
            row = np.ones(chunk_bytes + 1, dtype=np.int64)
            for i in range(1, chunk_bytes + 1):
                row[i] = row[i - 1] * base % prime
            powers.append(row)
        column = column.cast(pa.large_binary())
        at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
        ends, out = [0], ([], [], [], [])
        for start, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            for a in range(start, end, chunk_bytes) if end > start else (start,):
                chunk = data[a : min(a + chunk_bytes, end)].astype(np.int64)
                n = len(chunk)
                for k, (prime, power) in enumerate(zip(primes, powers, strict=True)):
                    out[2 * k].append(int(chunk @ power[:n][::-1]) % prime)
                    out[2 * k + 1].append(int(power[n]))
            ends.append(len(out[0]))
        fields = [pa.array(x, pa.int64()) for x in out]
        rows = pa.StructArray.from_arrays(fields, ["h1", "s1", "h2", "s2"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return parts


def composed(parts, primes: tuple[int, int] = PRIMES):
    """The fingerprint of the whole from those of its chunks, left to right."""

    def step(at, x):
        return F.struct(((at.a * x.s1 + x.h1) % primes[0]).alias("a"), ((at.b * x.s2 + x.h2) % primes[1]).alias("b"))

    return F.aggregate(parts, F.struct(F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b")), step)


def raw_text() -> Column:
    return F.coalesce(F.col("text"), F.lit("")).cast("binary")


def fingerprints(docs: DataFrame, primes=PRIMES, bases=BASES, chunk_bytes=CHUNK_BYTES, huge_bytes: int = HUGE_BYTES) -> DataFrame:
    """Per row: doc_id, f1, f2, n_bytes and text_sha256 of its text."""
    parts, names = fingerprint_parts(primes, bases, chunk_bytes), ["doc_id", "n_bytes", "text_sha256"]
    hashed = docs.select("doc_id", raw_text().alias("raw"), F.length(raw_text()).cast("long").alias("n_bytes"), F.sha2(raw_text(), 256).alias("text_sha256"))
    small = hashed.where(F.col("n_bytes") <= huge_bytes).select(*names, parts("raw").alias("parts"))
    # rows with one id and text have the same chunks: they are one group, counted by their first chunks
    huge = docs.where(F.length(raw_text()) > huge_bytes).withColumn("n_bytes", F.length(raw_text()).cast("long")).withColumn("text_sha256", F.sha2(raw_text(), 256))
    chunks = chunk_rows(huge, names, chunk_bytes).repartition("doc_id", "text_sha256", "chunk")
    chunks = chunks.select(*names, "chunk", F.get(parts("bytes"), F.lit(0)).alias("part"))
    grouped = chunks.groupBy(*names).agg(F.sort_array(F.collect_set(F.struct("chunk", "part"))).alias("parts"), F.count_if(F.col("chunk") == 0).cast("int").alias("n"))
    grouped = grouped.select(*names, F.transform("parts", lambda x: x["part"]).alias("parts"), F.explode(F.sequence(F.lit(1), F.col("n")))).drop("col")
    whole = composed(F.col("parts"), primes)
    return small.unionByName(grouped).select("doc_id", whole["a"].alias("f1"), whole["b"].alias("f2"), "n_bytes", "text_sha256")


def chunk_rows(frame: DataFrame, keep: list[str], chunk_bytes: int) -> DataFrame:
    """One row per chunk of each text; the array of chunks is built before the explode, so no row repeats the text."""
    raw = raw_text()
    last = F.floor((F.greatest(F.length(raw), F.lit(1)) - 1) / chunk_bytes).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * chunk_bytes + 1, F.lit(chunk_bytes)))
    return frame.select(*keep, F.posexplode(cut).alias("chunk", "bytes"))


def row_hash() -> Column:
    return F.xxhash64("doc_id", "text_sha256")


def candidates(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The texts of members, one row for each doc_id and text; other texts are dropped before the shuffle."""
    texts = maybe_in(docs.select("doc_id", "text", F.sha2(raw_text(), 256).alias("text_sha256")), row_hash(), key_filter(members.select(row_hash().alias("h"))))
    texts = texts.where("__maybe").drop("__maybe").dropDuplicates(["doc_id", "text_sha256"])  # first within each task
    return members.join(texts, same(members, texts, ["doc_id", "text_sha256"])).select(members["*"], texts["text"])


def differing(docs: DataFrame, members: DataFrame, chunk_bytes: int, salt_rows: int) -> DataFrame:
    """Of members (g, n, doc_id, text_sha256, rep_id, rep_sha), those whose text differs from the representative's.

    g names the candidate group and n its size.
    """
    is_rep = F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("text_sha256") == F.col("rep_sha"))
    salts = F.ceil(F.col("n") / salt_rows).cast("int")
    found = written(candidates(docs, members).withColumn("is_rep", is_rep))
    rep = found.where("is_rep").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    rep = chunk_rows(rep, ["g", "salt"], chunk_bytes).withColumnRenamed("bytes", "rep_bytes")
    rest = found.where("not is_rep").withColumn("salt", F.pmod(row_hash(), salts).cast("int"))
    rest = chunk_rows(rest, ["g", "salt", "doc_id", "text_sha256"], chunk_bytes)
    compared = rest.join(rep, ["g", "salt", "chunk"], "left")
    equal = F.coalesce(F.col("bytes") == F.col("rep_bytes"), F.lit(False))
    return compared.groupBy("g", "doc_id", "text_sha256").agg(F.bool_and(equal).alias("equal")).where("not equal").drop("equal")


def exact_classes(docs: DataFrame, primes=PRIMES, bases=BASES, chunk_bytes=CHUNK_BYTES, salt_rows: int = 512, huge_bytes: int = HUGE_BYTES) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    base = fingerprints(docs, primes, bases, chunk_bytes, huge_bytes)
    base = written(base.select("doc_id", "text_sha256", F.concat_ws("-", "f1", "f2", "n_bytes").alias("g")))
    while True:
        rep = F.max(F.struct("doc_id", "text_sha256")).alias("rep")
        groups = base.groupBy("g").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id"), rep).where("n > 1")
        groups = written(groups.select("g", "n", "keep_id", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_sha256").alias("rep_sha")))
        members = written(spread_join(base, groups.drop("keep_id"), "g").distinct())
        apart = written(differing(docs, members, chunk_bytes, salt_rows))
        if apart.isEmpty():
            break
        mark = apart.withColumn("apart", F.lit(True))
        base = base.join(mark, same(base, mark, ["g", "doc_id", "text_sha256"]), "left").select(
            base["doc_id"], base["text_sha256"], F.when(mark["apart"], F.concat(base["g"], F.lit("+"))).otherwise(base["g"]).alias("g")
        )
        base = written(base)
    names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    rows = spread_join(base, groups.select("g", "n", "keep_id"), "g", "left").withColumn("group_size", F.coalesce("n", F.lit(1)).cast("long"))
    rows = rows.withColumn("keep_id", F.when(F.col("n") > 1, F.col("keep_id")).otherwise(F.col("doc_id")))
    rows = rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    alone = rows.where("group_size = 1 or not kept").select(*names)
    # repeats of the row that stays are one group with a count, of which one is kept
    ties = rows.where("group_size > 1 and kept").groupBy(*names).agg(F.count("*").alias("c"))
    ties = ties.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / TIES))))
    ties = ties.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(TIES), F.col("c") - F.col("block") * TIES))))
    return alone.unionByName(ties.withColumn("kept", (F.col("block") == 0) & (F.col("k") == 1)).select(*names))


#: Repeats of one row that are made at once.
TIES = 4096


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, one of each class of equal texts, with all their columns.

    Rows that share no text are passed on as they are; only those of classes, and what the bitmap can't tell from them,
    are shuffled.
    """
    classes = written(exact_classes(docs.select("doc_id", "text"), **options).where("group_size > 1").select("doc_id", "text_sha256", "kept"))
    known = classes.groupBy("doc_id", "text_sha256").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    # by the hash of a row; rows of different ids and texts whose hashes are equal stand in one list
    entry = F.struct(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), "kept")
    known = written(known.groupBy(row_hash().alias("__h")).agg(F.collect_list(entry).alias("__known"), F.sum("n").alias("__n")))
    named = docs.withColumn("__sha", F.sha2(raw_text(), 256)).withColumn("__h", F.xxhash64("doc_id", "__sha"))
    rows = maybe_in(named, F.col("__h"), key_filter(known.select(F.col("__h").alias("h"))))
    some = spread_join(rows.where("__maybe"), known, "__h", "left", count="__n")
    mine = F.filter("__known", lambda k: k["id"].eqNullSafe(F.col("doc_id")) & (k["sha"] == F.col("__sha")))
    some = some.withColumn("__kept", F.get(mine, F.lit(0))["kept"])
    copies = some.where("__kept").dropDuplicates(["doc_id", "__sha"])
    return rows.where("not __maybe").select(*docs.columns).unionByName(some.where("__kept is null").select(*docs.columns)).unionByName(copies.select(*docs.columns))
