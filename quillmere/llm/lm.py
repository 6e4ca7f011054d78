r"""Language-model scores by stupid backoff, computed relationally.

Documents are dealt to batches by a hash. Each batch explodes its texts into n-grams of all orders up to ``order`` and
keeps each distinct n-gram once with its count; so a frequent n-gram costs one entry a batch, however often it occurs.
These entries are partitioned by hash range into buckets, where the count tables are summed; the totals are joined back to
the exploded n-grams of each batch, position by position, and summed per document. The number of batches follows the
bytes of the input, and a bucket takes as much as ``BUCKET_BATCHES`` batches, so the work of a task stays the same as the
input grows; within a bucket, the sorted runs are summed range by range, so only one range is sorted in memory at a time.
Entries travel as packed runs, one for each batch and bucket; like the blocks of any shuffle, their number is
the product of the two.

Two scores come of one pass. ``corpus_log_score`` sums the logarithm of count(n-gram) / count(context) over the words of a
document by the counts of the whole corpus, its own included. ``log_score`` takes the document's own counts off: the
longest n-gram that another document has counts, times ``ALPHA`` for each order given up; a word that no other document
has scores ``ALPHA`` to the number of orders, over the number of words. N-grams are identified by 64-bit hashes. Case is
kept.

Cases: null and empty texts have no words, sums of 0 and null means; repeated rows count as documents of their own, and
those of different input partitions go to different batches; a corpus of one document scores every word as unseen; one
very long text is one batch, of some 150 bytes a word in memory; only doc_id and text are read, so other columns' names
can't clash; an empty table stays empty.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trim
from .wordhash import WordHasher, pieces, shingles

ORDER, ALPHA = 3, 0.4
BATCH_BYTES, BUCKET_BATCHES = 10 << 20, 2
#: Entries of a bucket that are summed at once.
STEP = 1 << 20
CODEC = pa.Codec("zstd", compression_level=1)
#: The name under which the number of words is counted.
WORDS = np.uint64(0)


def packed(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + CODEC.compress(data, asbytes=True)


def unpacked(data: bytes) -> bytes:
    return CODEC.decompress(data[4:], decompressed_size=int.from_bytes(data[:4], "little"), asbytes=True) if len(data) > 4 else b""


def planes(values: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, compressed; the high planes hold few different bytes."""
    return packed(values.view(np.uint8).reshape(len(values), -1).T.tobytes())


def unplanes(data: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unpacked(data), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return planes(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, np.uint64), dtype=np.uint64)


def exploded(raw: list[bytes], order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The number of words of each text; per order, the n-gram that ends at each word (WORDS where there is none)."""
    hasher, found, sizes = WordHasher(lower=False), [], []
    for a, b in pieces(raw):
        words, at = hasher.words(raw[a:b])
        found.append(words)
        sizes.append(np.diff(at))
    words = np.concatenate(found) if found else np.zeros(0, np.uint64)
    sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    grams = []
    for k in range(1, order + 1):
        row = np.full(len(words), WORDS, dtype=np.uint64)
        if len(words) >= k:
            row[k - 1 :] = shingles(words, k)
        row[place < k - 1] = WORDS
        grams.append(row)
    return sizes, grams


def counted(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in order of hash, and their counts; WORDS stands for all words."""
    unique, counts = np.unique(np.concatenate([np.zeros(1, np.uint64), *grams]), return_counts=True)
    counts[0] = len(grams[0])
    return unique, counts.astype(np.uint32)


def bucket_edges(unique: np.ndarray, buckets: int) -> np.ndarray:
    at = ((unique >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(at, np.arange(buckets + 1))


def summed(grams: list[np.ndarray], counts: list[np.ndarray], step: int = STEP) -> list[np.ndarray]:
    """The total of each n-gram of sorted runs, run by run; about step entries are sorted at once, by ranges of the hash."""
    out = [np.empty(len(g), dtype=np.uint64) for g in grams]
    cuts = max(1, -(-sum(map(len, grams)) // step))
    low, high = min(int(g[0]) for g in grams), max(int(g[-1]) for g in grams) + 1
    inner = np.array([low + (high - low) * k // cuts for k in range(1, cuts)], dtype=np.uint64)
    edges = [np.concatenate([[0], np.searchsorted(g, inner), [len(g)]]) for g in grams]
    for k in range(cuts):
        runs = [slice(e[k], e[k + 1]) for e in edges]
        _, inverse = np.unique(np.concatenate([g[r] for g, r in zip(grams, runs, strict=True)]), return_inverse=True)
        weights = np.concatenate([c[r] for c, r in zip(counts, runs, strict=True)])
        sums = np.bincount(inverse, weights=weights).astype(np.uint64)[inverse]
        for whole, r, part in zip(out, runs, np.split(sums, np.cumsum([r.stop - r.start for r in runs])[:-1]), strict=True):
            whole[r] = part
    return out


def places(grams: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each n-gram, its place among the distinct ones as `counted` has them, and how often its document has it."""
    flat = np.concatenate([np.zeros(1, np.uint64), *grams])
    order = np.argsort(flat, kind="stable")  # equal n-grams stay in the order of their documents
    flat = flat[order]
    first = np.ones(len(flat), dtype=bool)
    first[1:] = flat[1:] != flat[:-1]
    del flat
    at = np.empty(len(order), dtype=np.int32)
    at[order] = np.cumsum(first, dtype=np.int32) - 1
    docs = np.concatenate([np.full(1, -1, np.int32), *[doc.astype(np.int32)] * len(grams)])[order]
    first[1:] |= docs[1:] != docs[:-1]
    runs = np.diff(np.append(np.flatnonzero(first), len(order))).astype(np.int32)
    own = np.empty(len(order), dtype=np.int32)
    own[order] = np.repeat(runs, runs)
    return at[1:].reshape(len(grams), -1), own[1:].reshape(len(grams), -1)


def scored(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, log_score, corpus_log_score, and both scores per word."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / batch_bytes))
    buckets = math.ceil(n / BUCKET_BATCHES)
    kind = docs.schema["doc_id"].dataType.simpleString()

    @F.arrow_udf("binary")
    def shrink(text: pa.Array) -> pa.Array:
        return pa.array([packed(t) if t else b"" for t in text.cast(pa.binary()).to_pylist()], pa.binary())

    batch = F.pmod(F.xxhash64("doc_id", F.md5(F.coalesce("text", F.lit(""))), F.spark_partition_id()), F.lit(n)).cast("int")
    rows = docs.select(batch.alias("batch"), "doc_id", shrink(F.coalesce("text", F.lit(""))).alias("text"))
    texts = lambda group: [unpacked(t) for t in group["text"]]

    def ask(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        unique, counts = counted(exploded(texts(group), order)[1])
        trim()
        edges = bucket_edges(unique, buckets)
        full = np.flatnonzero(np.diff(edges))
        cut = [(slice(edges[k], edges[k + 1])) for k in full]
        return pd.DataFrame({"bucket": full.astype(np.int32), "batch": np.int32(key[0]), "grams": [pack_sorted(unique[c]) for c in cut], "counts": [planes(counts[c]) for c in cut]})

    def answer(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        grams, counts = [unpack_sorted(g) for g in group.pop("grams")], [unplanes(c, np.uint32) for c in group.pop("counts")]
        sums = summed(grams, counts)
        del grams, counts
        sums = [planes(x) for x in sums]
        trim()
        return pd.DataFrame({"batch": group["batch"], "bucket": np.int32(key[0]), "totals": sums})

    def score(key: tuple, group: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        sizes, grams = exploded(texts(group), order)
        known = np.concatenate([unplanes(t, np.uint64) for t in totals.sort_values("bucket")["totals"]]).astype(np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        at, own = places(grams, doc)
        longest = np.minimum(order, np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1)
        out = {"doc_id": group["doc_id"], "n_words": sizes}
        for name, less in (("log_score", 1), ("corpus_log_score", 0)):
            words = (known[0] - less * sizes)[doc].astype(float)
            score, context = np.full(len(doc), np.nan), words
            for k in range(1, order + 1):  # the longest n-gram that is seen comes last
                count = (known[at[k - 1]] - less * own[k - 1]).astype(float)
                seen = (grams[k - 1] != WORDS) & (count > 0)
                score[seen] = np.log(count[seen] / context[seen]) + (longest[seen] - k) * math.log(alpha)
                context = np.concatenate([[0], count[:-1]]) if len(count) else count
            left = np.isnan(score)
            score[left] = longest[left] * math.log(alpha) - np.log(np.maximum(words[left], 1.0))
            out[name] = np.bincount(doc, weights=score, minlength=len(sizes))
        return pd.DataFrame(out)

    asked = rows.groupBy("batch").applyInPandas(ask, "bucket int, batch int, grams binary, counts binary")
    answers = asked.groupBy("bucket").applyInPandas(answer, "batch int, bucket int, totals binary")
    scores = rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(score, f"doc_id {kind}, n_words bigint, log_score double, corpus_log_score double")
    for name in ("log_score", "corpus_log_score"):
        scores = scores.withColumn(f"mean_{name}", F.when(F.col("n_words") > 0, F.col(name) / F.col("n_words")))
    return scores
