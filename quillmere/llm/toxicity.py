"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased; its character n-grams are hashed to buckets, each counted once a text. The classifier learns from
at most ``LABELS`` training rows of each label, the first by the hash of their id, so a rare label is taken whole; their
ids are broadcast (16 bytes each), so no text is shuffled. Over these a relation (bucket, toxic documents, other
documents) is summed, with partial sums in each task. From it come the log-count ratios, and the ``FEATURES`` buckets
whose ratio is most certain. A logistic regression on the presence of these, scaled by their ratios, is fitted on the
first ``SAMPLE`` of each label; where a label has more, the intercept is moved to the share of labels of all training
rows, so the scores mean the same at every size. Scores need the text only.

Training rows are those of labels whose crc32 of the id as text, modulo ``FOLDS``, is not ``HELD_OUT``.
Cases: a null or empty text has no n-grams and scores by the bias; without training rows of both labels the score is
the smoothed share of toxic ones (0 without any rows); ids labelled twice count twice; repeated rows score alike; a very
long text is scored whole in one pass, with work arrays of some 20 bytes a character; columns of docs or labels with
clashing names are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import sigmoid
from .common import trim, written

ORDERS, BUCKETS = (4, 5), 1 << 19
FEATURES, LEAST_DOCS, LABELS, SAMPLE = 4096, 4, 20_000, 10_000
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Entries of the regression's rows that are worked on at once.
BLOCK = 1 << 18


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)), F.lit(0))


def buckets(text: str) -> np.ndarray:
    """The buckets of a text's character n-grams, with repeats."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = []
    for n in ORDERS:
        if len(points) >= n:
            h = np.full(len(points) - n + 1, n, dtype=np.uint32)
            for k in range(n):
                h = (h ^ points[k : len(points) - n + 1 + k]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            out.append(h & np.uint32(BUCKETS - 1))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def counts(rows: DataFrame) -> DataFrame:
    """Of rows (text, toxic): bucket, pos, neg, the documents of either label that have it."""

    def partial(batches):
        seen = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            for text, label in zip(batch["text"], batch["toxic"], strict=True):
                seen[int(label), np.unique(buckets(text or ""))] += 1
        some = np.flatnonzero(seen.sum(axis=0))
        for part in np.array_split(some, len(some) // 50_000 + 1):
            yield pd.DataFrame({"bucket": part, "pos": seen[1, part], "neg": seen[0, part]})

    parts = rows.select("text", "toxic").mapInPandas(partial, "bucket bigint, pos bigint, neg bigint")
    return parts.groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def ratios(by: DataFrame, pos: int, neg: int, features: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets with the most certain log-count ratios, and these."""
    p, q = (F.col("pos") + 1) / F.lit(pos + 2.0), (F.col("neg") + 1) / F.lit(neg + 2.0)
    ratio = F.log(p / q)
    certain = F.abs(ratio) / F.sqrt((1 - p) / (F.col("pos") + 1) + (1 - q) / (F.col("neg") + 1))
    top = by.where(F.col("pos") + F.col("neg") >= least).select("bucket", ratio.alias("ratio"), certain.alias("z"))
    rows = top.orderBy(F.desc("z"), "bucket").limit(features).collect()
    rows.sort(key=lambda r: r.bucket)
    return np.array([r.bucket for r in rows], dtype=np.int64), np.array([r.ratio for r in rows])


def fitted(starts: np.ndarray, columns: np.ndarray, y: np.ndarray, scale: np.ndarray, ridge: float = 2.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse rows of ones scaled per column, by accelerated gradient steps.

    Each step passes over the rows in blocks of about BLOCK entries, so work arrays don't grow with the sample.
    """
    w, b = np.zeros(len(scale)), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    cuts = np.unique(np.concatenate([np.searchsorted(starts[:-1], np.arange(0, starts[-1] + 1, BLOCK)), [0, len(y)]]))

    def blocks():
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            row_of = np.repeat(np.arange(high - low), np.diff(starts[low : high + 1]))
            yield slice(low, high), row_of, columns[starts[low] : starts[high]]

    norm = 1.0
    for rows, row_of, cols in blocks():
        norm = max(norm, float(np.bincount(row_of, weights=(scale**2)[cols], minlength=rows.stop - rows.start).max(initial=1.0)))
    rate = 4.0 / (norm + 1)
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        sums, off, scaled = np.zeros(len(scale)), 0.0, scale * vw
        for rows, row_of, cols in blocks():
            error = sigmoid(np.bincount(row_of, weights=scaled[cols], minlength=rows.stop - rows.start) + vb) - y[rows]
            sums += np.bincount(cols, weights=error[row_of], minlength=len(scale))
            off += float(error.sum())
        gw = sums * scale / len(y) + ridge / len(y) * vw
        nw, nb = vw - rate * gw, vb - rate * off / len(y)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb, w, b, t = nw + (t - 1) / s * (nw - w), nb + (t - 1) / s * (nb - b), nw, nb, s
    return w, b


def trained(docs: DataFrame, labels: DataFrame, features: int = FEATURES, least: int = LEAST_DOCS, rows: int = LABELS, bound: int = SAMPLE) -> tuple[np.ndarray, float]:
    """A weight per bucket (zero for those not selected), and the bias."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(fold(F.col("doc_id")) != HELD_OUT)
    known = known.select(F.xxhash64("doc_id", F.lit("fit")).alias("h"), F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic"))
    all_of = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    known = written(first_of_each(known, rows))
    texts = docs.select("doc_id", "text").where(fold(F.col("doc_id")) != HELD_OUT)
    matched = texts.join(F.broadcast(known), F.col("doc_id") == F.col("__id"))
    weights = np.zeros(BUCKETS, dtype=np.float64)
    total = {r.toxic: r["count"] for r in matched.groupBy("toxic").count().collect()}
    pos, neg = total.get(1, 0), total.get(0, 0)
    if not pos or not neg:
        return weights, float(np.log((pos + 0.5) / (neg + 0.5))) if pos + neg else -30.0
    picked, ratio = ratios(counts(matched), pos, neg, features, least)
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[picked] = np.arange(len(picked))

    @F.pandas_udf("binary")
    def present(text: pd.Series) -> pd.Series:
        found = (place[buckets(t or "")] for t in text)
        return pd.Series([np.unique(p[p >= 0]).astype(np.int16).tobytes() for p in found], dtype=object)

    chosen = texts.join(F.broadcast(first_of_each(known, bound)), F.col("doc_id") == F.col("__id"))
    chosen = chosen.select("h", "doc_id", "toxic", present("text").alias("cols"))
    sample = first_of_each(chosen, bound, ["h", "doc_id", "cols"]).collect()
    if not sample:
        return weights, float(np.log((pos + 0.5) / (neg + 0.5)))
    y = np.array([r.toxic for r in sample], dtype=float)
    starts = np.concatenate([[0], np.cumsum([len(r.cols) // 2 for r in sample])])
    columns = np.frombuffer(b"".join(r.cols for r in sample), dtype=np.int16)
    del sample
    w, bias = fitted(starts, columns, y, ratio)
    weights[picked] = w * ratio
    del columns
    trim()
    return weights, bias + shift(all_of, {1: int(y.sum()), 0: int(len(y) - y.sum())}, bound)


def first_of_each(rows: DataFrame, bound: int, order: list[str] | None = None) -> DataFrame:
    """The first rows of either label, at most bound of each."""
    order = order or ["h", "__id"]
    toxic, other = (rows.where(F.col("toxic") == label).orderBy(*order).limit(bound) for label in (1, 0))
    return toxic.unionByName(other)


def shift(all_of: dict[int, int], drawn: dict[int, int], bound: int) -> float:
    """What the bound adds to the log odds of a label: nothing where neither label exceeds it."""
    if max(all_of.values()) <= bound or not drawn[0] or not drawn[1]:
        return 0.0
    return float(np.log(all_of[1] / all_of[0]) - np.log(drawn[1] / drawn[0]))


def score_of(docs: DataFrame, labels: DataFrame, **options) -> Column:
    """The score of column text, by a classifier that is trained here on docs and labels."""
    weights, bias = trained(docs, labels, **options)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        out = np.empty(len(text))
        for k, t in enumerate(text):
            h = buckets(t or "")
            h = np.unique(h[weights[h] != 0])
            out[k] = weights[h].sum() + bias
        return pd.Series(sigmoid(out))

    return score("text")


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """docs with score and predicted, which replace columns of these names."""
    out = docs.withColumn("score", score_of(docs, labels, **options))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
