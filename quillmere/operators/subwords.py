"""Token counts of a byte-level BPE vocabulary, by the distinct words of a task.

A text is cut into words by the vocabulary's pattern, once, by Spark; tokens never cross words. The words of many texts
reach an Arrow function as one array. In steps of ``STEP`` words the distinct ones are numbered and sized, each once, and a
text's sum is a difference of running totals. Nothing is shuffled, so no word is hot and the work grows with the input; a
word is sized again in each step that has it. Memory is bounded by a step and by the batch that Spark sends.

The vocabulary is a file of lines `base64 rank`, one for each token: the rank of a pair of tokens is that of their
concatenation, and the pair of the least rank merges first, the leftmost of equal ones. ``COMMON`` words at a time merge side
by side, a pair of each in every round; one of over ``SHORT`` bytes merges alone by a heap of pairs, so a word without a
break takes n log n steps. Cases: a null or empty text has 0 tokens; repeated rows are counted alike; characters of any
script fall back to their bytes, which are tokens too.
"""

from __future__ import annotations

import base64
import heapq
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from pyspark.sql import Column, DataFrame, SparkSession

COMMON, SHORT, STEP = 1 << 15, 64, 1 << 22
#: The order of a pair that does not merge.
NEVER = 1 << 60
#: The pattern of words of the public byte-level vocabularies: contractions, words, numbers, signs, and white space but
#: for the last one before a word.
WORDS = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ranks_of(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The vocabulary: bytes of a token to its rank. It is read by Spark and bounded by the vocabulary's size."""
    rows = spark.read.text(path).select(F.split("value", " ").alias("x")).where(F.size("x") == 2).collect()
    return {base64.b64decode(r.x[0]): int(r.x[1]) for r in rows}


def merged(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of a word."""
    if word in ranks:
        return [word]
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, bytes]] = []

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else n
        if i >= 0 and j < n and (rank := ranks.get(pair := parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (rank, i, pair))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= n or parts[j] is None or len(parts[i]) + len(parts[j]) != len(pair) or parts[i] + parts[j] != pair:
            continue  # one of the two has merged since
        parts[i], parts[j], after[i] = pair, None, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [p for p in parts if p is not None]


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of single bytes, the pairs of tokens that merge (left, then right, in 32 bits each; sorted), and what each becomes."""
    top = max(ranks.values(), default=0) + 1
    tokens = {bytes([i]): top + i for i in range(256)} | ranks
    pairs = {(left << 32) + right: rank for t, rank in ranks.items() for i in range(1, len(t)) if (left := tokens.get(t[:i])) is not None and (right := tokens.get(t[i:])) is not None}
    pairs |= {-1: 0}  # no pair; the table is never empty
    keys = sorted(pairs)
    return np.array([tokens[bytes([i])] for i in range(256)]), np.array(keys), np.array([pairs[k] for k in keys])


def side_by_side(text: np.ndarray, width: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The numbers of tokens of words of 1 to SHORT bytes, given one after another; a mark, which pairs with nothing, ends each."""
    single, keys, becomes = table
    sizes, word, width = np.zeros(len(width), np.int64), np.arange(len(width)), width + 1
    ends = np.cumsum(width)
    tokens = np.full(width.sum(), (1 << 31) - 1)
    tokens[np.delete(np.arange(len(tokens)), ends - 1)] = single[text]
    place = np.arange(len(tokens)) - np.repeat(ends - width, width)

    def order(i: np.ndarray) -> np.ndarray:
        """Of the pairs that begin at i: rank, then place."""
        pairs = (tokens[i] << 32) + tokens[i + 1]
        at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
        return np.where(keys[at] == pairs, becomes[at] * (2 * SHORT) + place[i], NEVER)

    orders = np.append(order(np.arange(len(tokens) - 1)), NEVER)
    while len(word):
        first = np.cumsum(width) - width
        least = np.minimum.reduceat(orders, first)
        live = least < NEVER
        sizes[word[~live]] = width[~live] - 1
        stay = np.repeat(live, width)
        at = np.flatnonzero((orders == np.repeat(least, width)) & stay)
        tokens[at], stay[at + 1] = least[live] // (2 * SHORT), False
        tokens, place, orders = tokens[stay], place[stay], orders[stay]
        word, width, at = word[live], width[live] - 1, at - first[live]
        at += np.cumsum(width) - width
        for i in (at - 1, at):  # the one before the first is the last mark
            orders[i] = order(i)
    return sizes


def sizes_of(words: pa.Array, ranks: dict[bytes, int], table: tuple[np.ndarray, np.ndarray, np.ndarray], vocabulary: pa.Array) -> np.ndarray:
    """The numbers of tokens of words."""
    words = words.cast(pa.binary())
    width, sizes = pc.binary_length(words).to_numpy(), np.ones(len(words), np.int64)
    rest = ~pc.is_in(words, value_set=vocabulary).to_numpy(zero_copy_only=False)
    short = words.filter(pa.array(rest & (width <= SHORT)))
    if len(short):
        _, offsets, text = short.buffers()
        bounds = np.frombuffer(offsets, np.int32)[short.offset : short.offset + len(short) + 1]
        sizes[rest & (width <= SHORT)] = side_by_side(np.frombuffer(text, np.uint8)[bounds[0] : bounds[-1]], np.diff(bounds).astype(np.int64), table)
    for i in np.flatnonzero(rest & (width > SHORT)).tolist():
        sizes[i] = len(merged(words[i].as_py(), ranks))
    return sizes


def size_function(ranks: dict[bytes, int], common: int = COMMON, many: int = STEP):
    """An Arrow function from the words of texts to the texts' numbers of tokens, of many words in a step; common of them merge at a time."""
    table, tokens = pair_table(ranks), list(ranks)

    @F.arrow_udf("long")
    def sizes(texts: pa.Array) -> pa.Array:
        found, starts, vocabulary = texts.flatten(), texts.offsets.to_numpy(), pa.array(tokens, pa.binary())
        totals = np.zeros(len(found) + 1, np.int64)
        for at in range(0, len(found), many):
            step = found.slice(at, many).dictionary_encode()
            own = np.concatenate([sizes_of(step.dictionary.slice(i, common), ranks, table, vocabulary) for i in range(0, len(step.dictionary), common)])
            totals[at + 1 : at + 1 + len(step)] = own[step.indices.to_numpy()]
        np.cumsum(totals, out=totals)
        return pa.array(np.diff(totals[starts - starts[0]]))

    return sizes


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), F.lit(0))


def token_counts(rows: DataFrame, ranks: dict[bytes, int], id_column: str = "doc_id", text_column: str = "text", common: int = COMMON) -> DataFrame:
    """Of rows: the id and n_tokens, one row for each."""
    return rows.select(id_column, size_function(ranks, common)(words(F.col(text_column))).alias("n_tokens"))


def token_sizes(ranks: dict[bytes, int], kept: int = 1 << 16):
    """A token counter for the chunker: array<string> to array<int>; frequent words are merged once a task."""

    @F.pandas_udf("array<int>")
    def sizes(batch):
        import pandas as pd
        import regex

        pattern, known = regex.compile(WORDS.removeprefix("(?U)")), {}

        def size(text: str) -> int:
            total = 0
            for word in pattern.findall(text):
                n = known.get(word)
                if n is None:
                    if len(known) >= kept:
                        known.clear()
                    n = known[word] = len(merged(word.encode("utf-8", "surrogatepass"), ranks))
                total += n
            return total

        return pd.Series([None if row is None else [size(t) for t in row] for row in batch])

    return sizes
