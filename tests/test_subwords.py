"""Byte-level BPE counts against a plain version and the library."""

import base64
import random

import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from quillmere.operators import subwords
from quillmere.plans.text_queries import VOCABULARY

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TEXTS = [
    "Hello world, it's a test!  Two spaces\n\n\nlines\tand tabs ", None, "", " ", "\n", "naïve café 日本語テキスト 🙂🙂 don't we'll", "x" * 3000, "ab" * 5000, "1234567890 12.5%", "a b c", "\x00\x01", "'s't'", "trailing   ",
    "word " * 2000, "aaaaaaaaaaaaaaaaaaaaa",
]


@pytest.fixture(scope="module")
def ranks(spark):
    return subwords.ranks_of(spark, VOCABULARY)


def plain_tokens(word, ranks):
    """Merges the pair of the least rank, the leftmost first, until none is left."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return parts
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merges(ranks):
    r = random.Random(1)
    words = ["".join(r.choice("abcdeé日 '1") for _ in range(r.randint(1, 40))).encode() for _ in range(600)] + [b"a" * k for k in range(1, 40)] + [bytes(range(256))]
    for word in words:
        assert subwords.merged(word, ranks) == ([word] if word in ranks else plain_tokens(word, ranks))
    assert len(subwords.merged(b"ab" * 200_000, ranks)) > 1000  # without a break, in n log n steps


@pytest.mark.parametrize("common", [1, 5, subwords.COMMON])
def test_counts_equal_the_library(spark, ranks, common):
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("word", F.lit("clash")).repartition(3)
    found = {x.doc_id: x.n_tokens for x in subwords.token_counts(docs, ranks, common=common).collect()}
    expected = {i: sum(len(plain_tokens(w.encode(), ranks)) if len(w) < 400 else len(library.encode_ordinary(w)) for w in regex.findall(PATTERN, t or "")) for i, t in enumerate(TEXTS)}
    assert found == expected == {i: len(library.encode_ordinary(t or "")) for i, t in enumerate(TEXTS)}
    assert subwords.token_counts(docs.where("false"), ranks).count() == 0


def test_counter_of_the_chunker(spark, ranks):
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = spark.createDataFrame([([t for t in TEXTS if t is not None],), (None,), ([],)], "x array<string>")
    sizes = [r.s for r in rows.select(subwords.token_sizes(ranks, kept=3)("x").alias("s")).collect()]
    assert sizes == [[len(library.encode_ordinary(t)) for t in TEXTS if t is not None], None, []]


def test_vocabulary(ranks):
    lines = [x.split() for x in open(VOCABULARY, "rb").read().splitlines()]
    assert ranks == {base64.b64decode(a): int(b) for a, b in lines}


def test_counts_take_one_pass(spark, ranks, capsys):
    docs = spark.createDataFrame([(1, "Hello wurld"), (1, "Hello wurld"), (None, "xqzzy"), (2, None)], "doc_id long, text string")
    counts = subwords.token_counts(docs, ranks)
    counts.explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and plan.count("regexp_extract_all(") == 1
    sizes = [sum(len(plain_tokens(w.encode(), ranks)) for w in regex.findall(PATTERN, t)) for t in ("Hello wurld", "xqzzy")]
    assert sorted(counts.collect(), key=str) == sorted([(1, sizes[0]), (1, sizes[0]), (None, sizes[1]), (2, 0)], key=str)  # rows of one id stay apart


def test_steps_cut_texts_anywhere(spark, ranks):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)
    sized = [docs.select("doc_id", subwords.size_function(ranks, *steps)(subwords.words(F.col("text"))).alias("n")).collect() for steps in ((2, 3), (7, 50), (1 << 15, 1 << 22))]
    assert sized[0] == sized[1] == sized[2]


@pytest.mark.parametrize("known", [{}, {b"a": 7}, {b"ab": 0, b"abab": 1, b"b": 2, b"ba": 5, b"aba": 3, b"xyz": 4}])
def test_words_side_by_side(ranks, known):
    r = random.Random(2)
    words = ["".join(r.choice("abxyzé日 '1") for _ in range(r.randint(1, 30))) for _ in range(800)] + ["a" * k for k in range(60, 70)] + ["xyz", "ab" * 32, "ab" * 33, "日" * 21, "日" * 22]
    for table in (known, ranks):
        sizes = subwords.sizes_of(pa.array(words)[1:], table, subwords.pair_table(table), pa.array(list(table), pa.binary()))
        assert sizes.tolist() == [1 if w.encode() in table else len(plain_tokens(w.encode(), table)) for w in words[1:]]
