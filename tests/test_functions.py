"""Edge cases that the shipped tables do not reach."""

import json

import pytest
from pyspark.sql import functions as F

from quillmere.functions import text as T
from quillmere.functions import vectors as V
from quillmere.functions.replies import context_texts, judged


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}")


def got(spark, value, f, kind="string"):
    return one(spark, value, kind).select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("text", "expected"), [("a\x01b\tc\nd\x85e", "ab\tc\nde"), ("ﬁnger", "finger"), (None, None), ("", "")])
def test_clean(spark, text, expected):
    assert got(spark, text, T.clean) == expected


def test_sentences(spark):
    assert got(spark, "A b.  C d!\nE? F", T.sentences) == ["A b.", "C d!", "E?", "F"]
    assert got(spark, "a. b", T.sentences) == ["a.", "b"]
    assert got(spark, "  ", T.sentences) == []


def test_tokens(spark):
    assert got(spark, "P/N A320-200 x I/O amm-27-00-00 Vibrato- détaché", T.keyword_tokens) == ["p/n", "a320-200", "i/o", "amm-27-00-00", "vibrato", "tach"]


def test_excerpt_and_truncation(spark):
    assert got(spark, "a" * 200, T.excerpt) == "a" * 200
    assert got(spark, "a" * 201, T.excerpt) == "a" * 200 + "..."
    assert got(spark, "abc", lambda x: T.truncated(x, 2)) == "ab... [truncated]"


@pytest.mark.parametrize(("share", "expected"), [(0.845, 85), (0.145, 14)])
def test_percent(spark, share, expected):
    assert got(spark, share, T.percent, "double") == expected


def test_relative_age(spark):
    now = F.lit("2025-01-10 00:00:00").cast("timestamp")
    times = {"2025-01-09 23:30:00": "Just now", "2025-01-09 20:00:00": "4h ago", "2025-01-08 22:00:00": "Yesterday", "2025-01-05 00:00:00": "5d ago"}
    for then, expected in times.items():
        assert got(spark, then, lambda x: T.relative_age(x.cast("timestamp"), now)) == expected


def test_names(spark):
    assert got(spark, "/a/b c/Ä x.pdf", lambda x: T.safe_name(T.basename(x))) == "__x.pdf"


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0], [3.0, 4.0])], "a array<float>, z array<float>, b array<float>")
    r = df.select(V.cosine(F.col("a"), F.col("z")), V.cosine(F.col("a"), F.col("b")), V.l2_distance(F.col("a"), F.col("b")), V.ip_distance(F.col("a"), F.col("b"))).first()
    assert tuple(r) == pytest.approx((0.0, 0.6, 20.0, -2.0))


REPLIES = [
    ('{"total_claims": 3, "supported_claims": 2, "evidence": [ {"cl', "faithfulness_score", 2 / 3),
    ('{"total_claims": 3, "supported_claims": 2, "evidence": [ {"claim": "a"}, {"cl', "faithfulness_score", None),
    ('{"relevant_count": 1, "partial_count": 2, "irrelevant_count": 1, "x": [', "context_relevancy_score", 0.5),
    ('{"relevant_count": 0, "partial_count": 0, "irrelevant_count": 0, "x": [', "context_relevancy_score", None),
    ('```json\n{"faithfulness_score": 0.5}\n```', "faithfulness_score", 0.5),
    ('text ```\n{"faithfulness_score": 0.25}\n``` more', "faithfulness_score", 0.25),
    ('so {"a": {"b": 1}, "faithfulness_score": 1} and', "faithfulness_score", 1.0),
    ('"faithfulness_score": 1.2.3, "x', "faithfulness_score", None),
    ("nothing", "faithfulness_score", None),
    ("", "faithfulness_score", None),
    (None, "faithfulness_score", None),
]


@pytest.mark.parametrize(("reply", "field", "expected"), REPLIES)
def test_judged(spark, reply, field, expected):
    found = got(spark, reply, judged)
    assert (found and found[field]) == (expected if expected is None else pytest.approx(expected))


def test_questions(spark):
    assert got(spark, json.dumps({"questions": ["a", "b"]}), judged).questions == ["a", "b"]
    assert got(spark, '{"questions": ["a", "b"], "x": {', judged).questions == ["a", "b"]


def test_context_texts(spark):
    rows = [("", " t "), ("c", "d"), (None, None), ("  ", "x")]
    assert got(spark, rows, context_texts, "array<struct<content:string,text:string>>") == ["t", "c"]
