"""Reading judges' replies: JSON in the open, in fences, cut off, or only counts."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

if TYPE_CHECKING:
    from collections.abc import Callable

#: A brace object with one level of nesting, the scores and the counts that replies name.
OBJECT = r"(?s)\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\}"
SCORES = ("faithfulness_score", "answer_relevancy_score", "context_relevancy_score")
COUNTS = ("total_claims", "supported_claims", "relevant_count", "partial_count", "irrelevant_count")


def fenced(text: Column, fence: str) -> Column:
    """What stands between a fence and the next plain one; null without the fence."""
    after = F.get(F.split(text, fence), F.lit(1))
    return F.when(F.contains(text, F.lit(fence)), strip(F.get(F.split(after, "```"), F.lit(0))))


def parsed(text: Column) -> Column:
    """The first of: the whole text, a json fence, any fence, the first object that parses; as variant, else null."""

    def first(whole: Column) -> Column:
        objects = F.filter(F.regexp_extract_all(whole, F.lit(OBJECT), F.lit(0)), lambda m: F.try_parse_json(m).isNotNull())
        return F.coalesce(
            F.try_parse_json(whole), F.try_parse_json(fenced(whole, "```json")), F.try_parse_json(fenced(whole, "```")), F.try_parse_json(F.get(objects, F.lit(0)))
        )

    return once(strip(text), first)


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of the value, which is evaluated once a row however often then names it."""
    return F.transform(F.array(value), then)[0]


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom)


def bare(text: Column) -> Column:
    """Whether a reply parses as a number other than 0 or as true: something that can't be asked for fields."""
    return once(parsed(text), _bare)


def _bare(value: Column) -> Column:
    scalar = F.schema_of_variant(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)")
    return F.coalesce(scalar & (F.try_variant_get(value, "$", "string").try_cast("double").isNull() | (F.try_variant_get(value, "$", "double") != 0)) & (F.try_variant_get(value, "$", "string") != "false"), F.lit(False))


def judged(text: Column) -> Column:
    """struct of scores, counts and questions; null where the reply gives nothing.

    A reply that parses counts as it is, even if it lacks a score. Otherwise fields are searched one by one, and missing
    scores are derived from the counts.
    """
    return once(parsed(text), lambda value: _judged(text, value))


def _judged(text: Column, value: Column) -> Column:
    found = lambda name, pattern: F.get(F.regexp_extract_all(text, F.lit(f'"{name}"\\s*:\\s*({pattern})'), F.lit(1)), F.lit(0))
    score = {s: found(s, r"[\d.]+").try_cast("double") for s in SCORES}
    count = {c: found(c, r"\d+").try_cast("int") for c in COUNTS}
    claims = ratio(count["supported_claims"], count["total_claims"])
    all_three = count["relevant_count"] + count["partial_count"] + count["irrelevant_count"]
    context = ratio(count["relevant_count"] + 0.5 * count["partial_count"], all_three)
    score["faithfulness_score"] = F.coalesce(score["faithfulness_score"], claims)
    score["context_relevancy_score"] = F.coalesce(score["context_relevancy_score"], context)
    asked = F.regexp_extract_all(F.regexp_extract(text, r'(?s)"questions"\s*:\s*\[(.*?)\]', 1), F.lit('"([^"]+)"'), F.lit(1))
    loose = F.struct(*(c.alias(n) for n, c in (score | count).items()), F.when(F.size(asked) > 0, asked).alias("questions"))
    strict = F.struct(
        *(F.try_variant_get(value, f"$.{s}", "double").alias(s) for s in SCORES),
        *(F.try_variant_get(value, f"$.{c}", "int").alias(c) for c in COUNTS),
        F.try_variant_get(value, "$.questions", "array<string>").alias("questions"),
    )
    nothing = F.lit(True)
    for c in [*score.values(), F.when(F.size(asked) > 0, asked)]:
        nothing = nothing & c.isNull()
    return F.when(value.isNotNull(), strict).when(~nothing, loose)


def context_texts(contexts: Column) -> Column:
    """Of array<struct<content,text>>: content, or text where that is empty; stripped, without blank ones."""
    return F.filter(F.transform(contexts, lambda c: strip(F.coalesce(F.nullif(c["content"], F.lit("")), c["text"]))), lambda s: s.isNotNull() & (s != ""))
