"""Evaluation: judge prompts, scores from replies, embedding fallbacks and the summary."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Evaluation
from ..functions.replies import bare, context_texts, judged
from ..functions.text import is_blank, sliced
from ..functions.vectors import dot, norm
from ..providers import Embedder, Generator, HashedEmbedder, embedding, generated, vectors_of

METRICS = ("faithfulness_score", "answer_relevancy_score", "context_relevancy_score")


def numbered(contexts: Column, count: int, chars: int, bracket: bool) -> Column:
    label = (lambda i: F.concat(F.lit("[Context "), i.cast("string"), F.lit("]:\n"))) if bracket else (lambda i: F.concat(F.lit("Context "), i.cast("string"), F.lit(":\n")))
    cut = F.transform(F.slice(contexts, 1, count), lambda x, i: F.concat(label(i + 1), F.left(x, F.lit(chars))))
    return F.array_join(cut, "\n---\n")


def within_budget(contexts: Column, count: int, chars: int, budget: int) -> Column:
    """The first contexts, cut to chars, whose running length stays within budget."""
    cut = F.transform(F.slice(contexts, 1, count), lambda x: F.left(x, F.lit(chars)))

    def take(at: Column, x: Column) -> Column:
        fits = at["open"] & (at["used"] + F.length(x) <= budget)
        more = F.struct(F.lit(True).alias("open"), (at["used"] + F.length(x)).alias("used"), F.concat(at["taken"], F.array(x)).alias("taken"))
        return F.when(fits, more).otherwise(F.struct(F.lit(False).alias("open"), at["used"].alias("used"), at["taken"].alias("taken")))

    begin = F.struct(F.lit(True).alias("open"), F.lit(0).alias("used"), F.array().cast("array<string>").alias("taken"))
    return F.aggregate(cut, begin, take)["taken"]


def faithfulness_prompt(answer: Column, contexts: Column, c: Evaluation = Evaluation()) -> Column:
    return F.concat(
        F.lit("Judge how far the answer rests on the contexts.\n\n**Contexts:**\n"), numbered(contexts, c.max_contexts, c.max_context_chars, False),
        F.lit("\n\n**Answer:**\n"), F.left(answer, F.lit(c.max_answer_chars)),
        F.lit(f'\n\nSplit the answer into at most {c.max_claims} claims and reply with JSON only: {{"total_claims": n, "supported_claims": n, "faithfulness_score": x, "evidence": []}}'),
    )


def questions_prompt(answer: Column, c: Evaluation = Evaluation()) -> Column:
    return F.concat(F.lit(f"Write {c.questions} specific questions that this text answers.\n\n**Text:**\n"), F.left(answer, F.lit(1000)), F.lit('\n\nReply with JSON only: {"questions": []}'))


def relevancy_prompt(query: Column, contexts: Column, c: Evaluation = Evaluation()) -> Column:
    some = within_budget(contexts, c.relevancy_contexts, c.max_context_chars, c.relevancy_budget)
    return F.concat(
        F.lit("Judge how far each context helps to answer the query.\n\n**Query:**\n"), query, F.lit("\n\n**Contexts:**\n"),
        numbered(some, c.relevancy_contexts, c.max_context_chars, True),
        F.lit('\n\nReply with JSON only: {"relevant_count": n, "partial_count": n, "irrelevant_count": n, "context_relevancy_score": x}'),
    )


def similarity_score(anchor: Column, vectors: Column) -> Column:
    """Mean of (cosine + 1) / 2 over the vectors that have a length; 0.5 without an anchor or any."""
    some = F.filter(vectors, lambda v: norm(v) > 0)
    total = F.aggregate(some, F.lit(0.0), lambda a, v: a + (dot(anchor, v) / (norm(anchor) * norm(v)) + 1) / 2)
    return F.when((norm(anchor) > 0) & (F.size(some) > 0), total / F.size(some)).otherwise(F.lit(0.5))


def embedded(texts: Column, model: Embedder | None = None) -> Column:
    """array<array<double>> of an array of texts."""
    model = model or HashedEmbedder()

    kind = pa.list_(pa.list_(pa.float64()))

    def vectors(rows: list[list[str] | None]) -> pa.Array:
        texts = [t for row in rows for t in row or []]
        ends = np.concatenate([[0], np.cumsum([len(row or []) for row in rows])]).astype(np.int32)
        found = vectors_of(model, texts) if texts else pa.array([], kind.value_type)
        return pa.ListArray.from_arrays(pa.array(ends), found)

    @F.arrow_udf("array<array<double>>")
    def run(batch: pa.Array) -> pa.Array:
        return sliced(batch, vectors, kind)

    return run(texts)


def embedding_scores(triplets: DataFrame, c: Evaluation = Evaluation(), model: Embedder | None = None) -> DataFrame:
    """triplets (query, answer, texts) with the embedding fallbacks of faithfulness and context relevancy."""
    rows = triplets.withColumn("__a", embedding(F.col("answer"), model)).withColumn("__q", embedding(F.col("query"), model))
    rows = rows.withColumn("__c", embedded(F.slice("texts", 1, max(c.max_contexts, c.relevancy_contexts)), model))
    faithful = F.when(is_blank(F.col("answer")) | (F.size("texts") == 0), 0.0).otherwise(similarity_score(F.col("__a"), F.slice("__c", 1, c.max_contexts)))
    relevant = F.when(F.size("texts") == 0, 0.0).otherwise(similarity_score(F.col("__q"), F.slice("__c", 1, c.relevancy_contexts)))
    return rows.withColumn("faithfulness_score", faithful).withColumn("context_relevancy_score", relevant).drop("__a", "__q", "__c")


def answer_relevancy(reply: Column, questions: Column, anchor: Column, vectors: Column) -> Column:
    """Of a reply (text, error) with its questions and the vectors of these and of the query."""
    failed = reply["error"].isNotNull() | bare(reply["text"])
    return F.when(failed, 0.5).when(questions.isNotNull(), similarity_score(anchor, vectors))


def zipped(queries: DataFrame, answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """Triplets by position from (position, query), (position, answer) and (position, contexts).

    Raises ValueError where the three differ in number or positions.
    """
    sizes = [df.count() for df in (queries, answers, contexts)]
    out = queries.join(answers, "position").join(contexts, "position")
    if len(set(sizes)) > 1 or out.count() != sizes[0]:
        raise ValueError(f"queries, answers and contexts differ: {sizes}")
    return out


def evaluated(triplets: DataFrame, judge: Generator | None = None, model: Embedder | None = None, c: Evaluation = Evaluation()) -> DataFrame:
    """triplets (query, answer, contexts) with the three scores and num_contexts.

    With a judge, its replies give the scores and embeddings stand in where a reply gives none; without, embeddings do.
    The answer relevancy of a reply without questions is null; where the judge fails, or its reply is a bare number, 0.5.
    """
    rows = embedding_scores(triplets.withColumn("texts", context_texts(F.col("contexts"))), c, model).withColumn("num_contexts", F.size("texts"))
    if judge is None:
        return rows.withColumn("answer_relevancy_score", F.when(is_blank(F.col("answer")), 0.0).cast("double")).drop("texts")
    ask = lambda prompt: generated(prompt, F.lit(""), judge)["text"]
    rows = rows.withColumn("__f", ask(faithfulness_prompt(F.col("answer"), F.col("texts"), c))).withColumn("__f", judged(F.col("__f")))
    rows = rows.withColumn("__g", generated(questions_prompt(F.col("answer"), c), F.lit(""), judge, temperature=0.0, max_tokens=400))
    rows = rows.withColumn("__q", judged(F.col("__g.text"))).withColumn("__r", ask(relevancy_prompt(F.col("query"), F.col("texts"), c))).withColumn("__r", judged(F.col("__r")))
    some = (F.size("texts") > 0) & ~is_blank(F.col("answer"))
    rows = rows.withColumn("faithfulness_score", F.when(some, F.coalesce("__f.faithfulness_score", "faithfulness_score")).otherwise(0.0))
    rows = rows.withColumn("context_relevancy_score", F.when(F.size("texts") > 0, F.coalesce("__r.context_relevancy_score", "context_relevancy_score")).otherwise(0.0))
    rows = rows.withColumn("__e", embedded(F.col("__q.questions"), model)).withColumn("__v", embedding(F.col("query"), model))
    asked = answer_relevancy(F.col("__g"), F.col("__q.questions"), F.col("__v"), F.col("__e"))
    rows = rows.withColumn("answer_relevancy_score", F.when(is_blank(F.col("answer")), 0.0).otherwise(asked))
    return rows.drop("__f", "__g", "__q", "__r", "__e", "__v", "texts")


def summary(results: DataFrame) -> DataFrame:
    """One row: number of results, and mean and population deviation of each score; null scores are left out."""
    parts = [p for m in METRICS for p in (F.round(F.avg(m), 6).alias(f"{m}_mean"), F.round(F.stddev_pop(m), 6).alias(f"{m}_std"))]
    return results.agg(F.count("*").alias("n"), *parts)
