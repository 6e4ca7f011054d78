"""From queries to answers: search, gate, prompt, generate, and list sources, for all queries of a frame at once."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from dataclasses import dataclass, replace

from .config import Config, load
from .functions.text import is_blank
from .operators.prompts import rag_prompts, source_rows, sources_footer
from .operators.retrieval import gated, hybrid_search, known
from .operators.store import Store
from .providers import Embedder, Generator, answered, embedding, generated
from .sources.files import image_bytes

if TYPE_CHECKING:
    from pyspark.sql import Column, DataFrame, SparkSession


def valid_queries(queries: DataFrame) -> DataFrame:
    return queries.where(~is_blank(F.col("query")))


def search(store: Store, queries: DataFrame, include_images: bool = True, model: Embedder | None = None, c: Config = Config()) -> tuple[DataFrame, DataFrame | None]:
    """The text and the gated image results of each query, by the store's metric; the image branch is not planned where it is not wanted."""
    c = replace(c, retrieval=replace(c.retrieval, metric=store.metric))
    asked = known(valid_queries(queries).withColumn("embedding", embedding(F.col("query"), model)))
    texts = hybrid_search(asked, store.read("text_chunks"), c.retrieval.top_k_final, c.retrieval)
    if not include_images:
        return texts, None
    images = hybrid_search(asked, store.read("image_descriptions"), c.retrieval.top_k_images, c.retrieval)
    return texts, gated(images, c.retrieval.image_gate)


def answers(store: Store, queries: DataFrame, include_images: bool = True, domain: str = "general", generator: Generator | None = None, model: Embedder | None = None, c: Config = Config(), image_folder: str | None = None) -> DataFrame:
    """query_id, query, answer, error (null unless the model failed), sources, timestamp. Blank queries are left out.

    With image_folder, the files of the images found go to the model with the prompt.
    """
    texts, images = search(store, queries, include_images, model, c)
    asked = valid_queries(queries)
    prompts = rag_prompts(asked, texts, images, domain, c.prompting)
    if images is not None and image_folder:
        pictures = image_bytes(store.spark, images, image_folder, c.prompting.max_image_results)
        prompts = prompts.join(pictures, "query_id", "left")
        replies = prompts.withColumn("reply", answered(F.col("user_prompt"), F.col("system_prompt"), F.col("images"), generator, max_tokens=2048))
    else:
        replies = prompts.withColumn("reply", generated(F.col("user_prompt"), F.col("system_prompt"), generator, max_tokens=2048))
    rows = source_rows(texts, images, c.prompting)
    shown = F.struct("isImage", "position", "documentName", "pageNumber", "relevance", "excerpt", "fullText", "imagePath")
    listed = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(shown)).alias("sources"))
    out = asked.join(replies.select("query_id", F.col("reply.text").alias("answer"), F.col("reply.error").alias("error")), "query_id").join(listed, "query_id", "left")
    return out.select("query_id", "query", "answer", "error", F.coalesce("sources", F.array().cast(listed.schema["sources"].dataType)).alias("sources"), F.current_timestamp().alias("timestamp"))


def with_footer(answered: DataFrame, texts: DataFrame, images: DataFrame | None) -> DataFrame:
    """Answers followed by their numbered sources."""
    footers = sources_footer(texts, images)
    return answered.join(footers, "query_id", "left").withColumn("answer", F.concat("answer", F.coalesce("footer", F.lit("")))).drop("footer")


@dataclass(frozen=True)
class Engine:
    """A store with content, its configuration and its models."""

    store: Store
    config: Config
    embedder: Embedder | None = None
    generator: Generator | None = None

    def search(self, queries: DataFrame, include_images: bool = True) -> tuple[DataFrame, DataFrame | None]:
        return search(self.store, queries, include_images, self.embedder, self.config)

    def answers(self, queries: DataFrame, include_images: bool = True, domain: str = "general", image_folder: str | None = None) -> DataFrame:
        return answers(self.store, queries, include_images, domain, self.generator, self.embedder, self.config, image_folder)

    def health(self) -> dict:
        return health(self.store)


def engine(spark: SparkSession, folder: str, config_path: str | None = None, embedder: Embedder | None = None, generator: Generator | None = None) -> Engine:
    """Opens a store and reads its configuration; raises ValueError where there is no store, or nothing in it."""
    if not Store.exists(spark, folder):
        raise ValueError(f"no store at {folder}; ingest documents first")
    store = Store(spark, folder)
    store.require_content()
    return Engine(store, load(config_path) if config_path else Config(), embedder, generator)


def health(store: Store | None) -> dict:
    """status, message, and the counts of the collections."""
    if store is None:
        return {"status": "error", "message": "The engine is not initialised", "vectorDBStats": None}
    n = {r.collection: r.n for r in store.counts().collect()}
    return {"status": "healthy", "message": "Ready", "vectorDBStats": {"textChunks": n["text_chunks"], "images": n["image_descriptions"]}}


def error_text(status: Column) -> Column:
    """What a client shows for a failed request, by its HTTP status."""
    return (
        F.when(status.isNull(), "The server cannot be reached. Check that it is running.")
        .when(status == 503, "The server is still starting. Try again in a moment.")
        .otherwise("The request failed. Try again.")
    )
