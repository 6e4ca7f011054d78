"""Times the headline queries: prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from quillmere.plans import catalogue

HEADLINE = (
    "hybrid_search", "hybrid_rerank", "knn_cosine", "knn_l2", "bm25_candidates", "semantic_chunks", "token_chunks", "adjacent_similarity", "sentences", "bm25_tokens", "rag_prompt",
    "query_sources", "image_dedup", "eval_embedding_scores", "json_extract_direct", "format_markdown_list",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    catalogue.QUERIES["sentences"](spark, sf_dir).limit(1).collect()  # starts the JVM's and Python's workers
    took = {}
    for name in names:
        began = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
