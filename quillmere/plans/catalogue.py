"""The registered queries and their SQL."""

from . import answer_queries, retrieval_queries, text_queries

MODULES = [text_queries, retrieval_queries, answer_queries]
FLAGSHIP = "hybrid_search"
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
