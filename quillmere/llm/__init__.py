"""Training-data operators: filtering, deduplication, mixing, tokenising and scanning of text.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
