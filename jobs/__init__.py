"""Runnable jobs: each reads tables with Spark's readers, uses the library, and writes partitioned tables."""
