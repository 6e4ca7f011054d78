"""Quillmere: document retrieval and grounded question answering as Spark DataFrame plans."""

__version__ = "0.1.0"
