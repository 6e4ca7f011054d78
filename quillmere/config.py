"""Defaults of the pipeline, and reading them from YAML."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Chunking:
    max_tokens: int = 512
    min_tokens: int = 180
    threshold: float = 0.6
    overlap: int = 30


@dataclass(frozen=True)
class Retrieval:
    semantic_weight: float = 0.7
    top_k_candidates: int = 40
    top_k_final: int = 10
    top_k_images: int = 3
    image_gate: float = 0.05
    metric: str = "cosine"


@dataclass(frozen=True)
class Prompting:
    max_chunk_chars: int = 2000
    max_image_chars: int = 2000
    context_budget: int = 16000
    max_text_results: int = 5
    max_image_results: int = 3
    excerpt_chars: int = 200
    least_image_budget: int = 100


@dataclass(frozen=True)
class Images:
    top_margin: float = 0.1
    bottom_margin: float = 0.1
    min_width: int = 100
    min_height: int = 100
    color_threshold: int = 1
    max_colors: int = 1024
    dpi: int = 150


@dataclass(frozen=True)
class Evaluation:
    max_contexts: int = 5
    relevancy_contexts: int = 8
    max_context_chars: int = 1000
    relevancy_budget: int = 8000
    max_answer_chars: int = 2000
    max_claims: int = 8
    questions: int = 3


@dataclass(frozen=True)
class Config:
    chunking: Chunking = Chunking()
    retrieval: Retrieval = Retrieval()
    prompting: Prompting = Prompting()
    images: Images = Images()
    evaluation: Evaluation = Evaluation()


def load(path: str) -> Config:
    """Reads YAML; sections and keys that are unknown are ignored, missing ones keep their defaults."""
    import yaml

    given, out = yaml.safe_load(Path(path).read_text()) or {}, Config()
    for section in fields(Config):
        values = given.get(section.name) or {}
        part = getattr(out, section.name)
        known = {f.name: values[f.name] for f in fields(part) if f.name in values}
        out = replace(out, **{section.name: replace(part, **known)})
    return out
