"""The jobs' configuration files, their command lines, and sessions."""

from __future__ import annotations

import argparse
import logging
import tomllib
from dataclasses import fields
from pathlib import Path


def load(kind, path: str | None = None):
    """An instance of the settings class `kind`, by the TOML file at path; missing keys keep their defaults, unknown ones are an error."""
    given = tomllib.loads(Path(path).read_text()) if path else {}
    if unknown := set(given) - {f.name for f in fields(kind)}:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return kind(**given)


def arguments(text: str, *names: str) -> argparse.Namespace:
    """The paths that a job takes, and its configuration file."""
    parser = argparse.ArgumentParser(description=text)
    for name in names:
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return parser.parse_args()
