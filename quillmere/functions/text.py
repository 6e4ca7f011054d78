"""Text expressions: cleaning, sentences, tokens, truncation and light markdown, all Column to Column."""

from __future__ import annotations

from typing import TYPE_CHECKING
from unicodedata import is_normalized, normalize

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

if TYPE_CHECKING:
    from collections.abc import Callable

#: The token pattern, the sentence border, and white space as Unicode has it.
TOKEN = r"[a-z0-9]+(?:[-/][a-z0-9]+)*"
BORDER = r"(?U)(?<=[.!?])\s+"
EDGES = r"(?U)^\s+|\s+$"
CONTROLS = r"[\p{Cc}&&[^\n\t]]"


#: Bytes of an Arrow batch that become Python objects at once, and rows at most.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 1024


def sliced(batch: pa.Array, made: Callable[[list], pa.Array], kind: pa.DataType) -> pa.Array:
    """What made gives of a batch's rows, slice by slice: a batch may hold 64 MB, and Python objects take several times that."""
    rows = max(1, min(SLICE_ROWS, len(batch) * SLICE_BYTES // max(1, batch.nbytes)))
    parts = [made(batch.slice(at, rows).to_pylist()) for at in range(0, len(batch), rows)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@F.arrow_udf(StringType())
def nfkc(text: pa.Array) -> pa.Array:
    """Compatibility composition; Spark has no expression for it."""
    composed = lambda rows: pa.array([t if t is None or is_normalized("NFKC", t) else normalize("NFKC", t) for t in rows], pa.string())
    return sliced(text, composed, pa.string())


def strip_controls(text: Column) -> Column:
    return F.regexp_replace(text, CONTROLS, "")


def clean(text: Column) -> Column:
    """Normalised, then without control characters but line feeds and tabs."""
    return strip_controls(nfkc(text))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def is_blank(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)) == 0, F.lit(True))


def sentences(text: Column) -> Column:
    """Pieces between closing punctuation and white space, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, BORDER), strip), lambda s: s != "")


def word_tokens(text: Column) -> Column:
    """Number of words between white space: the default token counter, in place of a subword vocabulary."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def word_sizes(texts: Column) -> Column:
    """The default token counter of an array of texts; any function from array<string> to array<int> can stand for it."""
    return F.transform(texts, word_tokens)


def keyword_tokens(text: Column) -> Column:
    """Lower-case tokens of two characters or more; part numbers such as a320-200 or p/n stay whole."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: F.length(t) >= 2)


def truncated(text: Column, limit: int) -> Column:
    return F.concat(F.left(text, F.lit(limit)), F.when(F.length(text) > limit, "... [truncated]").otherwise(""))


def excerpt(text: Column, limit: int = 200) -> Column:
    return F.concat(F.left(text, F.lit(limit)), F.when(F.length(text) > limit, "...").otherwise(""))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def shown_name(name: Column) -> Column:
    """The file name of a source as clients show it: without a leading image mark, and without folders."""
    return basename(F.regexp_replace(name, r"^\[Image\] ", ""))


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^a-zA-Z0-9_\-.]", "_")


def strip_markdown(text: Column) -> Column:
    """Without bold, italics, headings and bullets; stars go first, so only - and + remain as bullets."""
    out = F.regexp_replace(F.replace(text, F.lit("**"), F.lit("")), r"\*", "")
    return F.regexp_replace(F.regexp_replace(out, r"(?m)^#+\s", ""), r"(?m)^\s*[-+]\s", "")


def markdown_list(text: Column) -> Column:
    """Indented lines become list items, with a blank line before and after each list."""
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")

    def marked(line: Column) -> Column:
        body = trimmed(line)
        item = line.rlike(r"^\s{2,}") & (body != "") & ~body.startswith("-") & ~body.startswith("*")
        return F.struct(line.alias("line"), body.alias("body"), item.alias("item"))

    def shown(lines: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            last = F.get(lines, i - 1)
            opens = x["item"] & (i > 0) & ~last["item"] & (last["body"] != "")
            closes = ~x["item"] & F.coalesce(last["item"], F.lit(False)) & (x["body"] != "")
            own = F.when(x["item"], F.concat(F.lit("- "), x["body"])).otherwise(x["line"])
            return F.when(opens | closes, F.array(F.lit(""), own)).otherwise(F.array(own))

        return F.array_join(F.flatten(F.transform(lines, one)), "\n")

    return F.transform(F.array(F.transform(F.split(text, "\n"), marked)), shown)[0]


def percent(share: Column) -> Column:
    """Rounded half up."""
    return F.floor(share * 100 + 0.5)


def relative_age(then: Column, now: Column) -> Column:
    hours = F.floor((F.unix_micros(now) - F.unix_micros(then)) / 3_600_000_000).cast("long")
    days = F.floor(hours / 24).cast("long")
    return (
        F.when(hours < 1, "Just now")
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .when(days == 1, "Yesterday")
        .otherwise(F.concat(days.cast("string"), F.lit("d ago")))
    )


#: The words that ask for an image.
INTENT = ("figure", "diagram", "image", "screenshot", "shown", "picture")


def wants_image(query: Column) -> Column:
    low = F.lower(query)
    return F.exists(F.array(*map(F.lit, INTENT)), lambda k: F.contains(low, k))
