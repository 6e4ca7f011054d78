r"""Fill-in-the-middle: a text is cut into prefix, middle and suffix at token boundaries and its parts are reordered.

Tokens are `[A-Za-z]+|[^A-Za-z]`, matched left to right: a run of letters, or one other code point. A token starts at every
byte that is no continuation byte, unless it is a letter after a letter; so tokens are counted on bytes, in windows of
``WINDOW`` bytes. While counting, a sparse index is kept: the byte and the code-point offset of every ``EVERY``-th token.
A cut after k tokens is found by binary search in that index and a short scan from the checkpoint before it, which stops at
the next one; no list of all tokens is ever held. The cuts come from the text's id alone, so reruns agree, and any part is
recovered from the output by the markers, which the text itself must not hold.

Cases: null is an empty text; an empty text, and one that holds a marker, stay plain; a null id hashes as an empty one;
repeated rows are cut alike, and equal texts with different ids differently; where both cuts are equal the middle is
empty; a very long text takes ``WINDOW`` bytes of work arrays and 16 bytes for every ``EVERY`` tokens; an empty table stays
empty; other columns are kept, and columns with the names that are added are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVERY, WINDOW = 256, 1 << 20
MARKERS = ("<P>", "<S>", "<M>")
#: Of a hundred texts, so many stay plain, and of a hundred others so many put the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
CUTS = "struct<n:bigint,prefix_chars:bigint,middle_chars:bigint>"

#: Kinds of bytes: 0 other, 1 letter, 2 continuation of a code point.
KIND = np.zeros(256, dtype=np.uint8)
KIND[[*range(65, 91), *range(97, 123)]] = 1
KIND[128:192] = 2


class Checkpoints:
    """The number of tokens of a UTF-8 text, and the offsets of each EVERY-th token."""

    def __init__(self, data: np.ndarray, every: int = EVERY, window: int = WINDOW):
        self.data, self.every, self.window = data, every, window
        at_bytes, at_points = [np.zeros(1, dtype=np.int64)], [np.zeros(1, dtype=np.int64)]
        self.n = self.points = 0
        for low in range(0, len(data), window):
            starts, heads = self.starts(low, min(low + window, len(data)))
            first = -self.n % every or (every if self.n == 0 else 0)  # token 0 is a checkpoint already
            some = starts[first::every]
            at_bytes.append(some + low)
            # code points before a checkpoint: those of earlier windows, and the heads before it in this one
            at_points.append(np.cumsum(heads)[some] - 1 + self.points if len(some) else some)
            self.n += len(starts)
            self.points += int(np.count_nonzero(heads))
        self.bytes, self.code_points = np.concatenate(at_bytes), np.concatenate(at_points)
        self.units = np.arange(len(self.bytes)) * every

    def starts(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Of a window: where tokens start, and which bytes start a code point."""
        kind = KIND[self.data[low:high]]
        heads = kind != 2
        letter = kind == 1
        start = heads.copy()
        start[1:] &= ~(letter[1:] & letter[:-1])
        if low and high > low and letter[0] and KIND[self.data[low - 1]] == 1:
            start[0] = False
        return np.flatnonzero(start), heads

    def code_point(self, token: int) -> int:
        """The code points before a token; all of them for the one after the last."""
        if token >= self.n:
            return self.points
        k = int(np.searchsorted(self.units, token, side="right")) - 1
        low = int(self.bytes[k])
        high = int(self.bytes[k + 1]) if k + 1 < len(self.bytes) else len(self.data)
        seen, points = int(self.units[k]), int(self.code_points[k])
        for at in range(low, high, self.window):
            starts, heads = self.starts(at, min(at + self.window, high))
            if token - seen < len(starts):
                return points + int(np.count_nonzero(heads[: starts[token - seen]]))
            seen += len(starts)
            points += int(np.count_nonzero(heads))
        return points


def hashed(doc_id: Column) -> list[Column]:
    """Four unsigned integers from the first 32 hexadecimal digits of a hash of the id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def cuts(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    """Of each text its number of tokens and the code points of its prefix and middle, from two hashes of its id."""
    rows = []
    for text, a, b in zip(texts, first.to_pylist(), second.to_pylist(), strict=True):
        index = Checkpoints(np.frombuffer(text.as_buffer() or b"", dtype=np.uint8))
        low, high = sorted((a % (index.n + 1), b % (index.n + 1)))
        prefix, both = index.code_point(low), index.code_point(high)
        rows.append((index.n, prefix, both - prefix))
    columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * 3
    return pa.StructArray.from_arrays(columns, ["n", "prefix_chars", "middle_chars"])


def infilled(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with n, form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    h1, h2, h3, h4 = hashed(F.col(id_column))
    held = (text == "") | F.contains(text, F.lit(MARKERS[0])) | F.contains(text, F.lit(MARKERS[1])) | F.contains(text, F.lit(MARKERS[2]))
    form = F.when(held | (h3 % 100 >= 100 - PLAIN), "plain").when(h4 % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    out = docs.withColumn("__cut", F.arrow_udf(cuts, CUTS)(text, h1, h2)).withColumn("__form", form)
    plain, p, m = F.col("__form") == "plain", F.col("__cut.prefix_chars").cast("int"), F.col("__cut.middle_chars").cast("int")
    prefix, middle, suffix = F.left(text, p), F.substring(text, p + 1, m), F.substring(text, p + m + 1, F.length(text))
    by_form = F.when(plain, text)
    by_form = by_form.when(F.col("__form") == "psm", F.concat(F.lit("<P>"), prefix, F.lit("<S>"), suffix, F.lit("<M>"), middle))
    output = by_form.otherwise(F.concat(F.lit("<S>"), suffix, F.lit("<P>"), prefix, F.lit("<M>"), middle))
    unless = lambda name: F.when(~plain, F.col(f"__cut.{name}"))
    added = {"n": F.col("__cut.n"), "form": F.col("__form"), "prefix_chars": unless("prefix_chars"), "middle_chars": unless("middle_chars"), "output": output}
    return out.withColumns(added).drop("__cut", "__form")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "<[PSM]>")
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
