r"""Secret scans by one combined deterministic automaton.

The reversed rules are compiled together: parse, subset construction, minimisation, one transition array. One pass over
a text's bytes, from its end to its start, marks every byte at which a match of some rule begins, for all rules at once.
From the leftmost mark of a rule, that rule's own forward automaton gives the longest match; then the next mark at or
after its end counts. These are the leftmost non-overlapping matches of each rule. Matches that fail a rule's length are
dropped without another try.

Spans are code points, end exclusive, ordered by start, then rule. Cases: a null or empty text has no spans; very long
texts are scanned in linear time with a state of a few numbers; repeated rows get the same spans.
"""

from __future__ import annotations

from itertools import accumulate
from operator import getitem, itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .automaton import Automaton, parse, reverse

#: Name, pattern, whether letters are of either case, least length of the match, least length of the value.
RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 0, 6),
    ("access", r"AKIA[A-Z0-9]+", False, 20, 0),
    ("hex", r"[0-9a-f]{24,}", False, 24, 0),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", False, 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", False, 40, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", False, 15, 0),
    ("google", r"AIza[A-Za-z0-9_-]+", False, 39, 0),
    ("payment", r"sk_live_[A-Za-z0-9]+", False, 24, 0),
    ("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False, 40, 0),
)
BASE = ("assign", "access", "hex")
CODE = itemgetter(256)
SPANS = "array<struct<kind:string,start:int,end:int>>"


def value_length(match: bytes) -> int:
    """Length of what follows the separator and an optional quote."""
    at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
    rest = match[at + 1 :].lstrip(b" ")
    return len(rest) - rest.startswith((b'"', b"'"))


class Scanner:
    def __init__(self, rules=RULES):
        trees = [parse(pattern, fold) for _, pattern, fold, _, _ in rules]
        self.rules = rules
        self.marks, self.masks = Automaton([reverse(t) for t in trees], anchored=False).rows()
        self.forward = [Automaton([t], anchored=True) for t in trees]

    def starts(self, data: bytes) -> list[tuple[int, int]]:
        """(position, mask) of the bytes at which rules match, from the last to the first."""
        codes = np.frombuffer(bytes(map(CODE, accumulate(reversed(data), getitem, initial=self.marks[0]))), np.uint8)[1:]
        last = len(data) - 1
        return [(last - at, self.masks[codes[at]]) for at in np.flatnonzero(codes).tolist()]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start, then rule."""
        out, free = [], [0] * len(self.rules)
        for at, mask in reversed(self.starts(data)):
            for k, (_, _, _, least, value) in enumerate(self.rules):
                if mask >> k & 1 and at >= free[k]:
                    end = free[k] = self.forward[k].longest(data, at)
                    if end - at >= least and (not value or value_length(data[at:end]) >= value):
                        out.append((at, k, end))
        return out


def found(text: Column, rules=RULES) -> Column:
    """The spans of the secrets in a text."""
    held: list[Scanner] = []

    @F.arrow_udf(SPANS)
    def scan(column: pa.Array) -> pa.Array:
        if not held:
            held.append(Scanner(rules))
        scanner, out = held[0], []
        for data in column.cast(pa.large_binary()):
            data = data.as_py()
            spans = scanner.spans(data) if data else []
            if spans and not data.isascii():
                points = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
                spans = [(int(points[a]), k, int(points[b])) for a, k, b in spans]
            out.append([{"kind": rules[k][0], "start": a, "end": b} for a, k, b in spans])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.array(out, kind)

    return scan(F.coalesce(text, F.lit("")))
