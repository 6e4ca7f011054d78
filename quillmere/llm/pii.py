r"""Personal data by candidate gradient boosting.

Two steps of candidates. The base kinds (email, ip, card, phone) are exact formats whose matches are kept as they are.
High-recall generators then propose further, overlapping spans: disguised emails, social security numbers, IBANs, local
phone numbers, MAC addresses and birth dates. Boosted trees score each proposal by its format (digits, groups,
separators, checksums) and its context (cue words before it, neighbouring characters). Per kind, a threshold is
calibrated on held-out training rows to a precision of ``PRECISION``; proposals below it are left alone. Of overlapping
proposals the best-scored stays, and none may touch a base span. The corpus has no labels for personal data, so the
trees learn from ``TRAINING`` generated candidates with a fixed seed: true formats in fitting contexts against look-alikes
(versions, dates, order and part numbers, prices, hashes).

Scans walk each run of characters once; overlaps are found by binary search among sorted spans. Spans are code points, end exclusive, by kind as
listed in KINDS, then start. Cases: a null or empty text has no spans; repeated rows get the same spans; texts of any
length, and runs of digits of any length in them, are scanned whole. Of overlapping proposals with equal scores the one that
starts first stays, then the one whose kind comes first by name. `found` is a column of one text, so an empty table stays
empty and no other column is read. Redaction cuts the union of overlapping spans, so nothing of any span is left.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import boosting

BASE = ("email", "ip", "card", "phone")
ADDED = ("email_disguised", "ssn", "iban", "phone_local", "mac", "birth_date")
KINDS = BASE + ADDED
TRAINING, PRECISION, SEED = 6000, 0.99, 7
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: The generators of proposals, each of which matches more than the kind it is named after.
PROPOSALS = {
    "email_disguised": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\s?[\[({<]\s?(?:at|AT)\s?[\])}>]\s?[A-Za-z0-9-]{1,63}(?:\s?[\[({<]\s?(?:dot|DOT)\s?[\])}>]\s?|\.)[A-Za-z]{2,24}"),
    "ssn": re.compile(r"(?<![0-9A-Za-z.+-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9A-Za-z-])"),
    "iban": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    "phone_local": re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,5}\)?(?:[ ./-][0-9]{2,8}){1,4}(?![0-9A-Za-z-])"),
    "mac": re.compile(r"(?<![0-9A-Za-z:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Za-z:-])"),
    "birth_date": re.compile(r"(?<![0-9A-Za-z./-])(?:(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)?[0-9]{2})(?![0-9A-Za-z./-])"),
}
CUES = {
    "phone": r"phone|tel|call|fax|mobile|cell|whatsapp",
    "ssn": r"ssn|social security|tax id|taxpayer",
    "bank": r"iban|account|bank|konto|cuenta|compte|transfer",
    "mail": r"mail|contact|write|reach",
    "birth": r"born|birth|dob|geboren|nacido|n[ée]e? ",
    "device": r"mac|device|adapter|ethernet|wifi",
    "thing": r"order|invoice|version|isbn|page|price|part|model|release|ticket|total|item|date|posted|updated|v\.|no\.",
}
CUE_WORDS = [re.compile(p, re.I) for p in CUES.values()]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = re.sub(r"[^A-Z0-9]", "", iban.upper())
    return len(s) >= 15 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def only_digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def byte(part: str) -> bool:
    """Whether a run of digits of any length, leading zeros included, is at most 255."""
    kept = part.lstrip("0")
    return len(kept) < 4 and int(kept or "0") < 256


def emails(text: str):
    """Leftmost non-overlapping emails: of each run of local characters that ends at an @, the run and its domain."""
    at = 0
    while m := LOCAL.search(text, at):
        at = m.end()
        if text[at : at + 1] == "@" and (d := DOMAIN.match(text, at + 1)):
            at = d.end()
            yield m.start(), at


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the base kinds, in order."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(byte(p) for p in m[0].split("."))]
    for m in CARD.finditer(text) if len(text) >= 16 else ():
        if m.end() - m.start() >= 16 and 16 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(only_digits(m[0])) <= 15]
    return out


def features(kind: str, text: str, start: int, end: int) -> list[float]:
    """Format and context of a proposal."""
    span, before = text[start:end], text[max(0, start - 32) : start]
    digits = only_digits(span)
    groups = re.findall(r"[0-9]+", span)
    sizes = [len(g) for g in groups] + [0] * 5
    cue = [float(bool(p.search(before))) for p in CUE_WORDS]
    year = any(1900 <= int(g) <= 2035 for g in groups if len(g) == 4)
    small = bool(groups) and all(int(g) <= 31 for g in groups if len(g) <= 2)
    return [
        float(ADDED.index(kind)), len(span), len(digits), len(groups), *map(float, sizes[:5]), span.count(" "), span.count("-"),
        span.count("."), span.count("/"), span.count("("), float(span.count("(") == span.count(")")), float(luhn(digits)) if digits else 0.0,
        float(kind == "iban" and mod97(span)), float(year), float(small), float(digits[:1] in ("0", "9")), float(digits[:3] in ("000", "666")),
        float(before.endswith((": ", ":", "#"))), float(before[-2:-1].isalpha()), float("$" in before[-3:] or "€" in before[-3:]), *cue,
    ]


def generated(n: int, seed: int) -> tuple[list[tuple[str, str, int, int]], list[int]]:
    """Labelled proposals (kind, text, start, end): personal data in fitting contexts, and look-alikes."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))
    words = lambda: " ".join(word() for _ in range(r.randint(2, 6)))

    def iban() -> str:
        bank = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(r.choice([0, 0, 4])))
        body, land = bank + d(r.randint(14, 20)) + r.choice(["", "", "M" + d(2)]), r.choice(["DE", "FR", "ES", "GB", "NL"])
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        s = f"{land}{check:02d}{body}"
        return s if r.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))

    hexes = lambda: r.choice(":-").join("%02x" % r.randrange(256) for _ in range(6))
    date = lambda: r.choice(["{2}-{1:02d}-{0:02d}", "{0}.{1}.{2}", "{1}/{0}/{2}"]).format(r.randint(1, 28), r.randint(1, 12), r.randint(1930, 2024))
    true = {
        "email_disguised": (lambda: f"{word()}.{word()} {r.choice(['[at]', '(at)', '{at}'])} {word()}{r.choice(['.', ' [dot] ', ' (dot) '])}{r.choice(['com', 'org', 'net'])}", ["mail", "contact", "write to", "reach me at", ""]),
        "ssn": (lambda: f"{r.randint(1, 665):03d}-{d(2)}-{d(4)}", ["ssn", "SSN:", "social security number", "tax id"]),
        "iban": (iban, ["IBAN", "account", "bank transfer to", "Konto", ""]),
        "phone_local": (lambda: r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"]).format(str(r.randint(200, 989)), d(3), d(4)), ["phone", "tel", "call", "fax:", "mobile", "cell"]),
        "mac": (hexes, ["mac", "device", "ethernet", "adapter", ""]),
        "birth_date": (date, ["born", "date of birth", "DOB", "born on", "geboren", "dob:"]),
    }
    false = {
        "email_disguised": (lambda: f"{word()} (at) {word()}.{word()[:9]}", ["order", "item", "price", "look"]),
        "ssn": (lambda: f"{d(3)}{r.choice(' -')}{d(2)}{r.choice(' -')}{d(4)}", ["order", "part", "item", "model", "", "total"]),
        "iban": (lambda: r.choice(["AB", "XK", "ZZ", "SN"]) + d(2) + d(r.randint(8, 16)), ["part", "order", "model", "item no.", ""]),
        "phone_local": (lambda: r.choice(["{}-{}", "{} {}", "{}.{}", "{}/{}", "{}-{}-{}", "{} {} {}"]).format(d(r.randint(2, 5)), d(r.randint(2, 6)), d(r.randint(2, 5))), ["order", "isbn", "page", "price", "version", "", "total", "item", "", ""]),
        "mac": (lambda: "-".join(d(2) for _ in range(6)), ["order", "ticket", "part", "date"]),
        "birth_date": (date, ["posted", "updated", "date", "version", "release", "", "order of", "", ""]),
    }
    # what one kind's generator also matches when the other's data stand there
    mistaken = {"phone_local": ["ssn", "birth_date"], "birth_date": ["phone_local"]}
    rows, labels = [], []
    for k in range(n):
        kind, label = ADDED[k % len(ADDED)], k // len(ADDED) % 2
        make, cues = (true if label else false)[kind]
        if not label and kind in mistaken and r.random() < 0.4:
            make, cues = true[r.choice(mistaken[kind])]
        span = make()
        cue = r.choice(cues)
        before = f"{words()} {cue} " if cue else f"{words()} "
        rows.append((kind, before + span + " " + words(), len(before), len(before) + len(span)))
        labels.append(label)
    return rows, labels


class Model:
    """Trees and calibrated thresholds; trained on one half of the generated rows, calibrated on the other."""

    def __init__(self, n: int = TRAINING, precision: float = PRECISION, seed: int = SEED):
        rows, labels = generated(n, seed)
        x, y = np.array([features(*row) for row in rows]), np.array(labels, dtype=float)
        kinds = x[:, 0].astype(int)
        fit = np.arange(n) // (2 * len(ADDED)) % 2 == 0
        self.trees = boosting.fit(x[fit], y[fit], trees=50, depth=4)
        scores = self.trees.score(x)
        self.thresholds = []
        for k in range(len(ADDED)):
            held = ~fit & (kinds == k)
            self.thresholds.append(max(0.5, boosting.threshold_for(scores[held], y[held], precision)))

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, float]]:
        """The proposals that pass, apart from base spans and from each other."""
        if not (DIGIT.search(text) or "at" in text.lower()):
            return []
        found = [(kind, m.start(), m.end()) for kind, p in PROPOSALS.items() if kind != "email_disguised" or "at" in text or "AT" in text for m in p.finditer(text)]
        found = apart(found, sorted((a, b) for _, a, b in base))
        if not found:
            return []
        scores = self.trees.score(np.array([features(k, text, a, b) for k, a, b in found]))
        passed = [(*f, float(s)) for f, s in zip(found, scores, strict=True) if s >= self.thresholds[ADDED.index(f[0])]]
        out, starts, ends = [], [], []  # the chosen spans lie apart, so both lists ascend together
        for f in sorted(passed, key=lambda f: (-f[3], f[1], f[0])):
            k = bisect_left(starts, f[2])
            if not k or ends[k - 1] <= f[1]:
                starts.insert(k, f[1])
                ends.insert(k, f[2])
                out.append(f)
        return sorted(out, key=lambda f: (KINDS.index(f[0]), f[1]))


def apart(found: list[tuple[str, int, int]], taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Those of found that touch none of the sorted spans taken, by binary search of their running ends."""
    starts = [a for a, _ in taken]
    ends = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
    return [f for f in found if not (k := bisect_left(starts, f[2])) or ends[k - 1] <= f[1]]


def found(text: Column) -> Column:
    """The spans of personal data in a text, with the score of each (1 for the base kinds)."""
    model = Model()

    @F.arrow_udf(SPANS)
    def scan(column: pa.Array) -> pa.Array:
        out = []
        for value in column:
            t = value.as_py()
            base = base_spans(t)
            out.append([{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in [*((*x, 1.0) for x in base), *model.added(t, base)]])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        return pa.array(out, kind)

    return scan(F.coalesce(text, F.lit("")))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first in brackets."""
    merged: list[list] = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    out, at = [], 0
    for kind, start, end in merged:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])
