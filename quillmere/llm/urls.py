"""URL filters: rules first, then gradient-boosted trees on lexical features.

A rule is `host/path`: it fits its host and all subdomains when the URL's path starts with its path; the longest fitting
rule decides. URLs that no rule fits are judged by boosted trees on length, depth, digit ratio, entropy, parameter counts
and the statistics of host suffixes. The trees learn from the distinct URLs that a rule labels: the first ``SAMPLE`` by
the hash of the URL, whatever their label, so the share of blocked ones is that of all at every size. The suffix statistics
of a training row come from the rows of other folds, so none holds its own label; URLs to be judged get those of the whole
sample. They block from a score of 0.5.

Cases: a null URL, or one without `://`, has an empty host and path and fits no rule; without labelled URLs of both
kinds the score is the smoothed share of blocked ones, and 0 if there are none; repeated rows are judged alike; a URL of
any length is read whole, in one pass; columns named like a result are replaced; an empty table stays empty.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting

SAMPLE, FOLDS = 20_000, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def suffixes(host: str) -> list[str]:
    labels = host.split(".")
    return [".".join(labels[-k:]) for k in (1, 2) if len(labels) >= k]


def split_url(url: str) -> tuple[str, str, str]:
    m = re.match(PARTS, url)
    return (m[1].lower(), m[2], url[m.end() :]) if m else ("", "", url)


class Lexical:
    """Features of URLs; the suffix statistics are those of the labelled sample."""

    def __init__(self, urls: list[str], labels: list[int]):
        seen, blocked = Counter(), defaultdict(int)
        for url, label in zip(urls, labels, strict=True):
            for s in suffixes(split_url(url)[0]):
                seen[s] += 1
                blocked[s] += label
        self.share = (sum(labels) + 0.5) / (len(labels) + 1)
        self.rates = {s: (blocked[s] + self.share) / (n + 1) for s, n in seen.items()}

    def rows(self, urls) -> np.ndarray:
        out = []
        for url in urls:
            url = url or ""
            host, path, rest = split_url(url)
            n = max(1, len(url))
            counts = np.array(list(Counter(url).values()), dtype=float)
            entropy = float(-(counts / n * np.log2(counts / n)).sum()) if len(counts) else 0.0
            parts = [p for p in path.split("/") if p]
            tails = [self.rates.get(s, self.share) for s in suffixes(host)]
            out.append([
                len(url), len(host), len(path), len(rest), host.count(".") + 1, len(parts), sum(c.isdigit() for c in url) / n,
                sum(c.isdigit() for c in host), sum(c.isdigit() for c in path), entropy, rest.count("=") + rest.count("&"),
                float("#" in rest), url.count("-"), max(map(len, parts), default=0), len(parts[0]) if parts else 0,
                tails[0] if tails else self.share, tails[-1] if tails else self.share,
            ])
        return np.array(out, dtype=float).reshape(len(out), 17)


def out_of_fold(urls: list[str], labels: list[int], folds: int = FOLDS) -> np.ndarray:
    """Training features: of each fold by the suffix statistics of the others."""
    out = Lexical([], []).rows(urls)
    for k in range(min(folds, len(urls)) if len(urls) > 1 else 0):
        rest = [i for i in range(len(urls)) if i % folds != k]
        out[k::folds] = Lexical([urls[i] for i in rest], [labels[i] for i in rest]).rows(urls[k::folds])
    return out


def labelled(pages: DataFrame, bound: int = SAMPLE) -> list[tuple[str, int]]:
    """The first URLs in the order of their hashes, at most bound, with the label that a rule gives them (1: block)."""
    label = rule_of(host_of(F.col("url")), path_of(F.col("url")))["verdict"]
    rows = pages.select("url", label.alias("verdict")).where("verdict is not null").distinct()
    return [(r.url, int(r.verdict == "block")) for r in rows.orderBy(F.xxhash64("url"), "url").limit(bound).collect()]


def judged(pages: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """pages with host, path, rule, verdict and the trees' score."""
    sample = labelled(pages, bound)
    urls, labels = [u for u, _ in sample], [y for _, y in sample]
    lexical = Lexical(urls, labels)
    model = boosting.fit(out_of_fold(urls, labels), np.array(labels, dtype=float))
    nothing = not sample

    @F.pandas_udf("double")
    def score(url: pd.Series) -> pd.Series:
        return pd.Series(np.zeros(len(url)) if nothing else model.score(lexical.rows(url.tolist())), dtype=float)

    out = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    out = out.withColumn("__rule", rule_of(F.col("host"), F.col("path"))).withColumn("score", score("url"))
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return out.withColumn("rule", F.col("__rule.rule")).withColumn("verdict", F.coalesce(F.col("__rule.verdict"), own)).drop("__rule")
