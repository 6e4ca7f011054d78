r"""Line-first quality rules, in DataFrame functions only.

Each line of a text is judged by itself: a line fails that has no closing punctuation
(neither at its end nor, where prose was cut, after a sentence within), that is navigation (menu
separators, or nothing but menu words), that is boilerplate (licences, cookie and account notices) or that is mostly
symbols. Every rule is applied to lines of every length: a text without line breaks is one line. Failing lines are removed; a document that loses more than ``max_loss`` of its words is rejected. Before that
a text must pass the base rules: 50 words at least, and at most half of its words in 3-word windows that repeat.

Everything is computed within the row (higher-order functions over the arrays of words and lines), so nothing is
shuffled, and one row never needs another. A window's repeats are found by sorting the row's windows, not by comparing
them with each other.

Cases: a null text has no words and no lines, and fails; an empty text likewise; lines without a word are neither
counted nor judged; repeated rows are judged alike; a very long text is judged whole, in time linear in its length but
for the sort of its windows, and needs a few copies of itself in memory; columns named like a result are replaced.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let

WORD = f"[^{SPACES}]"
#: What a line may end in, menu separators, menu words and phrases of boilerplate.
CLOSED = r"[.!?:;…。！？][\"'”’»)\]*#$%&|<>]*[\x20\x09-\x0D]*$"
SENTENCE_END = r"[.!?…。！？]\x20"
SEPARATORS = r"[|»›•·]"
MENU_LINE = (
    r"^\W*(home|menu|login|log in|sign in|sign up|register|search|contact|contact us|about|about us|next|previous|back"
    r"|top|sitemap|share|print|skip to content|read more|click here)(\W+(home|menu|login|log in|sign in|sign up|register"
    r"|search|contact|contact us|about|about us|next|previous|back|top|sitemap|share|print|skip to content|read more"
    r"|click here))*\W*$"
)
#: One item of a menu line, the longer ones first; a line of any length is judged by what is left without its items, as
#: MENU_LINE's repeated group would recurse for each item.
ITEM = (
    r"(?<!\w)(?:home|menu|login|log in|sign in|sign up|register|search|contact us|contact|about us|about|next|previous|back"
    r"|top|sitemap|share|print|skip to content|read more|click here)(?!\w)"
)
BOILERPLATE = (
    r"all rights reserved|licensed under|released under the|copyright (\(c\)|©|[0-9]{4})|privacy policy"
    r"|terms of (use|service)|cookie (policy|settings)|accept (all )?cookies|enable javascript|lorem ipsum"
    r"|subscribe to our newsletter"
)
#: A literal of each phrase of BOILERPLATE: a text without any of them has no such line, and no line of it is searched.
LITERALS = (
    "all rights reserved", "licensed under", "released under the", "copyright", "privacy policy", "terms of ", "cookie", "enable javascript", "lorem ipsum",
    "subscribe to our newsletter",
)
SYMBOLS = r"[^#*$%&|<>]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACES}]+"), "")


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SYMBOLS, ""))


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more."""
    windows = F.when(
        F.size(words) > 2,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - 3),
            lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")),
        ),
    ).otherwise(F.array().cast("array<struct<w:string,i:int>>"))

    def repeated(s):
        again = F.filter(s, lambda x, k: (F.get(s, k - 1)["w"] == x["w"]) | (F.get(s, k + 1)["w"] == x["w"]))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def covered(p):
        ahead = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(ahead, F.lit(0), lambda a, b: a + b)

    return let(windows, lambda w: F.when(F.size(F.array_distinct(F.transform(w, lambda x: x["w"]))) == F.size(w), F.lit(0)).otherwise(let(let(F.sort_array(w), repeated), covered)))


def may_be_boilerplate(text: Column) -> Column:
    """Whether the text has a literal of some phrase, so that its lines must be searched for phrases."""
    return let(F.lower(text), lambda low: reduce(or_, (low.contains(x) for x in LITERALS)))


def line_fails(line: Column, n: Column, phrases: Column) -> Column:
    """What is wrong with a line of n words, or null: navigation, symbols, boilerplate or punctuation.

    phrases says whether the line's text holds a literal of some phrase.
    """
    separators = F.length(F.regexp_replace(line, f"[^{SEPARATORS[1:]}+", ""))
    return (
        F.when(separators >= F.greatest(F.lit(2), n / 10), "navigation")
        .when((n_symbols(line) > n) & (n > 2), "symbols")
        .when(F.lower(line).rlike(r"^\W*" + ITEM) & ~F.regexp_replace(F.lower(line), ITEM, "").rlike(r"\w"), "navigation")
        .when(phrases & F.lower(line).rlike(BOILERPLATE), "boilerplate")
        .when(~line.rlike(CLOSED) & ~line.rlike(SENTENCE_END), "punctuation")
    )


def judged(docs: DataFrame, max_loss: float = 0.5, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """docs with the counts, the verdict, and the text left after the failing lines are removed (clean_text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    counted = F.transform(lines, lambda x: F.struct(x.alias("line"), F.size(words_of(x)).alias("n")))
    # a lambda's variable: a column would be evaluated anew for each line
    judged_lines = let(may_be_boilerplate(text), lambda p: F.transform(counted, lambda x: F.struct(x["line"].alias("line"), x["n"].alias("n"), line_fails(x["line"], x["n"], p).alias("fault"))))
    total = lambda a: F.aggregate(F.transform(a, lambda x: x["n"]), F.lit(0), lambda p, q: p + q).cast("long")
    out = (
        docs.withColumn("__w", words_of(text))
        .withColumn("__l", judged_lines)
        .withColumn("n_words", F.size("__w").cast("long"))
        .withColumn("word_chars", F.length(F.concat_ws("", "__w")).cast("long"))
        .withColumn("n_symbols", n_symbols(text).cast("long"))
        .withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct(F.transform("__l", lambda x: x["line"])))).cast("long"))
        .withColumn("n_repeat_words", repeat_words(F.col("__w")).cast("long"))
        .withColumn("n_lines", F.size("__l").cast("long"))
        .withColumn("n_failed_lines", F.size(F.filter("__l", lambda x: x["fault"].isNotNull())).cast("long"))
        .withColumn("lost_words", total(F.filter("__l", lambda x: x["fault"].isNotNull())))
        .withColumn("clean_text", F.array_join(F.transform(F.filter("__l", lambda x: x["fault"].isNull()), lambda x: x["line"]), "\n"))
        .drop("__w", "__l")
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") <= max_loss * F.col("n_words")))
