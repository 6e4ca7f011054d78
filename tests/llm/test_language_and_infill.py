"""Language identification against a plain Kneser-Ney model, and fill-in-the-middle against token lists."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.llm import infill, language

from .test_operators import ODD, none, odd, small  # noqa: F401

# language


def plain_model(grams, alphabet):
    """A function of (gram of any length) to its probability: grams are the counts of the longest ones of one language."""
    order = len(next(iter(grams)))
    levels = {order: dict(grams)}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    sums, kinds, cut = {}, {}, {}
    for n, level in levels.items():
        sums[n], kinds[n] = defaultdict(float), defaultdict(int)
        for g, c in level.items():
            sums[n][g[:-1]] += c
            kinds[n][g[:-1]] += 1
        once, twice = (sum(c == k for c in level.values()) for k in (1, 2))
        cut[n] = once / (once + 2 * twice) if once and twice else 0.5

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / alphabet
        if not sums[n].get(g[:-1]):
            return p(g[1:])
        total, d = sums[n][g[:-1]], cut[n]
        return max(levels[n].get(g, 0) - d, 0) / total + d * kinds[n][g[:-1]] / total * p(g[1:])

    return p


def words(r, letters, n):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 6))) for _ in range(n))


TONGUES = {"aa": "abcdeeef", "bb": "abccdeéñ", "cc": "шщабвгд"}


@pytest.mark.parametrize("order", [1, 2, 4])
@pytest.mark.parametrize("cells", [language.CELLS, 60])
def test_cross_entropy_equals_plain_kneser_ney(order, cells):
    r = random.Random(order)
    names = sorted(TONGUES)
    grams = {}
    for k, name in enumerate(names):
        text = " " * (order - 1) + words(r, TONGUES[name], 120) + " "
        for i in range(len(text) - order + 1):
            grams[k, text[i : i + order]] = grams.get((k, text[i : i + order]), 0) + 1
    keys = sorted(grams)
    points = np.array([[ord(c) for c in g] for _, g in keys], dtype=np.uint32)
    models = language.estimated(names, np.array([k for k, _ in keys]), points, np.array([grams[key] for key in keys]), cells)
    if cells < language.CELLS:
        assert len(models.grams[-1]) * 3 <= max(cells, len(models.grams[0]) * 3)
        return
    alphabet = len({c for _, g in keys for c in g}) + 1
    plain = [plain_model({g: c for (k, g), c in grams.items() if k == i}, alphabet) for i in range(3)]
    for text in (words(r, "abcdeé", 30), words(r, "xyzшщ🙂", 10), "a", words(r, TONGUES["cc"], 500)):
        padded = " " * (order - 1) + text + " "
        h, n = models.entropies(text)
        assert n == len(text) + 1
        for k in range(3):
            expected = -sum(math.log(plain[k](padded[i : i + order])) for i in range(n)) / n
            assert h[k] == pytest.approx(expected, rel=1e-4)
        one = [math.exp(-x) for x in models.entropies("")[0]]
        assert all(0 < x < 1 for x in one)


def test_windows_change_nothing(monkeypatch):
    r = random.Random(3)
    text = words(r, "abcdef", 4000)
    points = np.array([[ord(c) for c in text[i : i + 3]] for i in range(300)], dtype=np.uint32)
    models = language.estimated(["x"], np.zeros(300, dtype=int), points, np.ones(300))
    whole = models.entropies(text)[0]
    monkeypatch.setattr(language, "WINDOW", 1)
    assert models.entropies(text)[0] == pytest.approx(whole)


def test_sorted_hashes_are_found():
    r = np.random.default_rng(1)
    for n in (0, 1, 5, 1000):
        keys = np.unique(r.integers(0, 2**64 - 1, n, dtype=np.uint64, endpoint=True))
        low = np.unique(np.concatenate([keys, np.arange(n, dtype=np.uint64)]))  # many in one bucket
        for table in (keys, low):
            s = language.Sorted(table)
            asked = np.concatenate([table, r.integers(0, 2**64 - 1, 100, dtype=np.uint64), np.arange(50, dtype=np.uint64)])
            place = {int(k): i for i, k in enumerate(table)}
            assert s.find(asked).tolist() == [place.get(int(k), -1) for k in asked]


def tongues_table(spark, n=120):
    r = random.Random(8)
    rows = [(i, words(r, TONGUES[name], r.choice([3, 10, 60])), name) for i in range(n) for name in [sorted(TONGUES)[i % 3]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def test_languages_of_held_out_texts(spark):
    docs = tongues_table(spark).withColumn("score", F.lit("own")).withColumn("extra", F.lit(1)).withColumn("name", F.lit("clash"))
    rows = language.identified(docs).collect()
    held = [x for x in rows if zlib.crc32(str(x.doc_id).encode()) % 4 == 2]
    assert len(held) > 15
    assert sum(x.lang_pred == x.lang for x in held) >= len(held) - 1
    assert all(0 <= x.score <= 1 and x.extra == 1 and x.name == "clash" for x in rows)
    # labels of held-out rows are never read
    other = docs.withColumn("lang", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, "zz").otherwise(F.col("lang")))
    again = {x.doc_id: x for x in language.identified(other).collect()}
    assert all((x.lang_pred, x.score) == (again[x.doc_id].lang_pred, again[x.doc_id].score) for x in rows)


def test_texts_unlike_all_languages_are_rejected(spark):
    docs = tongues_table(spark, 400).where("lang <> 'cc'")
    strange = spark.createDataFrame([(10_000, words(random.Random(1), "δψωξ", 60), None)], docs.schema)
    rows = {x.doc_id: x for x in language.identified(docs.union(strange)).collect()}
    assert rows[10_000].rejected and rows[10_000].score < 0.5
    own = [x for i, x in rows.items() if i < 10_000]
    assert sum(x.rejected for x in own) < 0.1 * len(own)


def test_language_cases(spark, odd, none):  # noqa: F811
    rows = {(x.doc_id, x.text): x for x in language.identified(odd).collect()}
    assert len(rows) == len(set((a, b) for a, b, *_ in ODD))
    for key in ((3, None), (4, ""), (5, " \t\n ")):
        assert (rows[key].lang_pred, rows[key].score, rows[key].rejected) == ("und", 0.0, True)
    assert {x.lang_pred for x in rows.values()} <= {"en", "de", "und"}
    assert language.identified(none).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {(x.lang_pred, x.score) for x in language.identified(unlabelled).collect()} == {("und", 0.0)}
    one = language.identified(odd.withColumn("lang", F.lit("xx"))).where("lang_pred <> 'und'").collect()
    assert one and all(x.lang_pred == "xx" and 0 <= x.score <= 1 for x in one)
    digits = spark.createDataFrame([(1, "12 34", "en"), (2, "²", "en"), (3, "abc", "en")], "doc_id long, text string, lang string")
    assert {x.doc_id: x.lang_pred for x in language.identified(digits).collect()} == {1: "und", 2: "und", 3: "en"}


def test_equal_pieces_count_once(spark):
    docs = tongues_table(spark)
    many = docs.unionByName(docs.where("doc_id = 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("copy"))
    names, pieces = language.drawn(many, "lang", 10**6, 10**6, 10**6)
    assert names == sorted(TONGUES)
    assert pieces.count() == pieces.dropDuplicates(["lang", "text"]).count() <= 120


def test_all_training_text_counts(spark):
    r = random.Random(4)
    # 700,000 characters of one language and 2,000 of another; beyond a draw of 500,000 a language most pieces went unread
    rows = [(i, words(r, TONGUES["aa"], 1500), "aa") for i in range(140)] + [(1000 + i, words(r, TONGUES["cc"], 60), "cc") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    plain = Counter()
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            for piece in {" ".join(text[k : k + language.PIECE].split()) for k in range(0, len(text), language.PIECE)}:
                padded = "   " + piece + " "
                plain.update(("aacc".index(lang) // 2, padded[k : k + 4]) for k in range(len(padded) - 3))
    names, pieces = language.drawn(docs, "lang")
    found = {(x.lang, "".join(map(chr, (x.c0, x.c1, x.c2, x.c3)))): x.n0 + x.n1 for x in language.gram_counts(pieces, 4).collect()}
    assert names == ["aa", "cc"] and found == plain and sum(n for (k, _), n in plain.items() if k == 0) > 550_000


def test_many_texts_at_once_equal_each_alone():
    r = random.Random(6)
    for order in (1, 2, 4):
        points = np.array([[ord(c) for c in words(r, "abc d", 40)[i : i + order]] for i in range(20)], dtype=np.uint32)
        models = language.estimated(["x", "y"], np.arange(20) % 2, points, np.ones(20))
        texts = [words(r, "abcdé🙂", n) for n in (1, 1, 5, 80, 1, 300)] + ["a"]
        h, n, which = models.entropies_of(texts, (3, 20, 100))
        expected = [(k, min(m, len(t))) for i, m in enumerate((3, 20, 100)) for k, t in enumerate(texts) if i == 0 or len(t) > (3, 20, 100)[i - 1]]
        assert expected == list(zip(which.tolist(), (n - 1).tolist(), strict=True))
        for (k, m), row in zip(expected, h, strict=True):
            assert models.entropies(texts[k][:m])[0] == pytest.approx(row, rel=1e-5)


def test_distinct_grams():
    r = random.Random(7)
    for letters in ("abc", "ab🙂"):
        text = words(r, letters, 200)
        points = np.array([ord(c) for c in text], dtype=np.uint32)
        rows, n = language.distinct_grams(points, np.arange(len(text) - 3), 4)
        assert {"".join(map(chr, g)): int(k) for g, k in zip(rows, n, strict=True)} == Counter(text[i : i + 4] for i in range(len(text) - 3))


# fill-in-the-middle


def plain_infill(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_checkpoints_equal_token_lists():
    r = random.Random(1)
    for _ in range(1500):
        text = "".join(r.choice(["a", "B", "z", " ", "é", "😀", "1", "ab", "\n", "日"]) for _ in range(r.choice([0, 1, 2, 5, 30, 300])))
        ends = [0]
        for token in re.findall(r"[A-Za-z]+|[^A-Za-z]", text):
            ends.append(ends[-1] + len(token))
        index = infill.Checkpoints(np.frombuffer(text.encode(), dtype=np.uint8), every=r.choice([1, 2, 3, 7]), window=r.choice([1, 2, 3, 5, 64]))
        assert index.n == len(ends) - 1
        assert [index.code_point(k) for k in range(index.n + 1)] == ends


def test_infilled(spark, odd, small):  # noqa: F811
    r = random.Random(2)
    texts = ["<P>", "a <S> b", "x<M>", "<P", "<", "<S", ">M><P<S", "a<b>c" * 40, "S>", "é" * 9, "A" * 300_000, "日a" * 150_000, "\n\r\n \t"]
    texts += ["".join(r.choice("<>PSM aé") for _ in range(r.randint(1, 60))) for _ in range(300)]
    extra = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(texts)] + [(-5, "negative id"), (None, "no id")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(extra).unionByName(small.select("doc_id", "text")).withColumn("n", F.lit("own")).withColumn("kept", F.lit(7))
    rows = infill.infilled(docs).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == docs.count()
    assert {x.form for x in rows} == {"plain", "psm", "spm"}
    for x in rows:
        assert (x.n, x.form, x.prefix_chars, x.middle_chars, x.output) == plain_infill(x.doc_id, x.text), x.doc_id
        assert x.back == (x.text or "") and x.kept == 7


def test_infilled_empty_table(none):  # noqa: F811
    assert infill.infilled(none).count() == 0
