"""The pipeline, stage by stage, against plain versions."""

import random
from collections import Counter

import corpus_pipeline as P
from quillmere.llm import mixing, setjoin, toxicity

from .test_operators import SF, plain_components


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(P.STAGES)
    kept = stages["toxicity"](spark, docs, SF)
    assert kept.columns == columns
    scores = {r.doc_id: r.score for r in toxicity.scored(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s < 0.3}
    unique = stages["exact_dedup"](spark, kept, SF)
    assert unique.columns == columns
    last = {}
    for r in kept.collect():
        last[r.text] = max(r.doc_id, last.get(r.text, -1))
    assert sorted(r.doc_id for r in unique.collect()) == sorted(last.values())
    apart = stages["ngram_jaccard_join"](spark, unique, SF)
    assert apart.columns == columns
    rows = [(r.doc_id, r.text) for r in unique.collect()]
    assert sorted(r.doc_id for r in apart.collect()) == sorted({c for _, _, c, _ in plain_components(rows, 5, 80)})
    mix = stages["mix_sources"](spark, apart, SF)
    assert mix.columns == columns
    copies = {r.doc_id: r.copies for r in mixing.mixed(apart).collect()}
    assert Counter(r.doc_id for r in mix.collect()) == Counter({i: n for i, n in copies.items() if n})
    import sentencepiece

    from quillmere.llm.pieces import MODEL

    model, texts = sentencepiece.SentencePieceProcessor(model_file=MODEL), {r.doc_id: r.text for r in mix.collect()}
    out = stages["sentencepiece"](spark, mix, SF).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in mix.collect())
    assert all(list(r.ids) == model.encode(texts[r.doc_id]) and r.n_pieces == len(r.ids) for r in out)


def test_run_and_empty_table(spark, tmp_path):
    assert P.run(spark, SF).count() > 0
    empty = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def near_kept(rows):
    """The least doc_id of each group linked by a Jaccard similarity of 0.8 of five-word shingles, by all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(doc_id)
    return sorted(min(g) for g in groups.values())


def test_near_copies_of_five_words_at_four_fifths(spark):
    r = random.Random(3)

    def text(n):
        return [f"w{r.randrange(10**9)}" for _ in range(n)]

    long, line, texts = text(1000), text(11), []
    texts += [long, long + text(150), long[:400] + long[550:], long[:300] + text(1) + long[301:600] + text(400)]
    for _ in range(60):  # sizes from a few words to hundreds, around the bar; half of them with a common line
        base = text(r.choice([5, 8, 12, 30, 60, 120, 250])) + (line if r.random() < 0.5 else [])
        texts.append(base)
        for _ in range(3):
            cut, copy = r.randint(0, len(base) // 4), list(base)
            if r.random() < 0.5:
                copy = copy[cut:] + text(r.randint(0, 1 + len(base) // 12))
            for _ in range(r.randint(0, 1 + len(base) // 60)):
                copy[r.randrange(len(copy))] = text(1)[0]
            texts.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(9000, None), (9001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = near_kept(rows)
    assert 1 not in expected and 2 not in expected and 60 < len(expected) < len(rows)
    assert sorted(x.doc_id for x in P.drop_near_copies(spark, docs, SF).collect()) == expected
    for block in (8, 1000):
        names = setjoin.classes(docs, 5, 80, 100, block).select("component_id").distinct().collect()
        assert sorted(x.component_id for x in names) == expected


def test_near_copies_with_null_ids_and_repeats(spark):
    r = random.Random(9)
    base = [f"w{r.randrange(10**9)}" for _ in range(100)]
    near = lambda k: " ".join([*base[:k], "x", *base[k + 1 :]])
    other = " ".join(f"v{r.randrange(10**9)}" for _ in range(50))
    rows = [(None, near(3)), (None, near(90)), (5, near(50)), (6, near(60)), (None, other), (None, other), (7, None), (None, None), (8, ""), (7, near(20)), (None, "alone")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = P.drop_near_copies(spark, docs, SF)
    assert out.columns == docs.columns
    kept = Counter((x.doc_id, x.text) for x in out.collect())
    assert kept == Counter([(5, near(50)), (None, other), (None, other), (7, None), (None, None), (8, ""), (None, "alone")])
    only = docs.where("doc_id is null and text like '%x%'")
    assert P.drop_near_copies(spark, only, SF).count() == 1
