"""Operators on inline rows: chunking, search, images, prompts, evaluation, store, service and streaming."""

import random

import pytest
from pyspark.sql import functions as F

from quillmere.config import Chunking, Prompting, load
from quillmere.operators import chunking as C
from quillmere.operators import evaluation as E
from quillmere.operators import images as I
from quillmere.operators import prompts as P
from quillmere.operators import retrieval as R
from quillmere.operators.store import Store, flattened, new_rows
from quillmere.operators.subwords import ranks_of, token_sizes
from quillmere.plans.text_queries import VOCABULARY
from quillmere.providers import described, embedding, running
from quillmere.service import answers, engine, error_text, health, search, with_footer
from quillmere.sources import files


def plain_ranges(sizes, similar, c):
    out, start, used = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and (used + n > c.max_tokens or (similar is not None and used >= c.min_tokens and similar[i] < c.threshold)):
            out.append((start + 1, i))
            keep, at = 0, i
            while at > start and keep + sizes[at - 1] <= c.overlap:
                at -= 1
                keep += sizes[at]
            start, used = at, keep
        used += n
    return [*out, (start + 1, len(sizes))] if sizes else []


def test_chunk_ranges_match_a_plain_loop(spark):
    r, c = random.Random(3), Chunking(40, 15, 0.5, 8)
    rows = [([r.randint(1, 30) for _ in range(r.randint(0, 40))],) for _ in range(120)]
    rows = [(i, s, [r.random() for _ in s]) for i, (s,) in enumerate(rows)]
    df = spark.createDataFrame(rows, "i int, sizes array<int>, sim array<double>").withColumn("sums", running(F.col("sizes")))
    for sim in (F.col("sim"), None):
        found = {x.i: [tuple(p) for p in x.r] for x in df.select("i", C.chunk_ranges(F.col("sizes"), F.col("sums"), sim, c).alias("r")).collect()}
        for i, s, m in rows:
            assert found[i] == plain_ranges(s, m if sim is not None else None, c)


@pytest.mark.parametrize(("sizes", "expected"), [([10, 600], [(1, 1), (1, 2)]), ([600], [(1, 1)]), ([], [])])
def test_chunk_fixtures(spark, sizes, expected):
    df = spark.createDataFrame([(sizes,)], "sizes array<int>").withColumn("sums", running(F.col("sizes")))
    assert [tuple(x) for x in df.select(C.chunk_ranges(F.col("sizes"), F.col("sums"), None).alias("r")).first().r] == expected


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_knn_in_blocks(spark, metric):
    r = random.Random(1)
    rows = [(i, [r.random() for _ in range(5)]) for i in range(60)] + [(60, [0.0] * 5)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    asked = df.where("id < 9").withColumnRenamed("id", "query_id")
    whole = sorted(map(tuple, R.knn(asked, df, 4, metric).collect()))
    assert whole == sorted(map(tuple, R.knn(asked, df, 4, metric, block=3).collect()))
    assert len(whole) == 36
    assert R.knn(asked.where("false"), df, 4, metric).count() == 0


def test_scores_of_equal_and_single_candidates(spark):
    df = spark.createDataFrame([(1, 1, "red fox", 0.5, "red fox runs"), (1, 2, "red fox", 0.5, "blue"), (2, 1, "red red", 0.1, "red fox"), (3, 5, "a", 0.2, "!")], "query_id int, id int, query string, distance double, content string")
    rows = {(r.query_id, r.id): r for r in R.reranked(df).collect()}
    assert rows[1, 1].semantic_score == rows[1, 2].semantic_score == 1.0
    assert rows[2, 1].keyword_score < 0
    assert rows[3, 5].keyword_score == 0.0
    assert rows[1, 1].rank == 1


def test_gate(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.86), (1, 3, 0.84), (1, 4, None)], "query_id int, rank int, score double")
    assert [r.score for r in R.gated(df).orderBy("rank").collect()] == [0.9, 0.86]


def test_images(spark):
    schema = "file_name string, page_num int, img_num int, xref int, y0 double, y1 double, page_height double, width int, height int, n_colors int"
    rows = [
        ("a", 1, 1, 7, 10.0, 50.0, 100.0, 200, 200, 9), ("a", 2, 1, 7, 10.1, 89.9, 100.0, 100, 100, 2), ("a", 3, 1, 7, 20.0, 50.0, 100.0, 200, 200, 9),
        ("b", 1, 1, 7, 20.0, 50.0, 100.0, 200, 200, 2000), ("b", 1, 2, 8, 20.0, 50.0, 100.0, 99, 100, 9), ("b", 1, 3, 9, 20.0, 50.0, 100.0, 200, 200, 1), ("b", 1, 4, 10, 20.0, 50.0, 100.0, 200, 200, None),
    ]
    kept = I.first_per_file(I.kept(spark.createDataFrame(rows, schema)))
    assert sorted((r.file_name, r.page_num, r.xref) for r in kept.collect()) == [("a", 2, 7), ("b", 1, 7), ("b", 1, 10)]
    assert kept.select(I.image_path("d", F.lit("x y.pdf"), F.lit(1), F.lit(2))).first()[0] == "d/x_y.pdf_p1_i2.png"


def test_budget_breaks_at_the_first_that_does_not_fit(spark):
    df = spark.createDataFrame([(1, 1, "f", 1, "x" * 5), (1, 2, "f", 2, "x" * 60), (1, 3, "f", 3, "x")], "query_id int, rank int, file_name string, page_num int, content string").withColumn("score", F.lit(1.0))
    size = len("[f p.1]\n```text\nxxxxx\n```")
    row = P.budgeted(df, size + 2 + 30, 5, 2000).first()
    assert (row.context, row.size) == ("[f p.1]\n```text\nxxxxx\n```", size)
    assert P.budgeted(df, 3, 5, 2000).first().size == 0


def test_prompt_without_results(spark):
    asked = spark.createDataFrame([(1, "why?")], "query_id int, query string")
    none = spark.createDataFrame([], "query_id int, rank int, file_name string, page_num int, content string, score double, image_path string")
    prompt = P.rag_prompts(asked, none, none).first().user_prompt
    assert P.NO_TEXT in prompt
    assert "**Images:**" not in prompt
    some = spark.createDataFrame([(1, 1, "f", 1, "pic", 0.5, "p")], none.schema)
    assert "**Images:**" in P.rag_prompts(asked, none, some).first().user_prompt
    assert "**Images:**" not in P.rag_prompts(asked, none, some, c=Prompting(context_budget=130)).first().user_prompt


class Judge:  # sent to the workers by value
    def __init__(self, reply):
        self.reply = reply

    def generate(self, prompt, temperature, max_tokens, system=None):
        if self.reply is None:
            raise RuntimeError("down")
        return self.reply


def test_evaluation(spark):
    rows = [("red fox", "red fox", [("red fox", None)]), ("red fox", "!", [("!", None)]), ("q", " ", [])]
    df = spark.createDataFrame(rows, "query string, answer string, contexts array<struct<content:string,text:string>>")
    plain = {r.answer: r for r in E.evaluated(df).collect()}
    assert plain["red fox"].faithfulness_score == pytest.approx(1.0)
    assert plain["!"].faithfulness_score == 0.5
    assert plain[" "].faithfulness_score == plain[" "].context_relevancy_score == 0.0
    judged = {r.answer: r for r in E.evaluated(df, Judge('{"faithfulness_score": 0.25, "questions": ["red fox"]}')).collect()}
    assert judged["red fox"].faithfulness_score == 0.25
    assert judged["red fox"].answer_relevancy_score == pytest.approx(1.0)
    for judge in (Judge(None), Judge("5"), Judge("true")):
        down = {r.answer: r for r in E.evaluated(df, judge).collect()}
        assert down["red fox"].answer_relevancy_score == 0.5
        assert down[" "].answer_relevancy_score == 0.0
        assert down["red fox"].faithfulness_score == pytest.approx(1.0)
    for reply in ('{"other": 1}', "0", "false", '"words"', "no json"):
        assert {r.answer: r.answer_relevancy_score for r in E.evaluated(df, Judge(reply)).collect()}["red fox"] is None


def test_triplets_of_unequal_length(spark):
    make = lambda name, n: spark.createDataFrame([(i, str(i)) for i in range(n)], f"position int, {name} string")
    assert E.zipped(make("query", 3), make("answer", 3), make("contexts", 3)).count() == 3
    with pytest.raises(ValueError):
        E.zipped(make("query", 3), make("answer", 2), make("contexts", 3))


def test_summary_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, None, 1.0), (2.0, None, 1.0), (4.0, 0.5, 1.0)], "faithfulness_score double, answer_relevancy_score double, context_relevancy_score double")
    row = E.summary(df).first()
    assert (row.n, row.faithfulness_score_std, row.answer_relevancy_score_mean) == (3, 1.247219, 0.5)


def test_store_service_and_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError):
        store.require_content()
    from quillmere.streaming.ingest import ingest, stream

    pages = spark.createDataFrame([("a.pdf", 1, "The red fox runs. It is quick."), ("a.pdf", 2, "A blue bird sings."), ("b.pdf", 1, "")], "file_name string, page_num int, text string")
    ingest(store, pages)
    ingest(store, pages)
    assert {r.collection: r.n for r in store.counts().collect()} == {"text_chunks": 2, "image_descriptions": 0}
    pages.write.parquet(str(tmp_path / "pages"))
    stream(spark, str(tmp_path / "pages"), store, str(tmp_path / "cp")).awaitTermination()
    assert store.read("text_chunks").count() == 2
    pictures = spark.createDataFrame([("a.pdf", 1, 1, "a fox diagram", "i/a.png")], "file_name string, page_num int, img_num int, content string, image_path string")
    store.add_images(pictures, pictures.select(F.lit("a.pdf_p1_i1").alias("id"), embedding(F.col("content")).alias("embedding")))
    asked = spark.createDataFrame([(1, "Where is the red fox?"), (2, "  ")], "query_id int, query string")
    rows = answers(store, asked).collect()
    assert len(rows) == 1
    assert [s.documentName for s in rows[0].sources] == ["a.pdf", "a.pdf", "[Image] a.pdf"]
    assert len(answers(store, asked, include_images=False).first().sources) == 2
    assert health(store)["vectorDBStats"] == {"textChunks": 2, "images": 1}
    assert health(None)["status"] == "error"
    with pytest.raises(ValueError):
        store.add_images(pictures, pictures.select(F.lit("other").alias("id"), embedding(F.col("content")).alias("embedding")))
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path / "s2"), "manhattan")
    assert store.read("text_chunks").first().metadata["file_name"] == "a.pdf"
    assert store.read("image_descriptions").first().metadata["image_path"] == "i/a.png"
    assert Store(spark, str(tmp_path / "s3"), "l2").metric == Store(spark, str(tmp_path / "s3")).metric == "l2"
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path / "s3"), "cosine")
    twice = spark.createDataFrame([("n1", "b"), ("n1", "a"), ("n2", "c")], "id string, content string")
    assert sorted(r.content for r in new_rows(twice, store.read("text_chunks")).collect()) == ["a", "c"]
    results = spark.createDataFrame([(1, 1, "a.pdf", 3)], "query_id int, rank int, file_name string, page_num int")
    shown = with_footer(spark.createDataFrame([(1, "yes"), (2, "no")], "query_id int, answer string"), results, results)
    assert {r.query_id: r.answer for r in shown.collect()} == {1: "yes\n\n**Sources:**\n1. a.pdf, Page 3\n2. a.pdf, Page 3 (Image)", 2: "no"}
    store.clear()
    assert store.read("text_chunks").count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one\x0ctwo")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.pdf").write_bytes(b"x")
    (tmp_path / "p.png").write_bytes(b"png")
    found = files.pdf_files(spark, str(tmp_path))
    pages = files.pages(found, lambda b: b.decode().split("\x0c"))
    assert sorted(map(tuple, pages.collect())) == [("a.pdf", 1, "one"), ("a.pdf", 2, "two")]
    placed = files.images(found, lambda b: [(1, 1, 5, 1.0, 2.0, 9.0, 10, 10, 3, b)])
    assert placed.first().xref == 5
    (tmp_path / "q.json").write_text('{"queries": [\n{"id": 1, "query": "a"}, {"id": 2, "query": "b"}]}')
    assert files.query_set(spark, str(tmp_path / "q.json")).count() == 2
    (tmp_path / "sub" / "p.png").write_bytes(b"other")
    hits = spark.createDataFrame([(1, 1, "x/missing.png"), (1, 2, "p.png"), (1, 3, f"{tmp_path}/sub/p.png"), (1, 9, "p.png")], "query_id int, rank int, image_path string")
    assert [bytes(b) for b in files.image_bytes(spark, hits, str(tmp_path)).first().images] == [b"png", b"other"]
    assert files.image_bytes(spark, hits.where("rank = 1"), str(tmp_path)).count() == 0
    assert files.served_image(spark, str(tmp_path), "../p.png") == b"png"
    assert files.served_image(spark, str(tmp_path), "none.png") is None


def test_config_and_errors(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("retrieval:\n  top_k_final: 4\n  unknown: 1\nother: {}\n")
    assert load(str(tmp_path / "c.yaml")).retrieval.top_k_final == 4
    assert load(str(tmp_path / "c.yaml")).chunking == Chunking()
    df = spark.createDataFrame([(None,), (503,), (500,)], "s int").select(error_text(F.col("s")).alias("t"))
    assert len({r.t for r in df.collect()}) == 3
    merged = spark.createDataFrame([({"page_num": "9"},)], "m map<string,string>")
    assert merged.select(flattened({"file_name": F.lit("a"), "page_num": F.lit(1)}, F.col("m")).alias("m")).first().m == {"file_name": "a", "page_num": "9"}


class Seer:
    """Describes and answers by what it is given; fails on one image."""

    def generate(self, prompt, temperature, max_tokens, system=None):
        return "text only"

    def describe(self, prompt, images, temperature, max_tokens):
        if images[0] == b"broken":
            raise RuntimeError("down")
        return f"{len(images)} of {images[0].decode()} fox {'fox runs' in prompt}"


def test_folder_to_answers_with_images(spark, tmp_path):
    from quillmere.streaming.ingest import ingest_folder

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "my book.pdf").write_bytes(b"The red fox runs. It is quick.\x0cA blue bird sings.\x0c")
    place = lambda page, n, xref, png, y0=20.0, colors=9: (page, n, xref, y0, 50.0, 100.0, 200, 200, colors, png)
    placed = [place(1, 1, 7, b"one"), place(2, 1, 7, b"one"), place(2, 2, 8, b"broken"), place(1, 2, 9, b"x", y0=1.0), place(1, 3, 10, b"x", colors=1)]
    store, pictures = Store(spark, str(tmp_path / "store")), str(tmp_path / "pictures")
    with pytest.raises(ValueError):
        engine(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError):
        engine(spark, str(tmp_path / "nowhere"))
    for _ in range(2):
        out = ingest_folder(spark, store, str(tmp_path / "in"), pictures, generator=Seer(), page_reader=lambda b: b.decode().split("\x0c"), image_reader=lambda b: placed).first()
        assert tuple(out) == (3, 1, 1, 2)
    assert (tmp_path / "pictures" / "my_book.pdf_p1_i1.png").read_bytes() == b"one"
    rows = {r.id: r for r in store.read("image_descriptions").collect()}
    assert rows["my book.pdf_p1_i1"].content == "1 of one fox True"
    assert rows["my book.pdf_p2_i2"].content == "Image from page. Context: A blue bird sings."
    assert rows["my book.pdf_p1_i1"].metadata["xref"] == "7"
    made = engine(spark, str(tmp_path / "store"), generator=Seer())
    assert made.health()["vectorDBStats"] == {"textChunks": 2, "images": 2}
    asked = spark.createDataFrame([(1, "red fox picture")], "query_id int, query string")
    assert made.answers(asked, image_folder=pictures).first().answer.startswith("1 of one") or made.answers(asked, image_folder=pictures).first().answer == "text only"
    assert made.answers(asked, include_images=False, image_folder=pictures).first().answer == "text only"
    texts, _ = search(Store(spark, str(tmp_path / "store")), asked)
    assert texts.count() == 2


def test_descriptions_without_image_input(spark):
    df = spark.createDataFrame([(b"x", "some words"), (b"x", "")], "content binary, context string")
    found = [r[0] for r in df.select(described(F.col("content"), F.col("context"), "general")).collect()]
    assert found == ["Image from general document. Context: some words", "Image from general document. Context: No context available"]


class Broken:
    def embed(self, texts):
        raise RuntimeError("down")


def test_chunks_by_subwords_and_without_an_embedder(spark):
    docs = spark.createDataFrame([(1, " ".join(f"Internationalization number {i} is here." for i in range(300)))], "doc_id int, text string")
    by_tokens = C.chunks(docs, semantic=False).collect()
    assert C.chunks(docs, model=Broken()).collect() == by_tokens
    counter = token_sizes(ranks_of(spark, VOCABULARY))
    small = C.chunks(docs, semantic=False, tokens=counter).collect()
    assert len(small) > len(by_tokens)
    assert all(r.n_tokens <= 512 for r in small)
