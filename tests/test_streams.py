"""Conversation turns and requests as streams."""

import datetime as dt
import json
from collections import Counter

from pyspark.sql import functions as F

from quillmere.operators.store import Store
from quillmere.plans.text_queries import conversation_pairs
from quillmere.service import engine
from quillmere.streaming.conversations import PAIRS, pair_stream
from quillmere.streaming.ingest import ingest
from quillmere.streaming.requests import BLANK, answer_batch, answer_stream, responses

SF = "/root/testdata/sf0.001"


def test_turns_in_any_order_make_the_pairs_of_the_whole_table(spark, tmp_path):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = "conv_id bigint, turn bigint, role string, text string"
    # the answers first, then half of the questions, then all other turns
    parts = [turns.where("role = 'assistant'"), turns.where("role = 'user' and conv_id % 2 = 0"), turns.where("role <> 'assistant' and not (role = 'user' and conv_id % 2 = 0)")]
    expected = Counter(tuple(r) for r in conversation_pairs(spark, SF).collect())
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(source)
        for _ in range(2):  # the second run has nothing new
            pair_stream(spark, source, out, mark, schema).awaitTermination()
        found = Counter(tuple(r) for r in spark.read.schema(PAIRS).parquet(out).collect())
        assert found == (Counter() if k == 0 else expected if k == 2 else Counter({p: n for p, n in expected.items() if p[0] % 2 == 0}))
    assert len(expected) > 10


def test_late_turns_expire(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    day = lambda d: dt.datetime(2024, 1, d)
    files = [
        [(1, 0, "user", "q1", day(1)), (2, 0, "user", "q2", day(1)), (1, 0, "user", "q1", day(1))],
        [(2, 1, "assistant", "a2", day(1)), (3, 0, "user", "q3", day(20))],
        [(9, 0, "user", "tick", day(21))],
        [(1, 1, "assistant", "too late", day(1)), (3, 1, "assistant", "a3", day(21))],
    ]
    for rows in files:
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ts timestamp").coalesce(1).write.mode("append").parquet(source)
        pair_stream(spark, source, out, mark).awaitTermination()
    assert {tuple(r) for r in spark.read.schema(PAIRS).parquet(out).collect()} == {(2, 0, "q2", "a2"), (3, 0, "q3", "a3")}


class Failing:
    def generate(self, prompt, temperature, max_tokens, system=None):
        if "bird" in prompt.rsplit("**Question:**", 1)[1]:
            raise RuntimeError("down")
        return "an answer"

    def describe(self, prompt, images, temperature, max_tokens):
        raise NotImplementedError


def test_requests_get_one_response_each(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    ingest(store, spark.createDataFrame([("a.pdf", 1, "The red fox runs. It is quick."), ("a.pdf", 2, "A blue bird sings.")], "file_name string, page_num int, text string"))
    made = engine(spark, store.folder, generator=Failing())
    source, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    source.mkdir()
    put = lambda name, rows: (source / name).write_text("\n".join(json.dumps({"request_id": i, "query": q}) for i, q in rows))
    put("1.json", [("r1", "Where is the red fox?"), ("r2", "  "), ("r3", "What does the bird do?"), ("r1", "Where is the red fox?"), (None, "nobody")])
    for _ in range(2):
        answer_stream(spark, made, str(source), out, mark, include_images=False).awaitTermination()
        rows = {r.request_id: r for r in responses(spark, out).collect()}
        assert {i: r.status for i, r in rows.items()} == {"r1": "answered", "r2": "rejected", "r3": "failed"}
    assert rows["r1"].answer == "an answer" and rows["r1"].error is None and {s.documentName for s in rows["r1"].sources} == {"a.pdf"}
    assert rows["r2"].error == BLANK and rows["r2"].sources is None
    assert rows["r3"].error == "down" and rows["r3"].answer == "Error generating response: down"
    put("2.json", [("r1", "Asked again?"), ("r4", "Where is the fox?")])
    answer_stream(spark, made, str(source), out, mark, include_images=False).awaitTermination()
    assert Counter(r.request_id for r in responses(spark, out).collect()) == {"r1": 1, "r2": 1, "r3": 1, "r4": 1}
    # the same micro-batch again, as after a failure
    last = responses(spark, out).agg(F.max("batch")).first()[0]
    answer_batch(spark.createDataFrame([("r1", "Asked again?"), ("r4", "Where is the fox?")], "request_id string, query string"), last, made, out, include_images=False)
    assert responses(spark, out).count() == 4
