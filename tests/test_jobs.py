"""The jobs against their SQL, on growing input, on repeated and broken runs, and from their command lines."""

import json
import os
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import ingest_documents, keyword_index, settings
from jobs.queries import ORACLES, QUERIES

from .conftest import ROOT
from .test_oracles import SF, duck, plain  # noqa: F401

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_job_equals_sql(spark, duck, name):  # noqa: F811
    frame = QUERIES[name](spark, SF)
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert plain([tuple(r) for r in frame.collect()], frame.columns) == plain(result.fetchall(), columns)


def add(spark, folder, rows):
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(folder)


def rows_of(frame):
    return sorted((r.id, r.doc_id, r.content, tuple(r.embedding)) for r in frame.collect())


def test_ingestion_takes_only_what_is_new(spark, tmp_path, caplog):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    text = "One word here. Another one there. " * 40
    add(spark, source, [(1, text, "en", "a", 1), (2, "Short text.", "en", None, 1), (2, "A shorter one.", "en", "b", 1), (None, "no id", "en", "a", 1), (3, "", "en", "a", 0), (4, None, "en", "a", 0)])
    first = rows_of(ingest_documents.run(spark, source, out, mark))
    assert {r[1] for r in first} == {1, 2}
    assert [r[2] for r in first if r[1] == 2] == ["A shorter one."]
    assert [r[0] for r in first if r[1] == 2] == ["b_p3_c0"]
    assert rows_of(ingest_documents.run(spark, source, out, mark)) == first  # nothing new
    add(spark, source, [(2, "Too late, another text.", "en", "c", 1), (5, "Five is new.", "de", "a", 1), (5, "Five is new.", "de", "a", 1)])
    with caplog.at_level("INFO", "ingest_documents"):
        second = rows_of(ingest_documents.run(spark, source, out, mark))
    assert set(second) - set(first) == {("a_p6_c0", 5, "Five is new.", next(r[3] for r in second if r[1] == 5))}
    assert set(first) <= set(second) and len(second) == len(first) + 1
    assert "read 3 rows, 0 without an id; wrote 1 chunks of 1 documents" in caplog.text
    # one run over everything gives the same rows
    whole = ingest_documents.run(spark, source, f"{out}-2", f"{mark}-2", ingest_documents.Settings(files_per_batch=1))
    assert {r[1] for r in rows_of(whole)} == {r[1] for r in second}


def test_a_repeated_micro_batch_replaces_its_own_rows(spark, tmp_path):
    out, s = str(tmp_path / "out"), ingest_documents.Settings(buckets=4)
    spark.createDataFrame([], ingest_documents.CHUNKS).write.partitionBy("bucket", "batch").parquet(out)
    batches = [spark.createDataFrame([(k, f"Text number {k}.", "en", "a", 1) for k in ids], COLUMNS) for ids in (range(20), range(10, 30))]
    for n in (0, 1, 1, 0):
        ingest_documents.ingest_batch(batches[n], n, out, s)
        found = ingest_documents.stored(spark, out)
        assert found.count() == found.select("doc_id").distinct().count() == (20 if n == 0 and found.where("batch = 1").isEmpty() else 30)


def test_stored_ids_are_read_from_touched_buckets_only(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.range(64).select(F.col("id").cast("string").alias("id"), F.col("id").alias("doc_id"), (F.col("id") % 8).cast("int").alias("bucket"), F.lit(0).cast("long").alias("batch"))
    spark.createDataFrame([], ingest_documents.CHUNKS).unionByName(rows, allowMissingColumns=True).write.partitionBy("bucket", "batch").parquet(out)
    known = ingest_documents.stored(spark, out).where(F.col("bucket").isin([3]) & (F.col("batch") != 7)).select("doc_id")
    assert len({os.path.dirname(f) for f in known.inputFiles()}) == 8
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ = 3", plan) and "ReadSchema: struct<doc_id:bigint>" in plan
    assert known.count() == 8


def test_keyword_index_is_replaced_as_a_whole(spark, tmp_path):
    documents, pages, out = (str(tmp_path / x) for x in ("d", "p", "out"))
    spark.createDataFrame([(1, "alpha beta alpha"), (2, None), (3, ""), (4, "Beta a320-200"), (None, "gamma gamma"), (1, "alpha")], "doc_id long, text string").write.parquet(documents)
    spark.createDataFrame([(1, "<h1>Beta</h1>"), (2, "<p>none</p>"), (3, None)], "page_id long, html string").write.parquet(pages)
    s = keyword_index.Settings(buckets=3, slices=2, rows_per_file=2)
    expected = {
        ("text_chunks", "alpha", 1, 3, 3, 1), ("text_chunks", "beta", 1, 1, 3, 2), ("text_chunks", "beta", 4, 1, 2, 2), ("text_chunks", "a320-200", 4, 1, 2, 1),
        ("text_chunks", "gamma", None, 2, 2, 1), ("image_descriptions", "beta", 1, 1, 1, 1),
    }
    for _ in range(2):
        made = keyword_index.run(spark, documents, pages, out, s)
        assert {(r.collection, r.term, r.id, r.n, r.length, r.n_rows) for r in made.collect()} == expected
    beta = spark.read.parquet(f"{out}/postings").where("collection = 'text_chunks' and term = 'beta'")
    assert "PartitionFilters" in beta._jdf.queryExecution().executedPlan().toString() and beta.count() == 2


def test_slices_grow_with_the_texts(spark, tmp_path):
    documents, pages = (str(tmp_path / x) for x in ("d", "p"))
    spark.range(400).selectExpr("id as doc_id", "repeat(concat('word', id % 7, ' '), 50) as text").write.parquet(documents)
    spark.createDataFrame([(1, "<h1>Beta</h1>")], "page_id long, html string").write.parquet(pages)
    few, many = keyword_index.Settings(buckets=1, slices=2), keyword_index.Settings(buckets=1, slices=2, chars_per_task=6000)
    rows = keyword_index.rows_of(spark.read.parquet(documents), spark.read.parquet(pages))
    assert keyword_index.slices_of(rows, few) == 2 and keyword_index.slices_of(rows, many) == 21  # 120,004 characters
    a, b = (keyword_index.run(spark, documents, pages, str(tmp_path / name), s) for name, s in (("few", few), ("many", many)))
    assert sorted(a.collect()) == sorted(b.collect())
    assert len(list((tmp_path / "few/postings/collection=text_chunks/bucket=0").glob("*.parquet"))) <= 2
    assert len(list((tmp_path / "many/postings/collection=text_chunks/bucket=0").glob("*.parquet"))) > 8
    assert keyword_index.slices_of(rows.where("false"), few) == 2


def test_a_bucket_is_made_in_several_tasks(spark, tmp_path, request):
    source, merging = str(tmp_path / "in"), "spark.sql.adaptive.coalescePartitions.enabled"
    request.addfinalizer(lambda: spark.conf.unset(merging))
    spark.conf.set(merging, "false")  # else such small tasks become one
    add(spark, source, [(i, f"Text {i}. More of it.", "en", "web", 1) for i in range(60)])
    for slices in (1, 4):
        out = ingest_documents.run(spark, source, str(tmp_path / f"out{slices}"), str(tmp_path / f"c{slices}"), ingest_documents.Settings(buckets=1, slices=slices))
        assert out.select("doc_id").distinct().count() == out.count() == 60
    files = [len(list((tmp_path / f"out{n}/bucket=0").glob("batch=*/*.parquet"))) for n in (1, 4)]
    assert files[0] == 1 < files[1]


def test_settings(tmp_path):
    path = tmp_path / "x.toml"
    path.write_text("buckets = 5\n")
    assert settings.load(keyword_index.Settings, str(path)) == keyword_index.Settings(buckets=5)
    path.write_text("bucket = 5\n")
    with pytest.raises(ValueError, match="bucket"):
        settings.load(keyword_index.Settings, str(path))
    for module, kind in (("ingest_documents", ingest_documents.Settings), ("keyword_index", keyword_index.Settings)):
        assert settings.load(kind, f"{ROOT}/jobs/{module}.toml") == kind()


def test_command_line(tmp_path):
    args = ["--documents", f"{SF}/documents.parquet", "--pages", f"{SF}/pages.parquet", "--output", str(tmp_path / "out"), "--config", f"{ROOT}/jobs/keyword_index.toml"]
    done = subprocess.run([sys.executable, "-m", "jobs.keyword_index", *args], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT, "PYSPARK_SUBMIT_ARGS": "--master local[2] pyspark-shell"}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "postings and" in done.stderr and os.path.exists(tmp_path / "out/terms/_SUCCESS")


def test_jobs_import_nothing_of_llm():
    code = "import json, sys, jobs.queries; print(json.dumps([m for m in sys.modules if '.llm' in m or m == 'corpus_pipeline']))"
    assert json.loads(subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120).stdout) == []
