import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import index
from lectern.sources import readers, transcripts, writers
from lectern.streaming import incremental


def test_texts_in_any_encoding(spark, tmp_path):
    (tmp_path / "a b.txt").write_bytes("é".encode())
    (tmp_path / "c.txt").write_bytes("é x".encode("utf-16"))
    (tmp_path / "d.md").write_text("no")
    got = {r["doc_name"]: r["content"].lstrip("﻿") for r in readers.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"a b": "é", "c": "é x"}
    assert readers.decode(b"\xe9") == "é"


def test_pdfs(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"one|  |three")
    (tmp_path / "y.pdf").write_bytes(b" ")
    got = readers.read_pdfs(spark, str(tmp_path), lambda b: b.decode().split("|")).collect()
    assert [(r["doc_name"], r["content"]) for r in got] == [("x", "[PDF_PAGE:1]one\n[PDF_PAGE:3]three")]


def test_chunk_store_of_an_older_build(spark, tmp_path):
    path = tmp_path / "chunks.json"
    path.write_text(json.dumps([{"id": 0, "doc_name": "d", "text": "t"}]))
    assert readers.read_chunks(spark, str(path)).first()["page"] is None
    with pytest.raises(Exception):
        readers.read_chunks(spark, str(tmp_path / "missing.json")).count()


def test_rules(spark, tmp_path):
    path = tmp_path / "tiers.yml"
    path.write_text("# c\ntiers:\n  - pattern: \"A # b\"\n    multiplier: 3.0  # x\n  - pattern: C\n    multiplier: 1.15\n    note: n\n")
    assert [tuple(r) for r in readers.read_rules(spark, str(path), "multiplier").orderBy("ord").collect()] == [(1, "A # b", 3.0), (2, "C", 1.15)]
    assert readers.read_rules(spark, str(tmp_path / "none.yml"), "author").count() == 0
    with pytest.raises(ValueError):
        readers.parse_rules("- patterns: [a]\n  multiplier: 1", "multiplier")


def test_eval_cases_and_transcripts(spark, tmp_path):
    (tmp_path / "evals.json").write_text(json.dumps({"evals": [{"id": 1, "prompt": "p", "files": []}]}))
    assert readers.read_eval_cases(spark, str(tmp_path / "evals.json")).first()["prompt"] == "p"
    deep = tmp_path / "t" / "u"
    deep.mkdir(parents=True)
    (deep / "one-yaml.md").write_text("---\nTitle: T\n---\n## Section 1 – A\nbody text")
    (deep / "test-yaml.md").write_text("skipped")
    (deep / "two-yaml.md").write_text("no sections")
    got = transcripts.import_transcripts(readers.read_transcripts(spark, str(tmp_path / "t"))).collect()
    assert [(r["file_name"], r["sections"], r["words"]) for r in got] == [("T.txt", 1, 7)]
    writers.write_texts(got and spark.createDataFrame(got).withColumnRenamed("stem", "path").select("file_name", "text"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "T.txt").read_text().startswith("## Section 1")
    files = spark.createDataFrame([("a.txt", "x"), ("b.txt", None)], "file_name string, text string")
    assert writers.write_texts(files, str(tmp_path / "dry"), dry_run=True) == 2 and not (tmp_path / "dry").exists()


def test_index_and_embeddings(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "red green"), (2, "red blue"), (3, None)], "id bigint, text string")
    fitted = index.bm25(chunks)
    path = str(tmp_path / "i")
    writers.save_index(chunks, {"bm25": fitted}, path, index.all_words(chunks))
    loaded = readers.load_model(spark, path, "bm25")
    assert loaded.n == 3 and sorted(map(tuple, loaded.weights.collect())) == sorted(map(tuple, fitted.weights.collect()))
    assert sorted(map(tuple, loaded.vocabulary.collect())) == sorted(map(tuple, fitted.vocabulary.collect()))
    assert readers.load_chunks(spark, path).count() == 3 and readers.load_words(spark, path).count() == 4
    empty = chunks.where("false")
    writers.save_index(empty, {"tfidf": index.tfidf(empty)}, path)
    assert readers.load_model(spark, path, "tfidf").n == 0
    row = index.index_metrics(chunks.withColumn("doc_name", F.lit("d")), fitted.vocabulary).first()
    assert tuple(row) == (3, 1, 3, 0, False, False)
    vectors = writers.build_embeddings(chunks, lambda: lambda texts: [[float(len(t))] for t in texts]).collect()
    assert {r["chunk_id"]: list(r["embedding"]) for r in vectors} == {1: [9.0], 2: [8.0], 3: [0.0]}


def test_incremental_chunks(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for k in (1, 2):
        spark.createDataFrame([(k, "One. Two.")], "doc_id bigint, text string").write.mode("append").parquet(source)
        incremental.chunk_stream(spark, source, target, state).awaitTermination()
        assert sorted(r["doc_id"] for r in spark.read.parquet(target).select(F.col("doc_id")).collect()) == list(range(1, k + 1))
