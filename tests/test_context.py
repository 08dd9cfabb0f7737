"""Contexts: texts are brought together in batches, by the chunk store alone, and leave no shuffle files."""

import os
import time

import pytest

import __spark_entry__ as entry
from lectern import common
from lectern.operators import assemble
from lectern.plans import search
from tests.conftest import rounded


def same_as_sql(spark, data_dir, duck, name):
    df = entry.queries()[name](spark, data_dir)
    chosen = ", ".join(f'"{c}"' for c in df.columns)
    wanted = duck.execute(f"SELECT {chosen} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(repr(rounded(tuple(r))) for r in df.collect()) == sorted(repr(rounded(r)) for r in wanted)


@pytest.mark.parametrize("name", ["context_group", "prompt_rows", "appendix"])
def test_batches_give_all_rows(spark, data_dir, duck, monkeypatch, name):
    monkeypatch.setattr(search, "BATCH_LEAST", 2000)
    monkeypatch.setattr(search, "BATCH_CHUNKS", 0)
    parts, made = [], search.batches
    monkeypatch.setattr(search, "batches", lambda *a: parts.append(made(*a)) or parts[-1])
    same_as_sql(spark, data_dir, duck, name)
    assert len(parts[0]) > 2


def test_batches_follow_the_tables(spark):
    hits = spark.range(300_000).selectExpr("id % 1000 AS query_id", "1 AS rank", "id")
    assert len(search.batches(hits, 2, spark.range(250_000))) == 3 and len(search.batches(hits, 0, spark.range(250_000))) == 1
    parts = search.batches(hits, 2, spark.range(10))
    assert len(parts) == 8 and sum(p.count() for p in parts) == 300_000 and sum(p.select("query_id").distinct().count() for p in parts) == 1000


def indexes(spark):
    return {x for x in os.listdir(common.shared_dir(spark).removeprefix("file://")) if x.startswith("lectern-index-")}


@pytest.mark.parametrize("name", ["context_group", "prompt_rows", "appendix", "report_refs", "report_files"])
def test_contexts_need_no_index(spark, data_dir, tmp_path, name):
    os.symlink(data_dir, tmp_path / "tables")
    before = indexes(spark)
    assert entry.queries()[name](spark, str(tmp_path / "tables")).count() and indexes(spark) == before


def test_report_files_store_no_texts(spark, data_dir, tmp_path):
    os.symlink(data_dir, tmp_path / "tables")
    folder = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    assert entry.queries()["report_files"](spark, str(tmp_path / "tables")).count() and set(os.listdir(folder)) == before


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_references_move_rows_once(spark, data_dir):
    assert shuffles(search.run_hits(spark, data_dir, 30)) == 1
    hits, named = spark.range(9).selectExpr("id % 3 AS query_id", "id"), spark.range(9).selectExpr("id", "'a' AS doc_name")
    found = assemble.number_references(assemble.hit_documents(hits, named))
    assert shuffles(found) - shuffles(hits.join(named, "id")) == 1 and sorted(map(tuple, found.collect())) == [(k, "a", 1) for k in range(3)]


def test_copies_of_a_result_take_no_place(spark, tmp_path):
    rows = [(1, 7, 11, 0.5)] * 4 + [(2, 7, 12, 0.9)] * 3 + [(4, 7, 14, 0.5), (3, 7, 11, 0.5), (5, 7, 15, float("nan")), (6, 7, 16, None), (7, 7, 17, 0.0), (8, None, 18, 0.9), (9, 8, 19, 0.1)]
    spark.createDataFrame(rows, "result_id bigint, run_id bigint, id bigint, relevance_score double").repartition(5).write.parquet(str(tmp_path / "results.parquet"))
    every = [(7, 1, 12, 0.9), (7, 2, 11, 0.5), (7, 3, 11, 0.5), (7, 4, 14, 0.5), (8, 1, 19, 0.1)]
    for k in (None, 1, 2, 3, 30):
        assert sorted(map(tuple, search.run_hits(spark, str(tmp_path), k).collect())) == [r for r in every if r[1] <= (k or 30)]


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(f.startswith("shuffle_") for d in folders for _, _, files in os.walk(str(d)) for f in files)


def test_shuffle_files_of_a_write_are_removed(spark):
    before, setting = shuffle_files(spark), spark.conf.get(common._CLEANUP, None)
    df = spark.range(10_000).repartition(3, "id")
    plan = common.materialize(df.groupBy((df.id % 10).alias("k")).count())
    for _ in range(40):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.25)
    assert shuffle_files(spark) <= before and plan.count() == 10 and spark.conf.get(common._CLEANUP, None) == setting
