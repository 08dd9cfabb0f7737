import math
import random

import pytest

from lectern.llm.topn import band_edges, top_n_per_group


def brute(rows, n):
    best = {}
    for g, t, s in rows:
        if g is not None and t is not None and s is not None and not math.isnan(s):
            best.setdefault(g, {})
            best[g][t] = max(s, best[g].get(t, -math.inf))
    return sorted((g, t) for g, ts in best.items() for t, _ in sorted(ts.items(), key=lambda x: (-x[1], x[0]))[:n])


@pytest.mark.parametrize("n", [1, 5])
def test_against_brute_force(spark, n):
    rnd = random.Random(n)
    rows = [("hot", k, rnd.choice([0.5, 0.7, 0.9])) for k in range(3000)]
    rows += [(f"g{rnd.randrange(300)}", 10_000 + k, rnd.choice([None, math.nan, math.inf, round(rnd.random(), 2), 1.5])) for k in range(4000)]
    rows += [(None, 99_999, 1.0), ("x", None, 1.0), ("tiny", 1, -3.0), ("tiny", 1, -3.0)] + rows[:500]
    df = spark.createDataFrame(rows, "name string, key bigint, score double")
    got = top_n_per_group(df, "name", "score", "key", n)
    assert sorted((r["name"], r["key"]) for r in got.collect()) == brute(rows, n)


def test_clashing_names_and_empty(spark):
    df = spark.createDataFrame([("a", 1, 0.5, 7, 8), ("a", 2, 0.6, 7, 8)], "_g string, _t bigint, _s double, count int, _r int")
    assert [r["_t"] for r in top_n_per_group(df, "_g", "_s", "_t", 1).collect()] == [2]
    assert top_n_per_group(df.where("false"), "_g", "_s", "_t", 1).count() == 0
    assert band_edges(df.where("false"), "_s") == []
    with pytest.raises(ValueError):
        top_n_per_group(df, "_g", "_s", "_t", 0)


def test_tie_with_two_scores(spark):
    """A tie stored with scores of two bands fills one place of its group."""
    rows = [("a", k, 9.0) for k in (1, 2, 3, 4)] + [("a", 1, 5.0), ("a", 5, 1.0)] + [("b", k, s) for k, s in enumerate([8.5, 5.0, 5.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "name string, key bigint, score double")
    got = top_n_per_group(df, "name", "score", "key", 5, shares=(0.3, 0.5))
    assert sorted((r["name"], r["key"]) for r in got.collect()) == brute(rows, 5)


def test_crowded_group_and_repeated_key(spark):
    """One tie under many scores doesn't push others out, and a key with two scores in one band fills one place."""
    rows = [("a", 1, 0.9 - k / 1000) for k in range(40)] + [("a", k, k / 100) for k in range(2, 9)]
    rows += [("b", 5001, 0.999), ("b", 5001, 0.97), ("b", 5002, 0.2)] + [("f", k, k / 1000) for k in range(1000)]
    df = spark.createDataFrame(rows, "name string, key bigint, score double").repartition(3)
    for n in (2, 5):
        got = top_n_per_group(df, "name", "score", "key", n)
        assert sorted((r["name"], r["key"]) for r in got.collect()) == brute(rows, n)


def test_hot_group_is_cut_down_before_the_shuffle(spark):
    """The rows of a group leave a task as its few best of every band, whatever the group's size."""
    df = spark.range(200_000, numPartitions=8).selectExpr("if(id % 10 = 0, 'hot', concat('g', id % 5000)) name", "id key", "hash(id) % 1000 / 1000D score")
    got = top_n_per_group(df, "name", "score", "key", 5)
    assert "Range" not in got._jdf.queryExecution().toString()  # only the written survivors are left to rank
    top = df.selectExpr("name", "key", "row_number() over (partition by name order by score desc, key) r").where("r <= 5")
    assert sorted(map(tuple, got.select("name", "key").collect())) == sorted(map(tuple, top.select("name", "key").collect()))
