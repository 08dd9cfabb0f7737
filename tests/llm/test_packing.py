import random

import pytest

from lectern.llm.packing import best_fit_decreasing, pack


def plain_best_fit(sizes, capacity):
    room, out = [], []
    for s in sizes:
        fits = [(r, k) for k, r in enumerate(room) if r >= s]
        if fits:
            k = min(fits)[1]
        else:
            room.append(capacity)
            k = len(room) - 1
        room[k] -= s
        out.append(k)
    return len(room), sorted(room)


def test_tree_finds_the_tightest_bin():
    rnd = random.Random(3)
    for capacity in (1, 7, 64, 100):
        sizes = sorted((rnd.randint(1, capacity) for _ in range(300)), reverse=True)
        at = best_fit_decreasing(sizes, capacity)
        room = [capacity] * (max(at) + 1)
        for s, k in zip(sizes, at, strict=True):
            room[k] -= s
        assert (len(room), sorted(room)) == plain_best_fit(sizes, capacity)


@pytest.mark.parametrize("group_items", [50, 5000])
def test_whole_and_tight(spark, group_items):
    rnd = random.Random(5)
    sizes = [rnd.choice([0, 3, 20, 90, 100, 101, 250, 300]) or rnd.randint(1, 60) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(sizes)) + [(None, 5), (9_001, None), (9_002, 0), (9_003, -4)], "doc_id bigint, n_tokens bigint")
    rows = pack(df, capacity=100, group_items=group_items).collect()
    room, whole = {}, {}
    for r in rows:
        room[r["container"]] = room.get(r["container"], 0) + r["n_tokens"]
        whole.setdefault(r["doc_id"], []).append((r["piece"], r["n_tokens"]))
    assert max(room.values()) <= 100
    for k, n in enumerate(sizes):
        pieces = sorted(whole[k])
        assert [p for p, _ in pieces] == list(range(len(pieces))) and sum(x for _, x in pieces) == n and all(x == 100 for _, x in pieces[:-1])
    assert set(whole) == set(range(1500))
    assert len(room) <= -(-sum(sizes) // 100) * 1.02 + 2


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert pack(empty).count() == 0
    twice = spark.createDataFrame([(1, 5), (1, 7), (2, 4)], "doc_id bigint, n_tokens bigint")
    assert sorted((r["doc_id"], r["n_tokens"]) for r in pack(twice).collect()) == [(1, 7), (2, 4)]
    large = spark.createDataFrame([(k, 60) for k in range(10)], "doc_id bigint, n_tokens bigint")
    assert pack(large, capacity=100, group_items=3).select("container").distinct().count() == 10
