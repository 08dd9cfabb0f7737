"""The registered queries of the training-data operators over the smallest tables."""

import unicodedata

import pytest

from lectern.llm import queries
from tests.conftest import rounded


def words(text):
    out, now = [], []
    for c in (text or "").lower() + " ":
        if unicodedata.category(c)[0] in "LN":
            now.append(c)
        elif now:
            out.append("".join(now))
            now = []
    return out


@pytest.fixture(scope="module")
def chunks(duck):
    return dict(duck.execute("SELECT id, any_value(text) FROM chunk_metadata WHERE text IS NOT NULL GROUP BY id").fetchall())


def test_p1(spark, data_dir, duck):
    got = sorted(map(tuple, queries.p1_found(spark, data_dir).select("doc_name", "result_id").collect()))
    assert got == sorted(duck.execute(queries.ORACLES["p1_found"]).fetchall()) and got


def test_p2(spark, data_dir, chunks):
    found = queries.p2_found(spark, data_dir)
    assert found.columns == ["id", "kind"]
    rows = sorted(map(tuple, found.collect()))
    assert len(rows) == len(set(rows)) and {k for _, k in rows} <= {"hyphen", "char", "header", "pageno"} and {i for i, _ in rows} <= chunks.keys()
    repaired = {r["id"]: r for r in queries.p2_repaired(spark, data_dir).collect()}
    assert {(i, k) for i, r in repaired.items() for k in r["kinds"]} == set(rows)


def test_p3(spark, data_dir):
    found = sorted(map(tuple, queries.p3_found(spark, data_dir).collect()))
    repaired = queries.p3_repaired(spark, data_dir).collect()
    assert found == sorted((r["id"], r["field"]) for r in repaired) and len(found) == len(set(found)) and found


def test_p4(spark, data_dir, chunks):
    sets = {k: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for k, t in chunks.items() if len(w := words(t)) >= 20}
    keys = sorted(sets)
    wanted = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert {tuple(r) for r in queries.p4_found(spark, data_dir).select("id_a", "id_b").collect()} == wanted
    groups = queries.p4_groups(spark, data_dir).collect()
    assert {r["id"] for r in groups} == set(keys) and sum(r["links"] for r in groups) == 2 * len(wanted)


def test_p5(spark, data_dir, chunks):
    where = {}
    for k, t in chunks.items():
        for i in range(len(t) - 199):
            where.setdefault(hash(t[i : i + 200]), set()).add(k)
    wanted = {}
    for k, t in chunks.items():
        places = {p for i in range(len(t) - 199) if len(where[hash(t[i : i + 200])]) > 1 for p in (*range(i, i + 200),)}
        wanted[k] = len(places)
    got = {}
    for r in queries.p5_found(spark, data_dir).collect():
        got[r["id"]] = got.get(r["id"], 0) + r["span_end"] - r["span_start"]
    assert got == {k: n for k, n in wanted.items() if n}
    shared = {r["id"]: r["shared"] for r in queries.p5_shared(spark, data_dir).collect()}
    assert {k: n for k, n in shared.items() if n} == got


def test_p6_and_p7(spark, data_dir, duck):
    ids = {r["doc_id"]: r["ids"] for r in queries.p6_ids(spark, data_dir).collect()}
    assert len(ids) == duck.execute("SELECT count(*) FROM documents").fetchone()[0]
    rows = queries.p7_containers(spark, data_dir).collect()
    sizes, room = {}, {}
    for r in rows:
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["n_tokens"]
        room[r["container"]] = room.get(r["container"], 0) + r["n_tokens"]
    assert sizes == {k: len(v) for k, v in ids.items() if v} and max(room.values()) <= 2048


def test_p8(spark, data_dir, duck):
    rows = [rounded(tuple(r)) for r in queries.p8_found(spark, data_dir).collect()]
    known = {r[0] for r in duck.execute("SELECT doc_id FROM documents WHERE trim(text) <> ''").fetchall()}
    assert {k for (k,) in rows} <= known and len(rows) == len(set(rows)) and rows
