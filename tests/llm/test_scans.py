import random

import pytest

from lectern.llm import scans

WORDS = "household family pattern mother quietly recorded anxiety during winter letter between session measured village question carpenter".split()


def body(rnd, n=60):
    return " ".join(rnd.choice(WORDS) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(2)
    rows = [(k, body(rnd) + " A half-sister wrote.", f"Doc {k % 9}", None) for k in range(300)]
    header = [(400 + k, body(rnd, 20)[:-1] + "\nANNALS OF VILLAGE LIFE\nsession measured winter.", f"Title {k}", k) for k in range(6)]
    rows += header
    rows += [
        (500, "The mother quiet-\nly recorded the letter of the half-\nsister during winter.", "A", 1),
        (501, "The farnily measured the vi|lage during wintcr.", "A", 2),
        (502, "The mother measured\n- 12 -\nthe village during winter.", "A", 3),
        (503, "1987\n\nThe mother measured the village.", "A", 4),
        (504, "DISCUSSION\n\nThe mother measured the village.", "A", 5),
        (505, "The mother soft\xad\nened the letter.\n\n   xiv\n\nThe session during winter.", "A", 6),
        (506, None, "A", 7),
        (507, " \n ", None, None),
        (508, "Plain text of the mother.", None, None),
        (509, "The mother recorded the\nQuiet Pattern   31\nletter of the village.", "Quiet_Pattern_Chapter1_2", 30),
        (None, "- 1 -", "A", 1),
    ]
    rows += [rows[-11]]
    return spark.createDataFrame([(*r, "kind") for r in rows], "id bigint, text string, doc_name string, page int, kind string")


@pytest.fixture(scope="module")
def kinds(table):
    return sorted(map(tuple, scans.scan_noise(table).collect()))


@pytest.fixture(scope="module")
def repaired(table):
    return {r["id"]: r["text"] for r in scans.repair_scans(table).collect()}


def test_kinds(kinds):
    got = {}
    for k, kind in kinds:
        got.setdefault(k, set()).add(kind)
    assert {k: v for k, v in got.items() if k < 400} == {}
    assert all(got[400 + k] == {"header"} for k in range(6))
    assert {k: v for k, v in got.items() if k >= 500} == {500: {"hyphen"}, 501: {"char"}, 502: {"pageno"}, 505: {"hyphen", "pageno"}, 509: {"header", "pageno"}}


def test_repair(repaired):
    got = repaired
    assert got[500] == "The mother quietly recorded the letter of the half-sister during winter."
    assert got[501] == "The family measured the village during winter."
    assert got[502] == "The mother measured the village during winter."
    assert got[505] == "The mother softened the letter.\n\nThe session during winter."
    assert got[509] == "The mother recorded the letter of the village."
    assert "ANNALS" not in got[400] and 504 not in got


def test_distance_and_index(spark):
    assert scans.distance("farnily", "family") == scans.CONFUSION_COST
    assert scans.distance("fomily", "family") > scans.MOST_COST
    words = spark.createDataFrame([("family", 90), ("farnily", 2), ("village", 9), ("fomily", 1), ("vi1lage", 1), ("v111age", 1), ("p1e", 1), ("x" * 50, 1)], "word string, n bigint")
    got = {r["word"]: [p["word"] for p in r["printed"]] for r in scans.corrections(words).collect()}
    assert got == {"farnily": ["family"], "vi1lage": ["village"], "v111age": ["vlllage"]}


def test_words_beyond_the_known_ones(table, kinds, repaired, monkeypatch):
    """What is found doesn't depend on how many words the tasks know beforehand."""
    monkeypatch.setattr(scans, "KNOWN_WORDS", 3)
    rows = scans.repair_scans(table).collect()
    assert {r["id"]: r["text"] for r in rows} == repaired
    assert sorted((r["id"], k) for r in rows for k in r["kinds"]) == kinds


def test_empty(spark, table):
    assert scans.scan_noise(table.where("false")).count() == 0
    assert scans.repair_scans(table.where("false")).count() == 0
