import random

import pytest

from lectern.llm import spans


def brute(rows, length):
    texts = {k: t for k, t in rows if k is not None and t is not None}
    where = {}
    for k, t in texts.items():
        for i in range(len(t) - length + 1):
            where.setdefault(t[i : i + length], set()).add(k)
    out = set()
    for k, t in texts.items():
        at = sorted(i for i in range(len(t) - length + 1) if len(where[t[i : i + length]]) > 1)
        start = None
        for n, i in enumerate(at):
            start = i if start is None else start
            if n + 1 == len(at) or at[n + 1] > i + length:
                out.add((k, start, i + length))
                start = None
    return out


@pytest.mark.parametrize(("length", "often"), [(1, 8), (5, 2), (50, 8), (200, 3)])
def test_against_brute_force(spark, monkeypatch, length, often):
    monkeypatch.setattr(spans, "HOT_TIMES", often)
    rnd = random.Random(length)
    letters = "ab" if length > 5 else "abcdefghij"
    notices = ["".join(rnd.choice(letters + "é😀 ") for _ in range(length * 2 + rnd.randint(0, 40))) for _ in range(5)]
    rows = []
    for k in range(50):
        text = "".join(rnd.choice(letters + "cdefgh") for _ in range(rnd.randint(0, 3 * length)))
        for _ in range(rnd.randint(0, 3)):
            n = rnd.choice(notices)
            a = rnd.randint(0, len(n) // 3)
            text += n[a : rnd.randint(a, len(n))] + rnd.choice(["", "#", str(k)])
        rows.append((k, text))
    rows += [(60, "-" * (3 * length)), (61, "-" * (2 * length)), (62, "xy" * length), (63, "xy" * length + "z"), (70, None), (71, ""), (None, notices[0]), rows[1], (72, "q" * length * 2)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "key bigint, body string, id int, pos int")
    got = [tuple(r) for r in spans.shared_spans(df, "key", "body", length).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, length)


def test_amount(spark):
    df = spark.createDataFrame([(1, "x" * 3 + "abcdefgh"), (2, "abcdefgh"), (3, None), (4, "")], "id bigint, text string")
    got = {r["id"]: (r["shared"], round(r["share"], 3)) for r in spans.shared_amount(df, length=6).collect()}
    assert got == {1: (8, 0.727), 2: (8, 1.0), 3: (0, 0.0), 4: (0, 0.0)}
    assert spans.shared_spans(df.where("false")).count() == 0


def test_a_notice_in_many_texts_is_spread(spark):
    """The places of a span that stands in very many texts have names of their own, so that no task gets them all."""
    rnd = random.Random(1)
    notice = "".join(rnd.choice("abcdefgh ") for _ in range(300))
    rows = [(k, "".join(rnd.choice("xyz ") for _ in range(100)) + notice) for k in range(400)]
    df = spark.createDataFrame(rows, "id bigint, t string")
    hot = spans._hot_names(df, 0.5, 200, spans._seeds)
    assert len(hot)
    named = spans._seeds(df, 200, hot).groupBy("name").count()
    assert named.agg({"count": "max"}).first()[0] <= 8
    got = {tuple(r) for r in spans.shared_spans(df.withColumnRenamed("t", "text")).collect()}
    assert got == {(k, a, b) for k, a, b in brute(rows, 200)}
