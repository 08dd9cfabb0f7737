"""Every query that has SQL gives the same rows as DuckDB; all others run."""

import pytest

import __spark_entry__ as entry
from tests.conftest import rounded

ORACLES = entry.oracle_sql()


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in entry.queries() if not n.startswith("p")] + ["page_map", "prompt_rows"])
def test_query(spark, data_dir, duck, name):
    df = entry.queries()[name](spark, data_dir)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    if name in ORACLES:
        chosen = ", ".join(f'"{c}"' for c in columns)
        wanted = duck.execute(f"SELECT {chosen} FROM ({ORACLES[name]})").fetchall()
        assert sorted(repr(rounded(tuple(r))) for r in rows) == sorted(repr(rounded(r)) for r in wanted)
