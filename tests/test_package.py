import pytest

import __spark_entry__ as entry
import tidemark

SF = "/root/testdata/sf0.001"


def test_version():
    assert tidemark.__version__ == "0.1.0"


def test_entry(spark):
    assert entry.entry(spark).count() == 1000


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    names = sorted(df.columns)
    found = con.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in found.description].index(n) for n in names]
    expected = sorted(repr([_plain(r[k]) for k in at]) for r in found.fetchall())
    assert sorted(repr([_plain(r[n]) for n in names]) for r in df.collect()) == expected


def _plain(v):
    return round(float(v), 6) + 0.0 if isinstance(v, float) else v
