import __spark_entry__ as entry
import pytest
from kmerloom import queries as core

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "lineitem", "events")


def rows(values):
    return sorted(map(repr, values))


def plain(v):
    return int(v) if isinstance(v, bool) else round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    found = db.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    want = db.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    got = df.select(*columns).collect()
    assert rows(tuple(plain(v) for v in r) for r in got) == rows(tuple(plain(v) for v in r) for r in want)


def test_entry_has_a_query_for_every_sql(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["cnt", "n_kmers"]
