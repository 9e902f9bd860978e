import __spark_entry__ as entry
import pytest

SF = {"interval_containment": "/root/testdata/sf0.01"}  # few intervals hold another with its flanks


@pytest.mark.parametrize("name", ["interval_overlaps", "interval_containment", "longest_overlap"])
def test_whole_table_with_itself(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    sf_dir = SF.get(name, "/root/testdata/sf0.001")
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    want = db.sql(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert sorted(got) == sorted(want)
    if name == "longest_overlap":
        assert len(got) == db.sql("SELECT count(*) FROM events").fetchall()[0][0]
    else:
        assert {(a % 2, b % 2) for a, b in got} == {(0, 0), (0, 1), (1, 0), (1, 1)}
