"""The registered log queries against their SQL, and the entry points."""

import os

import duckdb
import pytest

import __spark_entry__
from framelake.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["txn", "min_seq", "max_seq", "n_records", "frame_len"]
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert set(catalog.oracle_sql()) == set(catalog.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    want = con.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    """520,000 events: the last 8 MB of a file, be it written by transactions or by appends, then has over 218,000 records."""
    folder = tmp_path_factory.mktemp("many")
    duckdb.sql(f"COPY (SELECT event_id + 1000 * k AS event_id, ts, user_id, event_type, value, props FROM range(520) t(k), '{DATA}/events.parquet' ORDER BY 1) TO '{folder}/events.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["append_commit", "log_records", "schema_resolve", "seq_lookup"])
def test_query_on_files_of_very_many_records(spark, many, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        con = duckdb.connect()
        con.sql(f"CREATE VIEW events AS SELECT * FROM '{many}/events.parquet'")
        want = con.sql(catalog.oracle_sql()[name])
        got = catalog.queries()[name](spark, many).select(want.columns).toArrow()
        con.register("got", got)
        con.sql(f"CREATE TABLE want AS {catalog.oracle_sql()[name]}")
        assert con.sql("(SELECT * FROM got EXCEPT ALL SELECT * FROM want) UNION ALL (SELECT * FROM want EXCEPT ALL SELECT * FROM got)").fetchall() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
