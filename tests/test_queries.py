"""Every query of the library proper against its SQL, on the smallest tables."""

import duckdb
import pytest

from cadenza.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem", "part", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    expected = con.execute(SQL[name])
    names = [c[0] for c in expected.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    rows = sorted((tuple(r[c] for c in names) for r in got.collect()), key=key)
    for a, b in zip(rows, sorted(expected.fetchall(), key=key), strict=True):
        assert a == pytest.approx(b, abs=2e-6, nan_ok=True) if all(isinstance(x, (int, float)) for x in (*a, *b)) else a == b


def test_checked_arithmetic_of_large_keys(spark, tmp_path):
    """Keys whose inner products overflow 64 bits, which the smallest tables lack."""
    keys = [None, 0, 1, 5, 6, 1023, 1024, 1414, 1415, 2000, 2001, 20_000, 2_000_000, 2_000_001, 2**42 - 1]
    spark.createDataFrame([(k,) for k in keys], "p_partkey bigint").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES["checked_arithmetic"](spark, str(tmp_path)).collect()]
    key = lambda r: (r[0] is None, r[0])
    assert sorted(got, key=key) == sorted(con.execute(SQL["checked_arithmetic"]).fetchall(), key=key)
