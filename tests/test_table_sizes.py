"""Queries whose results depend on how large keys and tables are, on made tables of other sizes than those of the test data."""

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.functions import fmt
from gridloom.plans.registry import ORACLE, QUERIES


def both(spark, folder, name, table):
    """Rows of a query and of its SQL over one table of the folder."""
    df = QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
    columns = ", ".join(f'"{c}"' for c in df.columns)
    return sorted(map(tuple, df.collect()), key=str), sorted(con.sql(f"SELECT {columns} FROM ({ORACLE[name]})").fetchall(), key=str)


def test_sizes_of_large_keys(spark, tmp_path):
    """529937955000 ends in a 5 that its double, scaled, lies below; from key 262144 on sizes are over 1024 GB."""
    keys = [0, 1, 7, 8, 181992, 262143, 262144, 899999, 8999999, 750_000_000, None]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got, want = both(spark, tmp_path, "fmt_bytes", "orders")
    assert got == want
    assert {r[0]: r[1:] for r in got}[262144] == ("1024 GB", "1099512.41M") and {r[0]: r[2] for r in got}[181992] == "529937.95M"


@pytest.mark.parametrize("n,size", [(1536, "1.5 KB"), (1024**4 - 1, "1024.0 GB"), (1024**4, "1 TB"), (3 * 1024**4 // 2, "1.5 TB"), (5000 * 1024**4, "5000 TB")])
def test_last_unit(spark, n, size):
    assert spark.range(1).select(fmt.byte_size(F.lit(n))).first()[0] == size


@pytest.mark.parametrize("rows", [0, 3, 4, 5, 502, 1001])
def test_view_of_rows_that_four_does_not_divide(spark, tmp_path, rows):
    vectors = [(k, [((k * 64 + x) * 7919 % 4096) / 4096 - 0.5 for x in range(64)]) for k in range(rows)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got, want = both(spark, tmp_path, "viewport_nearest", "embeddings")
    assert got == want and len(got) == (400 if rows >= 4 else 0)
