"""The volume of events covers every day and type that there is, in Spark as in SQL."""

import datetime as dt

import duckdb
import pandas as pd

from gridloom.plans import registry, views


def test_volume_covers_all_days_and_types(spark, tmp_path):
    at = [dt.datetime(2023, 12, 30, 23, 59, 59), dt.datetime(2024, 1, 1), dt.datetime(2024, 3, 2, 5), dt.datetime(2024, 3, 2, 5, 30), None, dt.datetime(2024, 1, 5)]
    kinds = ["view", "refund", "click", "click", "view", None]
    rows = pd.DataFrame({"event_id": range(6), "ts": pd.Series(at, dtype="datetime64[us]"), "user_id": 1, "event_type": kinds, "value": [1.5, 2.0, None, 4.25, 5.0, 6.0], "props": "{}"})
    rows.to_parquet(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = con.sql(views.sql("V", "SELECT d, h, k, v FROM V")).fetchall()
    got = [tuple(r) for r in views.volume(spark, str(tmp_path)).collect()]
    assert len(got) == 64 * 24 * 3 and sorted(got, key=str) == sorted(want, key=str)
    assert {r[:3]: r[3] for r in got if r[3] is not None} == {(0, 23, 2): 1.5, (2, 0, 1): 2.0, (63, 5, 0): 4.25}
    assert views.volume_shape(spark, str(tmp_path)) == {"d": 64, "h": 24, "k": 3}
    for name in ("plane_flip_y", "finite_bounds", "scale_linear", "interp_coord", "window_tumbling"):
        columns = sorted(registry.QUERIES[name](spark, str(tmp_path)).columns)
        assert sorted((tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()), key=str) == sorted(con.sql(registry.ORACLE[name]).select(*columns).fetchall(), key=str)


def test_no_events(spark, tmp_path):
    spark.createDataFrame([], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    assert views.volume(spark, str(tmp_path)).count() == 0
