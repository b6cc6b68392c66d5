"""Chunk results that come late, twice and out of order."""

import datetime as dt
import random

import pytest

from gridloom.streaming import results

SCHEMA = "source string, chunk long, version long, asked timestamp, values array<double>"
KEYS = ["source", "chunk"]


@pytest.fixture
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", results.PROVIDER)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def run(spark, folder, **how):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    results.keep_newest(stream, str(folder / "out"), str(folder / "cp"), KEYS, **how).awaitTermination(300)


def add(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))


def test_one_row_a_key_whatever_the_order(rocks, tmp_path):
    rng = random.Random(2)
    rows = [("s", k % 7, v, at(rng.randint(0, 50)), [float(k % 7), float(v)]) for k in range(7) for v in range(1, 6)]
    rows += rng.sample(rows, 10) + [("s", 3, None, at(1), [0.0]), ("s", 3, 99, None, [0.0])]
    rng.shuffle(rows)
    for k in range(0, len(rows), 16):
        add(rocks, tmp_path, rows[k : k + 16])
    run(rocks, tmp_path)
    seen = rocks.read.parquet(str(tmp_path / "out")).orderBy("batch").collect()
    by_key = {}
    for r in seen:
        assert r.version > by_key.get(r.chunk, 0)  # never an older result, and none twice
        by_key[r.chunk] = r.version
    assert by_key == {k: 5 for k in range(7)}
    assert sorted((r.chunk, r.version, r["values"]) for r in results.read_newest(rocks, str(tmp_path / "out"), KEYS).collect()) == [(k, 5, [float(k), 5.0]) for k in range(7)]


def test_state_survives_a_restart_and_is_forgotten_by_the_timer(rocks, tmp_path):
    add(rocks, tmp_path, [("s", 1, 5, at(0), [5.0])])
    run(rocks, tmp_path, late="10 minutes")
    add(rocks, tmp_path, [("s", 1, 4, at(1), [4.0])])
    run(rocks, tmp_path, late="10 minutes")
    assert [r.version for r in rocks.read.parquet(str(tmp_path / "out")).collect()] == [5]  # older than what passed before the restart
    add(rocks, tmp_path, [("s", 2, 1, at(60), [1.0])])
    run(rocks, tmp_path, late="10 minutes")
    add(rocks, tmp_path, [("s", 1, 9, at(2), [9.0]), ("s", 3, 1, at(61), [1.0])])  # the first is behind the watermark
    run(rocks, tmp_path, late="10 minutes")
    assert sorted((r.chunk, r.version) for r in rocks.read.parquet(str(tmp_path / "out")).collect()) == [(1, 5), (2, 1), (3, 1)]
    add(rocks, tmp_path, [("s", 1, 2, at(62), [2.0])])  # asked anew: the old version is forgotten
    run(rocks, tmp_path, late="10 minutes")
    assert (1, 2) in {(r.chunk, r.version) for r in rocks.read.parquet(str(tmp_path / "out")).collect()}
