"""The factorisation machine: its margin against the sum over all pairs, held-out accuracy, and edges."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import fmquality, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, n_chars long, score string, margin string, words string"
GOOD, BAD = "the plain text of number {} and its words.", "a### b&&& {}%%% c$$$ d***"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, len(t or ""), "s", "m", "w") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    rows = [(k, (GOOD if k % 4 else BAD).format(k) * (1 + k % 3)) for k in range(120)]
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(120)] + [(3, None), (4, 7), (None, 1), (999, 0)], "doc_id long, quality int")
    table = docs(spark, rows)
    return table, fmquality.train(table, labels, metadata=["n_chars"])


def test_margin_is_the_sum_over_all_pairs(small):
    table, model = small
    linear, factors, start = model.machine.linear.toArray(), model.machine.factors.toArray(), model.machine.intercept
    vectors = model.vectors(fmquality.features(table, "text", ["n_chars"])).select("doc_id", "__gl_features").collect()
    got = {r.doc_id: r.score for r in fmquality.score(table, model).select("doc_id", F.col("score")).collect()}
    for r in vectors[:20]:
        v = r["__gl_features"]
        at, x = v.indices, v.values
        pairs = sum(factors[at[i]] @ factors[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
        margin = start + linear[at] @ x + pairs + model.offset
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-9)


def test_odd_rows_have_a_score(spark, small):
    table, model = small
    odd = docs(spark, [(1, None), (2, ""), (3, "\n\n"), (None, BAD.format(1)), (5, GOOD.format(5) * 20000), (5, GOOD.format(5)), (5, GOOD.format(5))])
    rows = fmquality.score(odd, model).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert len({r.score for r in rows if r.text == GOOD.format(5)}) == 1
    assert all((r.margin, r.words) == ("m", "w") for r in rows)
    assert fmquality.score(odd.where("false"), model).count() == 0


def test_one_label_or_none(spark, small):
    table, _ = small
    none = fmquality.train(table, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in fmquality.score(table, none).select("score").collect()} == {0.5}
    one = fmquality.train(table, spark.createDataFrame([(1, 1), (2, 1), (2, 1)], "doc_id long, quality int"))
    assert {round(r.score, 9) for r in fmquality.score(table, one).select("score").collect()} == {0.75}


def test_op11(spark):
    rows = queries.op11_factorisation_quality(spark, SF).collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    judged = [(label[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in label]
    low, high = ([s for y, s, _ in judged if y == k] for k in (0, 1))
    assert np.mean([a < b for a in low for b in high]) > 0.98
    assert np.mean([y == p for y, _, p in judged]) > 0.95
