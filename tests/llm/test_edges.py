"""Columns of the input whose names an operator might use itself, hostile pages, and contracts of registered queries."""

import time

import pytest
from pyspark.sql import functions as F

from gridloom.llm import html, langid, quality, queries, sharding

SF = "/root/testdata/sf0.001"
NAMES = ["_words", "_lines", "_t", "_h", "_text", "_rank", "_salt", "_id", "_size", "_start", "doc", "row", "d"]


@pytest.fixture(scope="module")
def named(spark):
    rows = [(k, f"the text {k} and the words of it " * 4, "en", *[f"{n}{k}" for n in NAMES]) for k in range(6)]
    return spark.createDataFrame(rows, ["doc_id", "text", "lang", *NAMES])


@pytest.mark.parametrize(
    "run",
    [lambda d: quality.quality_rules(d), lambda d: quality.keep(d), lambda d: sharding.shard_by_bytes(d, 2), lambda d: langid.predict(d, langid.train(d))],
    ids=["rules", "keep", "shards", "language"],
)
def test_other_columns_pass_through(named, run):
    out = run(named)
    assert set(NAMES) <= set(out.columns)
    for r in out.collect():
        assert [r[n] for n in NAMES] == [f"{n}{r.doc_id}" for n in NAMES]


@pytest.mark.parametrize("page", ["<b>" * 40000, '<a "' * 40000, '<a "' * 40000 + '">', "<b>" * 20000 + "</i>" * 20000, "<i><td>" + "<b>" * 20000 + "</i>" * 20000, "<" * 100000], ids=range(6))
def test_hostile_pages_take_linear_time(page):
    began = time.perf_counter()
    html.Page(page)
    assert time.perf_counter() - began < 3


def test_contract_of_op9(spark):
    rows = {r.conv_id: r for r in queries.op9_chat_formatting(spark, SF).collect()}
    said = "</s>[INST] ok [/INST]"
    assert (rows[-7].n_turns, rows[-7].loss_chars) == (2, len(said))
    assert rows[-7].loss_sha256 == spark.range(1).select(F.sha2(F.lit(said), 256)).first()[0]
    assert len(rows) == 1 + spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()


def test_contract_of_op8(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op8_histogram_sharding(spark, SF).toPandas()
    want = {r.doc_id: (r.n, r.c) for r in docs.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 8).alias("n"), F.crc32(F.coalesce("text", F.lit(""))).alias("c")).collect()}
    assert {int(d): (int(a), int(b)) for d, a, b in zip(rows["doc_id"], rows["size"], rows["text_crc32"], strict=True)} == want
    assert set(rows["law"]) == {"bytes"} and rows["grown_shard"].isna().all() and rows["shard"].between(0, 23).all()
    for _, own in rows.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
