"""The corpus pipeline stage by stage against plain Python on the smallest documents table."""

import re
from collections import Counter

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import langid, quality
from gridloom.llm.common import cut, table
from tests.llm.test_mends import plain_words
from tests.llm.test_passages import brute_passages
from tests.llm.test_texts import brute_components

SF = "/root/testdata/sf0.001"


def keeps(text):
    ws = (text or "").split()
    n = len(ws)
    grams = Counter(tuple(ws[i : i + 8]) for i in range(n - 7))
    covered = {i + j for i in range(n - 7) if grams[tuple(ws[i : i + 8])] > 1 for j in range(8)}
    if n < 20 or 100 * len(covered) > 30 * n:
        return False
    lines = [x for x in text.split("\n") if x.split()]
    forms = set(quality.stop_forms())
    return 2.5 <= sum(map(len, ws)) / n <= 10 and sum(c in quality.SYMBOLS for c in text) / n <= 0.1 and sum(w in forms for w in ws) / n >= 0.05 and (len(lines) - len(set(lines))) / len(lines) <= 0.5


def brute_left(texts):
    """Texts without the bytes of repeated 400-byte strings and of repeated passages of 51 words."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + 400] for d in data for k in range(len(d) - 399))
    out = []
    for d, words in zip(data, brute_passages([t or "" for t in texts], 51), strict=True):
        gone = bytearray(len(d))
        for k in range(len(d) - 399):
            if seen[d[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        places = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", d)]
        for k, w in enumerate(words):
            if w:  # the white space between two words of a passage goes with them
                gone[places[k][0] : places[k][1]] = b"\1" * (places[k][1] - places[k][0])
        starts = {k for k in range(len(words) - 50) if all(words[k : k + 51])}
        for k in starts:
            gone[places[k][0] : places[k + 50][1]] = b"\1" * (places[k + 50][1] - places[k][0])
        out.append(bytes(b for b, g in zip(d, gone, strict=True) if not g).decode("utf-8", "ignore"))
    return out


def plain_shares(text, model):
    """Shares of the languages in a text: mixtures of ever more of them, fitted each, the best by penalised likelihood."""
    words = np.array([np.sum([model.log_p[t] for t in w], axis=0, dtype=np.float64) for w in plain_words(text)])
    odds = np.exp(words - words.max(axis=1, keepdims=True))
    n = odds.shape[1]

    def fit(allowed):
        share = np.zeros(n)
        share[allowed] = 1 / len(allowed)
        for _ in range(langid.STEPS):
            p = odds * share
            share = (p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)).mean(axis=0)
        return share, np.log(np.maximum((odds * share).sum(axis=1), 1e-300)).sum()

    full, _ = fit(list(range(n)))
    order = sorted(range(n), key=lambda k: (-full[k], k))
    found = [fit(order[:size]) for size in range(1, n + 1) if size == 1 or full[order[size - 1]] * len(words) > 0.5]
    costs = [-2 * fitted + langid.PENALTY * size * np.log(len(words) + 1) for size, (_, fitted) in enumerate(found)]
    return found[int(np.argmin(costs))][0]


def test_stages(spark):
    docs = table(spark, SF, "documents").select(*corpus_pipeline.COLUMNS)
    extra = spark.createDataFrame([(None, None, None, None, None), (9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, "1 " * 40, None, None, None)], docs.schema)
    docs = cut(docs.unionByName(extra).unionByName(docs.limit(3)))
    texts = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    first = cut(stages["quality rules"](spark, docs, SF))
    assert first.columns == corpus_pipeline.COLUMNS
    assert {r.doc_id for r in first.collect()} == {k for k, t in texts.items() if keeps(t)}

    second = cut(stages["language id"](spark, first, SF))
    assert second.columns == corpus_pipeline.COLUMNS
    model = langid.train(first.where(~langid.held_out(F.col("doc_id"))))
    mixed = {r.doc_id: max(plain_shares(r.text, model)) >= corpus_pipeline.LEAST_SHARE for r in first.collect()}
    assert {r.doc_id for r in second.collect()} == {k for k, most in mixed.items() if most and any(map(str.isalpha, texts[k]))}
    assert second.count() >= 0.99 * first.count()

    third = cut(stages["near duplicates"](spark, second, SF))
    ids = sorted({r.doc_id for r in second.collect()})
    want, _ = brute_components([texts[k] for k in ids], corpus_pipeline.NEAR_PERCENT)
    assert sorted(r.doc_id for r in third.collect()) == [ids[k] for k, c in enumerate(want) if c == k]

    fourth = cut(stages["repeated strings"](spark, third, SF))
    left = sorted(r.doc_id for r in third.collect())
    cut_texts = dict(zip(left, brute_left([texts[k] for k in left]), strict=True))
    assert {r.doc_id: r.text for r in fourth.collect()} == cut_texts
    assert all(r.n_chars == len(r.text) for r in fourth.collect())

    fifth = stages["packing"](spark, fourth, SF).toPandas()
    assert set(fifth["doc_id"]) == set(left)
    assert fifth.groupby("sequence_id")["length"].sum().max() <= 2048
    assert fifth["sequence_id"].nunique() <= -(-fifth["length"].sum() // 2048) + 1


def test_near_duplicates_lose_no_text_of_a_repeated_id(spark):
    one, two = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(1, one, "en", "s", 0), (1, two, "en", "s", 0), (1, two, "en", "s", 0), (2, two + " end", "en", "s", 0), (None, one, None, None, None), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(corpus_pipeline.STAGES)["near duplicates"](spark, docs, SF).collect()
    assert sorted(((r.doc_id or 0, r.text or "") for r in got)) == sorted([(1, one), (1, two), (0, one), (3, "")])


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
