"""Near-duplicates: open buckets, large ones dealt by prefix, sets by 64-bit hashes, repeated ids."""

import random

import numpy as np
import pytest

from gridloom.llm import neardup
from tests.llm.test_texts import brute_components


def alike(rng, n, changes):
    """``n`` texts of one base with ``changes`` words each of their own, and now and then a copy with one more change."""
    base = [f"w{k}" for k in range(100)]
    out = []
    for k in range(n):
        if out and k % 10 == 0:
            words = rng.choice(out).split()
            words[rng.randint(40, 60)] = f"last{k}"
        else:
            words = list(base)
            for at in rng.sample(range(100), changes):
                words[at] = f"own{k}x{at}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("bucket", "block"), [(neardup.BUCKET_ROWS, neardup.BLOCK_ROWS), (1, 8), (1000, 1000)])
def test_open_buckets(spark, bucket, block, monkeypatch):
    monkeypatch.setattr(neardup, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", block)
    monkeypatch.setattr(neardup, "PAIR_ROWS", 2 * block)
    texts = alike(random.Random(4), 150, 3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, _ = brute_components(texts, 85)
    assert 20 < len(set(want)) < 145
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == dict(enumerate(want))


def test_many_alike_but_unlinked(spark):
    """3000 texts of about 60 percent: they share buckets, few share a rare shingle."""
    texts = alike(random.Random(5), 3000, 5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = neardup.near_duplicates(df).collect()
    base = {k: k for k in range(3000)}
    sets = [set(zip(*(t.split()[k : 96 + k] for k in range(5)), strict=True)) for t in texts]
    for k in range(10, 3000, 10):  # the copies
        for j in range(k):
            both = len(sets[k] & sets[j])
            if 100 * both >= 85 * (len(sets[k]) + len(sets[j]) - both):
                x, y = base[k], base[j]
                base = {i: (min(x, y) if c in (x, y) else c) for i, c in base.items()} if x != y else base
    assert {r.doc_id: r.component_id for r in rows} == base


def test_shared_size_counts_no_collision_inside_a_set():
    a, b = np.array([1, 2, 3, 9], np.uint64), np.array([4, 5, 9], np.uint64)
    assert neardup.shared_size(a, b) == 1 and neardup.shared_size(a, a) == 4 and neardup.shared_size(a[:3], b[:2]) == 0


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(6)
    count = rng.integers(0, 50, neardup.ORDER_SLOTS[0])
    for _ in range(200):
        both = rng.integers(0, 2**63, int(rng.integers(1, 200)), dtype=np.uint64)
        extra = int(len(both) * 0.17)
        own = rng.integers(0, 2**63, extra, dtype=np.uint64)
        cut = int(rng.integers(0, extra + 1))
        a, b = np.unique(np.concatenate([both, own[:cut]])), np.unique(np.concatenate([both, own[cut:]]))
        shared = neardup.shared_size(a, b)
        if 100 * shared >= 85 * (len(a) + len(b) - shared):
            first = np.intersect1d(neardup.prefix(a, count, 85), neardup.prefix(b, count, 85))
            more = np.intersect1d(neardup.prefix(a, count, 85, 2), neardup.prefix(b, count, 85, 2))
            assert first.size and (more.size > 1 or shared == 1) and np.isin(first, more).all()


def test_a_shingle_of_very_many_texts_is_dealt_by_pairs(spark, monkeypatch):
    """Texts of one template that share all but a few words, in blocks so small that its shingles are dealt by pairs."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 20)
    monkeypatch.setattr(neardup, "PAIR_ROWS", 40)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(600):
        words = list(base)
        for at in (10, 25, 40):  # three slots of five fillings each
            words[at] = f"f{rng.randint(0, 4)}"
        words[50] = f"own{k}" if k % 7 else f"pair{k // 14}"
        texts.append(" ".join(words))
    want, _ = brute_components(texts, 85)
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want))


def test_rows_that_share_an_id(spark):
    """Two texts under one id are one document, linked through either."""
    rng = random.Random(9)
    one, two = (" ".join(f"{rng.choice('abc')}{rng.randint(0, 999)}" for _ in range(60)) for _ in range(2))
    rows = [(1, one), (5, one + " end"), (5, two), (7, two + " end"), (8, "something else of its own here and there"), (5, two)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (5, 1), (5, 1), (5, 1), (7, 1), (8, 8)]
