"""Vector codes and whitening against plain numpy, and their edges."""

import math

import numpy as np
import pytest

from gridloom.llm import vectorcode, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, at string, n string, x string, key string, code string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, k, "a", "n", "x", "k", "c") for i, v, k in rows], SCHEMA)


def usable(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(7, 24))
    out = [(i, [float(np.float32(x)) for x in centres[i % 7] + 0.1 * rng.normal(size=24)], i % 5 if i % 11 else None) for i in range(400)]
    same = out[17][1]
    out += [(1000 + i, same, 1) for i in range(150)]
    out += [(5, out[6][1], 2), (None, out[7][1], 3), (2000, None, 1), (2001, [*same[:23], None], 1), (2002, [*same[:23], float("nan")], 1), (2003, [*same[:23], float("inf")], 1)]
    return out


def test_nearest_is_the_first_of_the_nearest():
    rng = np.random.default_rng(1)
    for entries in (1, 2, 16):
        book = rng.integers(-4, 5, size=(entries, 5))
        parts = rng.integers(-6, 7, size=(3000, 5))
        book[-1] = book[0]
        apart = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
        code, best = vectorcode.nearest(parts, book)
        assert (code == apart.argmin(axis=1)).all() and (best == apart.min(axis=1)).all()


def plain_codes(rows):
    good = usable(rows)
    x = np.floor(4096 * np.array([v for _, v, _ in good], float)).astype(np.int64)
    first = sorted((k for k in range(len(good)) if good[k][0] is not None), key=lambda k: (good[k][0], good[k][1]))[:16]
    width = x.shape[1] // 8
    code, error, text = np.zeros((len(x), 8), int), np.zeros(len(x), int), []
    for p in range(8):
        own = x[:, p * width : (p + 1) * width]
        book = own[first].copy()
        for step in range(7):
            apart = ((own[:, None] - book[None]) ** 2).sum(axis=2)
            code[:, p] = apart.argmin(axis=1)
            if step < 6:
                for e in set(code[:, p].tolist()):
                    mine = own[code[:, p] == e]
                    book[e] = [int(s) // len(mine) for s in mine.sum(axis=0)]
        error += apart.min(axis=1)
        text += map(str, book.ravel().tolist())
    return good, ["".join(f"{c:02x}" for c in r) for r in code], error, ",".join(text)


def test_codes(spark, rows):
    import hashlib

    good, code, error, text = plain_codes(rows)
    label = {}
    for (_, _, k), e in zip(good, error, strict=True):
        label[k] = label.get(k, 0) + int(e)
    want = sorted(((i, k, c, int(e), label[k]) for (i, _, k), c, e in zip(good, code, error, strict=True)), key=str)
    got = vectorcode.compress(frame(spark, rows)).collect()
    assert sorted(((r.vec_id, r.label, r.code, r.error, r.label_error) for r in got), key=str) == want
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(text.encode()).hexdigest()}


def test_codes_of_little(spark):
    assert vectorcode.compress(frame(spark, [])).collect() == []
    assert vectorcode.compress(frame(spark, [(1, None, 1)])).collect() == []
    got = vectorcode.compress(frame(spark, [(2, [0.5, -0.25, 1.0], None), (1, [0.5, -0.25], 4)])).orderBy("vec_id").collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in got] == [(1, "00" * 8, 0, 0), (2, "00" * 2 + "01" + "00" * 5, 0, 0)]


def test_whitening(spark, rows, monkeypatch):
    # Small blocks, so that rows and columns have several of them and products are split.
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 32)
    monkeypatch.setattr(whitening, "BLOCK_COLS", 10)
    monkeypatch.setattr(whitening, "BLOCKS_A_SPLIT", 2)
    good = usable(rows)
    x = np.floor(64 * np.array([v for _, v, _ in good], float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh(((n * fit - sums) / n).T @ ((n * fit - sums) / n) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    white = ((n * x - sums) / n) @ vectors[:, :16] / np.sqrt(values[:16])
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {(r.n, len(r.whitened)) for r in got} == {(n, 16)} and len(got) == len(good)
    assert np.allclose(got[0].explained, values[:16] / values.sum(), rtol=1e-9) and got[0].identity_error < 1e-9
    ids = {i: k for k, (i, _, _) in enumerate(good) if i not in (5, None)}
    mine = {r.vec_id: r for r in got if r.vec_id in ids}
    ours = np.array([mine[i].whitened for i in ids])
    theirs = white[list(ids.values())]
    assert np.allclose(ours * np.sign((ours * theirs).sum(axis=0)), theirs, atol=1e-8)
    assert [int(mine[i].deviation) for i in ids] == ((n * x - sums) ** 2).sum(axis=1)[list(ids.values())].tolist()
    assert sorted(str(r.vec_id) for r in got) == sorted(str(i) for i, _, _ in good)


def test_whitening_of_little(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(k, [1.0, 2.0], 1) for k in range(4)])).collect() == []
    got = whitening.whiten(frame(spark, [(1, [1.0, 0.0], 1), (2, [0.0], 1), (3, [0.0], 1)])).orderBy("vec_id").collect()
    assert [(r.vec_id, r.n, int(r.deviation), len(r.whitened)) for r in got] == [(1, 2, 4096, 1), (2, 2, 4096, 1), (3, 2, 4096, 1)]
    assert got[0].whitened[0] == pytest.approx(-got[1].whitened[0]) and abs(got[0].whitened[0]) == pytest.approx(1)
