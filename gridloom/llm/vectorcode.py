"""Compression of vectors to codes of one byte a part, with an equal-average search for the nearest codebook entry.

Components become integers, floor(SCALE * x), and vectors are cut into PARTS equal consecutive parts.  Each position has a codebook of at
most ENTRIES entries, which starts as that part of the vectors with the smallest ids and is moved ROUNDS times to the floors of the means of
the parts that it is nearest to.

Search.  By Cauchy and Schwarz a part and an entry whose component sums differ by g are at least g*g/dimension apart (squared).
Entries are sorted by sum; from the part's own sum the search goes outward, nearer gap first, and ends when g*g/dimension
strictly exceeds the best distance so far, so ties are still met and go to the lower index.

Each round reads the written vectors once; a task sends the counts and sums of its parts, at most PARTS * ENTRIES * dimension numbers, and
the driver holds one codebook of that size.

Defined results: vectors that are null or hold null or non-finite components are dropped; shorter vectors are filled with zeros to the
longest, and all to a multiple of PARTS; rows without an id are coded but never start an entry; among rows that share an id the smaller
vector comes first; fewer rows than ENTRIES make fewer entries; distances times a part's dimension have to stay within 64 bits; an empty
table gives an empty result; other columns do not take part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, discard, finite_vector, join_hot

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and squared distance to it, for each row of ``parts``."""
    n, d = parts.shape
    sums = book.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sums, last = sums[order], len(book) - 1
    own = parts.sum(axis=1)
    right = np.searchsorted(sums, own)
    left = right - 1
    best = np.full(n, np.iinfo(np.int64).max // d)
    code = np.full(n, len(book))
    open_ = np.arange(n)
    for _ in range(len(book)):
        lo, hi = left[open_], right[open_]
        below, above = own[open_] - sums[np.maximum(lo, 0)], sums[np.minimum(hi, last)] - own[open_]
        down = (lo >= 0) & ((hi > last) | (below <= above))
        gap = np.where(down, below, above)
        near = gap * gap <= best[open_] * d
        if not near.any():
            break
        open_, down = open_[near], down[near]
        entry = order[np.where(down, lo[near], hi[near])]
        apart = parts[open_] - book[entry]
        dist = (apart * apart).sum(axis=1)
        better = (dist < best[open_]) | ((dist == best[open_]) & (entry < code[open_]))
        best[open_[better]], code[open_[better]] = dist[better], entry[better]
        left[open_] -= down
        right[open_] += ~down
    return code, best


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of integer components from a list column, filled with zeros."""
    if not len(column):
        return np.zeros((0, dims), np.int64)
    offsets = column.offsets.to_numpy()
    size = np.diff(offsets)
    out = np.zeros((len(size), dims))
    at = np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[at] = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    return out.astype(np.int64)


def _tally(books: np.ndarray):
    parts, entries, width = books.shape

    def run(batches):
        count = np.zeros((parts, entries), np.int64)
        total = np.zeros(books.shape, np.int64)
        for b in batches:
            x = matrix(b.column(0), parts * width)
            for p in range(parts):
                own = x[:, p * width : (p + 1) * width]
                code, _ = nearest(own, books[p])
                count[p] += np.bincount(code, minlength=entries)
                np.add.at(total[p], code, own)
        p, e, j = np.nonzero(np.repeat(count[:, :, None] > 0, width, axis=2))
        yield pa.RecordBatch.from_arrays([*map(pa.array, (p, e, j, count[p, e], total[p, e, j]))], ["p", "e", "j", "n", "total"])

    return run


def _code(books: np.ndarray):
    parts, _, width = books.shape

    def run(batches):
        for b in batches:
            x = matrix(b.column(2), parts * width)
            found = [nearest(x[:, p * width : (p + 1) * width], books[p]) for p in range(parts)]
            code = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
            error = np.sum([d for _, d in found], axis=0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes().hex() for r in code], pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def train(vectors: DataFrame) -> np.ndarray:
    """Codebooks (parts x entries x width) of a written table with vec_id and x."""
    dims = vectors.agg(F.max(F.size("x"))).first()[0] or 1
    width = -(-dims // PARTS)
    first = vectors.where("vec_id IS NOT NULL").orderBy("vec_id", "x").limit(ENTRIES).select("x").collect()
    start = matrix(pa.array([r.x for r in first], pa.list_(pa.float64())), PARTS * width)
    books = start.reshape(len(first), PARTS, width).transpose(1, 0, 2).copy()
    if not len(first):
        return books
    for _ in range(ROUNDS):
        sums = vectors.select("x").mapInArrow(_tally(books), "p long, e long, j long, n long, total long")
        for r in sums.groupBy("p", "e", "j").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
            books[r.p, r.e, r.j] = int(r.total) // r.n
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Per usable row: vec_id, label, code, error, label_error (over equal labels, nulls together) and codebooks_sha256."""
    types = dict(rows.dtypes)
    usable = rows.where(finite_vector(vector)).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("x"))
    vectors = cut(usable)
    books = train(vectors)
    out = f"vec_id {types[vec_id]}, label {types[label]}, code string, error long"
    if not books.size:
        discard(vectors)
        return rows.sparkSession.createDataFrame([], f"{out}, label_error long, codebooks_sha256 string")
    coded = cut(vectors.mapInArrow(_code(books), out).withColumn("key", F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit("="), F.col("label").cast("string")))))
    sums = cut(coded.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    discard(vectors)
    return join_hot(coded, sums, "key", "n").select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
