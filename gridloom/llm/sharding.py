"""Sharding by histogram sort: probe, count exactly, refine, then exchange once.

Rows are ordered by (hash of the text, doc_id), so equal texts lie side by side and go to the same shard unless their group
is itself larger than a shard may be off.  Each round counts the exact bytes between candidate boundaries in every
partition, adds the counts, and narrows the bracket of each splitter; only the counts (a fixed number of probes) reach the
driver.  When all splitters meet the tolerance, the rows move once.  Where one text alone spans a splitter, the same
search goes on over doc_id inside that text, so a hot group is split and nothing is dropped.

Defined results: a null text has no bytes (8 bytes of row size) and the checksum of the empty text; rows that are equal in
every column are kept, and may share a shard although their group is too large, as no key tells them apart; a null doc_id
sorts first; an empty table gives an empty result; other columns pass through, and ours replace clashing ones.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gridloom.llm.common import bin_starts, cut, salt, width

#: Bytes of a row besides its text.
ROW_BYTES = 8
#: A splitter may be off by this part of a shard's fair bytes.
TOLERANCE = 0.002
#: Candidate boundaries tried in each bracket and round.
PROBES = 512
LOWEST = -(2**63)


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def _counts(slim: DataFrame, key: str, probes: list[int]) -> list[tuple[int, int]]:
    """Exact bytes and rows with a key below each probe (probes ascending)."""
    edges = np.array(probes, dtype=np.int64)

    def tally(batches):
        total = np.zeros(len(edges) + 1, dtype=np.int64)
        rows = np.zeros(len(edges) + 1, dtype=np.int64)
        for b in batches:
            at = np.searchsorted(edges, b.column(0).to_numpy(), side="right")
            total += np.bincount(at, weights=b.column(1).to_numpy(), minlength=len(edges) + 1).astype(np.int64)
            rows += np.bincount(at, minlength=len(edges) + 1)
        hit = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit]), pa.array(rows[hit])], ["slot", "bytes", "rows"])

    tallied = slim.select(key, "__gl_size").mapInArrow(tally, "slot long, bytes long, rows long")
    per = np.zeros((len(edges) + 1, 2), dtype=np.int64)
    for r in tallied.groupBy("slot").agg(F.sum("bytes").alias("b"), F.sum("rows").alias("n")).collect():
        per[r.slot] = r.b, r.n
    return [tuple(x) for x in np.cumsum(per, axis=0)[:-1].tolist()]


def _refine(slim: DataFrame, key: str, goals: list[int], rows: int, tolerance: int) -> list[tuple[int, int]]:
    """For each goal a key and the bytes below it, within the tolerance of the goal if some key is; else the bracket is
    narrowed to one row or one key."""
    brackets = [{"lo": LOWEST, "lo_at": (0, 0), "hi": 2**63 - 1, "hi_at": (None, rows), "done": None} for _ in goals]
    while True:
        probes = set()
        for s in brackets:
            if s["done"] is None:
                span = s["hi"] - s["lo"]
                s["try"] = sorted({s["lo"] + span * k // (PROBES + 1) for k in range(1, PROBES + 1)} - {s["lo"], s["hi"]})
                probes.update(s["try"])
        if not probes:
            return [s["done"] for s in brackets]
        ordered = sorted(probes)
        below = dict(zip(ordered, _counts(slim, key, ordered), strict=True))
        for s, goal in zip(brackets, goals, strict=True):
            if s["done"] is not None:
                continue
            for p in s["try"]:
                if below[p][0] > goal:
                    s["hi"], s["hi_at"] = p, below[p]
                    break
                s["lo"], s["lo_at"] = p, below[p]
            under = goal - s["lo_at"][0]
            over = tolerance + 1 if s["hi_at"][0] is None else s["hi_at"][0] - goal
            if min(under, over) <= tolerance or s["hi"] - s["lo"] <= 1 or s["hi_at"][1] - s["lo_at"][1] <= 1:
                s["done"] = (s["lo"], s["lo_at"][0]) if under <= over or s["hi_at"][0] is None else (s["hi"], s["hi_at"][0])
                if s["hi"] - s["lo"] <= 1 and min(under, over) > tolerance:
                    s["done"] = (s["lo"], s["lo_at"][0])


def find_splitters(slim: DataFrame, n_shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """The n_shards - 1 boundaries (hash, doc_id); a row goes to the shard of the boundaries at or below its key."""
    total, rows = slim.agg(F.sum("__gl_size"), F.count("*")).first()
    if not total:
        return []
    allowed = max(int(tolerance * total / n_shards), total // rows)  # no closer than a mean row
    goals = [total * k // n_shards for k in range(1, n_shards)]
    found = _refine(slim, "__gl_h", goals, rows, allowed)
    splitters = [(h, LOWEST) for h, _ in found]
    off = {k: goals[k] - below for k, (_, below) in enumerate(found) if abs(goals[k] - below) > allowed}
    # Splitters that fall inside the rows of one text go on over doc_id; single rows can't be split.
    large = {r["__gl_h"]: r["n"] for r in slim.where(F.col("__gl_h").isin([found[k][0] for k in off])).groupBy("__gl_h").agg(F.count("*").alias("n")).collect()} if off else {}
    for h in sorted(h for h, n in large.items() if n > 1):
        own = [k for k in off if found[k][0] == h and off[k] > 0]
        if own:
            for k, (doc, _) in zip(own, _refine(slim.where(F.col("__gl_h") == h), "__gl_id", [off[k] for k in own], large[h], allowed), strict=True):
                splitters[k] = (h, doc)
    return sorted(splitters)


def assign(splitters: list[tuple[int, int]], h: Column, doc: Column) -> Column:
    at = [((h > F.lit(a)) | ((h == F.lit(a)) & (doc >= F.lit(b)))).cast("int") for a, b in splitters]
    return reduce(lambda x, y: x + y, at, F.lit(0))


def shard_by_bytes(docs: DataFrame, n_shards: int, text: str = "text", doc_id: str = "doc_id", tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` with size, shard and slot (gapless from 0 within the shard), exchanged once by (shard, bin)."""
    spark = docs.sparkSession
    mine = {"size", "shard", "slot"}
    h = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    ident = F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST))
    slim = cut(docs.select(h.alias("__gl_h"), ident.alias("__gl_id"), text_size(F.col(text)).alias("__gl_size")))
    splitters = find_splitters(slim, n_shards, tolerance)
    bins = width(spark)
    place = [assign(splitters, F.col("__gl_h"), F.col("__gl_id")).alias("shard"), salt(bins, "__gl_id", "__gl_h").alias("__gl_salt")]
    starts = bin_starts(slim.select(*place).groupBy("shard", "__gl_salt").agg(F.count("*").alias("n")), ["shard"])
    keyed = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in mine], text_size(F.col(text)).alias("size"), h.alias("__gl_h"), ident.alias("__gl_id"))
    moved = keyed.select("*", *place).repartition(max(n_shards, bins), "shard", "__gl_salt")
    order = Window.partitionBy("shard", "__gl_salt").orderBy("__gl_h", "__gl_id")
    placed = moved.withColumn("__gl_rank", F.row_number().over(order) - 1).join(starts.drop("n"), ["shard", "__gl_salt"])
    return placed.withColumn("slot", (F.col("__gl_start") + F.col("__gl_rank")).cast("long")).drop("__gl_h", "__gl_id", "__gl_salt", "__gl_start", "__gl_rank")
