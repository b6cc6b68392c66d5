"""Best-fit packing by minimum bin slack.

Pieces count only by their length, so the search works on a histogram of lengths (at most ``capacity`` entries, whatever the
size of the corpus).  For one bin, subset sums over the available lengths are kept as bits of an integer, one integer per
length, and give the fullest feasible combination; that combination is then taken as many times as the histogram allows,
which uses up at least one of its lengths' copies each time.  The resulting patterns, at most a few per length, are joined
back to the pieces: within each length, pieces are numbered by salted bins and looked up in the running pattern counts.

Defined results: a null text is an empty one (one piece holding the end id); an empty text likewise; texts longer than the
capacity are cut into full pieces and a rest; repeated rows are packed as often as they occur; an empty table gives an
empty result; other columns do not take part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gridloom.llm.common import bin_starts, cut, salt, width

CAPACITY = 2048
END_ID = 0
#: Texts that a task encodes at once.
ROWS = 2000


def fullest(lengths: list[int], counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum within the capacity, the longest length first.

    ``reach[k]`` has bit s set when some copies of the first k lengths sum to s; binary splitting of the counts keeps the
    number of shifts logarithmic.  Walking back prefers copies of longer lengths."""
    mask = (1 << (capacity + 1)) - 1
    first = lengths[0]
    goal = capacity - first
    left = dict(counts)
    left[first] -= 1
    reach, steps = [1], []
    best = 1
    for n in lengths:
        most = min(left[n], goal // n)
        if not most:
            continue
        bits, part = reach[-1], 1
        while most:
            take = min(part, most)
            bits |= (bits << (take * n)) & mask
            most -= take
            part *= 2
        reach.append(bits)
        steps.append(n)
        best = bits
        if bits >> goal & 1:
            break
    total = (best & ((1 << (goal + 1)) - 1)).bit_length() - 1
    chosen = {first: 1}
    for k in range(len(steps) - 1, -1, -1):
        n = steps[k]
        while total and not reach[k] >> total & 1:
            chosen[n] = chosen.get(n, 0) + 1
            total -= n
    return chosen


def plan_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns (copies of each length, number of bins) that use up the histogram.  Each bin starts with the longest length that is left."""
    left = {n: c for n, c in histogram.items() if c}
    patterns = []
    while left:
        lengths = sorted(left, reverse=True)
        chosen = fullest(lengths, left, capacity)
        times = min(left[n] // k for n, k in chosen.items())
        patterns.append((chosen, times))
        for n, k in chosen.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return patterns


def tokenise_pieces(docs: DataFrame, tokenizer_file: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids (binary: little-endian unsigned 32-bit; on request only), ids_crc32.  Every distinct word of a task is encoded once."""
    kinds = {"doc_id": (pa.int64(), "long"), "piece": (pa.int32(), "int"), "start": (pa.int64(), "long"), "length": (pa.int64(), "long"), "ids": (pa.binary(), "binary"), "ids_crc32": (pa.int64(), "long")}
    if not keep_ids:
        del kinds["ids"]

    def pieces(batches):
        from gridloom.llm.words import lower_encoder

        encoder, end = lower_encoder(tokenizer_file), np.array([END_ID], dtype="<u4").tobytes()
        for b in (x.slice(k, ROWS) for x in batches for k in range(0, x.num_rows, ROWS)):
            out = {c: [] for c in kinds}
            for ident, ids in zip(b.column(0).to_pylist(), encoder.batch(b.column(1)), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for name, value in (("doc_id", ident), ("piece", k), ("start", at // 4), ("length", len(part) // 4), ("ids_crc32", zlib.crc32(part))):
                        out[name].append(value)
                    if keep_ids:
                        out["ids"].append(part)
            yield pa.RecordBatch.from_arrays([pa.array(out[c], kind) for c, (kind, _) in kinds.items()], list(kinds))

    schema = ", ".join(f"{c} {sql}" for c, (_, sql) in kinds.items())
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(pieces, schema)


def _slots(patterns: list[tuple[dict[int, int], int]]) -> dict[int, tuple]:
    """For each length the ranks that begin to fill a slot, with the slot's first sequence and its offset (ranks ascending)."""
    by_length, used, sequence = {}, {}, 0
    for chosen, times in patterns:
        at = 0
        for n in sorted(chosen, reverse=True):
            for _ in range(chosen[n]):
                by_length.setdefault(n, []).append((used.get(n, 0), sequence, at))
                used[n] = used.get(n, 0) + times
                at += n
        sequence += times
    return {n: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for n, v in by_length.items()}


def place(pieces: DataFrame, patterns: list[tuple[dict[int, int], int]]) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    lookup = _slots(patterns)
    bins = width(pieces.sparkSession)
    salted = pieces.withColumn("__gl_salt", salt(bins, "doc_id", "piece"))
    starts = bin_starts(salted.groupBy("length", "__gl_salt").agg(F.count("*").alias("n")), ["length"])
    order = Window.partitionBy("length", "__gl_salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("__gl_rank", F.row_number().over(order) - 1).join(starts.drop("n"), ["length", "__gl_salt"]).withColumn("__gl_rank", F.col("__gl_start") + F.col("__gl_rank")).drop("__gl_salt", "__gl_start")
    names = [c for c in ranked.columns if c != "__gl_rank"]

    def seat(batches):
        for b in batches:
            lengths, ranks = b.column(b.schema.get_field_index("length")).to_numpy(), b.column(b.schema.get_field_index("__gl_rank")).to_numpy()
            seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for n in np.unique(lengths):
                own = lengths == n
                first, sequence, offset = lookup[int(n)]
                at = np.searchsorted(first, ranks[own], side="right") - 1
                seq[own], off[own] = sequence[at] + ranks[own] - first[at], offset[at]
            columns = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes if c != "__gl_rank")
    return ranked.mapInArrow(seat, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_file: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Pieces with ids (or only their checksum), sequence_id and offset."""
    pieces = cut(tokenise_pieces(docs, tokenizer_file, text, doc_id, capacity, keep_ids))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    return place(pieces, plan_patterns(histogram, capacity))


def crc32_of(ids) -> int:
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())
