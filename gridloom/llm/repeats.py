"""Exact removal of long repeated strings with run-length indexes.

A byte goes when it is covered by a string of ``length`` bytes that also starts anywhere else in the corpus; on request words go
when they are in a passage of ``words`` words that also starts anywhere else, whatever white space is between them and however
few bytes they have.  Both take the same steps, on bytes or on hashes of words, in the same jobs.

(1) Anchors.  Every window of the length has one anchor: the leftmost smallest hash among its strings of half that length.  Equal
windows have equal anchors at equal places, so only windows under the same anchor hash can be equal.  Windows that follow each
other under one anchor form a run.
(2) Counts.  Anchors seen once are done: nothing repeats there.  Equal runs are one entry from here on, with a note whether it
stands for several; those are repeated as a whole.
(3) Index.  The entries of the other anchors are gathered in buckets of bounded size.  Of each bucket the run-compressed
Burrows-Wheeler transform is built and written: heads and starts of its runs, and at both ends of each run the length of the match
with the neighbour there (``build_index``).
(4) Statistics.  All entries of a bucket are streamed backwards through its index, one letter a step: inside a run the match with a
neighbour grows by one, at a run's end the sample says it.  A match of the length or more marks what it covers (``stream``).
(5) Anchors with more different entries than a bucket may hold (one passage in very many documents) are settled by counting the
hashes of their single windows, which Spark aggregates before the shuffle.
(6) Spans are united per document and cut out.

Defined results: a null text is an empty one; texts shorter than the length lose nothing; very long texts are scanned in
overlapping pieces, so no window is missed; repeated rows are repeats of each other; an empty table gives an empty result;
other columns pass through, and ours replace clashing ones.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import cut, discard, join_hot
from gridloom.llm.neardup import mix

LENGTH = 400
#: Different entries of one anchor that a bucket takes; beyond, single windows are counted.
GROUP_MAX = 4000
#: Letters of a bucket, about.
BUCKET_LETTERS = 400_000
_PIECE = 1 << 20
#: Words of a piece; they take eight bytes each.
_WORD_PIECE = 1 << 18
_BITS = 21
_rng = np.random.default_rng(4711)
_LETTERS = _rng.integers(0, 2**64, size=256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 2 * _PIECE + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        _powers["up"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]))
        _powers["down"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse)]))
    return _powers["up"][:n], _powers["down"][:n]


class rolling:
    """Hashes of any substring of an array of bytes, or of 64-bit hashes of words, from running sums."""

    def __init__(self, x: np.ndarray):
        up, self.down = powers(len(x) + 1)
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((_LETTERS[x] if x.dtype == np.uint8 else x) * up[:-1], out=self.sums[1:])

    def __call__(self, start, stop):
        return mix((self.sums[stop] - self.sums[start]) * self.down[start])

    def every(self, n: int) -> np.ndarray:
        m = len(self.sums) - n
        return mix((self.sums[n:] - self.sums[:m]) * self.down[:m])


def window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w successive values: block-wise running minima from both sides."""
    n = len(x)
    padded = np.concatenate([x, np.full(-n % w + w, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


_IN_WORD = ~np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after it."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _IN_WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


class Measure(NamedTuple):
    """What repeats: windows of so many bytes or words."""

    length: int
    words: bool

    @property
    def anchor(self) -> int:
        return (self.length + 1) // 2

    def units(self, text: str | None) -> np.ndarray:
        """The bytes of a text, or the hashes of its words."""
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        return rolling(data)(*word_places(data)) if self.words else data


def measures(length: int, words: int | None) -> list[Measure]:
    if not 2 <= length <= 2000 or not 2 <= (words or 2) <= 2000:
        raise ValueError("lengths are from 2 to 2000")
    return [Measure(length, False)] + ([Measure(words, True)] if words else [])


def _pieces(keys, texts, measure: Measure):
    """Blocks of about 1 MB: the units, and per piece its key, its start in the text and its place in the block."""
    length, most = measure.length, _WORD_PIECE if measure.words else _PIECE
    block, size = [], 0
    for key, text in zip(keys, texts, strict=True):
        data = measure.units(text)
        for at in range(0, max(1, len(data) - length + 1), most - length + 1):
            part = data[at : at + most]
            if len(part) < length:
                continue
            block.append((key, at, part))
            size += len(part)
            if size >= most:
                yield block
                block, size = [], 0
    if block:
        yield block


def _block_anchors(block, measure: Measure) -> pa.RecordBatch:
    length, k = measure.length, measure.anchor
    x = np.concatenate([p[2] for p in block])
    roll = rolling(x)
    h = roll.every(k) & ~np.uint64(1) | np.uint64(measure.words)
    packed = (h >> np.uint64(_BITS) << np.uint64(_BITS)) | np.arange(len(h), dtype=np.uint64)
    place = (window_minima(packed, length - k + 1) & np.uint64((1 << _BITS) - 1)).astype(np.int64)
    sizes = np.array([len(p[2]) for p in block])
    starts = np.cumsum(sizes) - sizes
    valid = np.zeros(len(x) + 1, np.int32)
    np.add.at(valid, starts, 1)
    np.add.at(valid, starts + sizes - length + 1, -1)
    at = np.flatnonzero(np.cumsum(valid[: len(place)]) > 0)
    p = place[at]
    new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (at[1:] != at[:-1] + 1)]))
    lo, p = at[new], p[new]
    hi = at[np.concatenate([new[1:], [len(at)]]) - 1]
    piece = np.searchsorted(starts, lo, side="right") - 1
    keys = np.array([q[0] for q in block], np.int64)[piece]
    offset = np.array([q[1] for q in block], np.int64)[piece] - starts[piece]
    sup = mix(roll(lo, hi + length) + ((p - lo) * 1024 + (hi - lo)).astype(np.uint64))
    where = ((lo + offset) << 20) | ((hi - lo) << 10) | (p - lo)
    return pa.RecordBatch.from_arrays([pa.array(h[p].view(np.int64)), pa.array(sup.view(np.int64)), pa.array(keys), pa.array(where)], ["h", "sup", "doc", "at"])


def _anchors(kinds: list[Measure]):
    """Rows h, sup, doc, at: anchor hash (its lowest bit: words), run hash, document key, and the run's first and last window with
    the anchor's place."""

    def run(batches):
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for measure in kinds:
                for block in _pieces(keys, texts, measure):
                    yield _block_anchors(block, measure)

    return run


ANCHORS = "h long, sup long, doc long, at long"


def suffix_ranks(x: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Order of the suffixes, and their ranks by more and more letters until all differ.  ``x``: letters from 1 on, and 0 after
    each text; a string that meets such a mark equals no other, and marks follow each other in the order of the texts."""
    n, bits = len(x), int(x.max()).bit_length()
    first = span = max(1, 63 // bits)
    key = np.zeros(n, np.int64)
    open_ = np.ones(n, bool)
    for k in range(first):
        key <<= bits
        letter = np.zeros(n, np.int64)
        letter[: max(0, n - k)] = x[k:]
        open_ &= letter > 0
        key |= np.where(open_, letter, 0)
    alone, levels = ~open_, []
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | alone[order[1:]]])
    marked = np.flatnonzero(alone[order])
    order[marked] = order[marked[np.lexsort((order[marked], key[marked]))]]
    at, ranks = np.arange(n), np.empty(n, np.int32)
    while True:  # at: the places in the order that are not settled; a group has the rank of its first place
        ranks[order[at]] = np.maximum.accumulate(np.where(new, at, 0))
        levels.append((span, ranks.copy()))
        at = at[~(new & np.concatenate([new[1:], [True]]))]
        if not len(at):
            return order, levels
        own = order[at]
        key = ranks[own].astype(np.int64) * n + ranks[own + span]
        by_key = np.argsort(key)
        order[at], key = own[by_key], key[by_key]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        span *= 2


def common_prefix(x: np.ndarray, levels, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b (a <> b)."""
    total, n = np.zeros(len(a), np.int64), len(x)
    for span, ranks in reversed(levels):
        i, j = np.minimum(a + total, n - 1), np.minimum(b + total, n - 1)
        total += np.where(ranks[i] == ranks[j], span, 0)
    going = np.ones(len(a), bool)
    for _ in range(levels[0][0]):
        i, j = np.minimum(a + total, n - 1), np.minimum(b + total, n - 1)
        going &= (x[i] == x[j]) & (x[i] > 0)
        total += going
    return total


class Index(NamedTuple):
    """A run-compressed Burrows-Wheeler transform: heads and starts of its runs; ``lands``, where the step back from a run's start
    leads; and samples at the ends of the runs: how far the suffix after that step matches the one before it (``ahead``, at the
    run's first place) and the one behind it (``behind``, at its last).  ``sizes``: letters of each text; its mark has its rank."""

    heads: np.ndarray
    starts: np.ndarray
    lands: np.ndarray
    ahead: np.ndarray
    behind: np.ndarray
    sizes: np.ndarray


def build_index(texts: list[np.ndarray]) -> Index:
    sizes = np.array([len(t) for t in texts])
    x = np.zeros(sizes.sum() + len(sizes), np.int64)
    letters = np.concatenate(texts)
    inside = np.ones(len(x), bool)
    inside[np.cumsum(sizes + 1) - 1] = False
    x[inside] = letters.astype(np.int64) + 1 if letters.dtype == np.uint8 else np.unique(letters, return_inverse=True)[1] + 1
    order, levels = suffix_ranks(x)
    transform = x[order - 1]  # rank 0 is the first text's mark; position 0 wraps to the last mark
    starts = np.flatnonzero(np.concatenate([[True], transform[1:] != transform[:-1]]))
    heads = transform[starts]
    ends = np.concatenate([starts[1:], [len(x)]]) - 1
    # Runs of one letter follow each other in the sorted column; a step back keeps that order.
    by_letter = np.argsort(heads, kind="stable")
    long = (ends - starts + 1)[by_letter]
    lands = np.empty(len(starts), np.int64)
    lands[by_letter] = np.cumsum(long) - long
    next_to = np.flatnonzero((heads[by_letter[1:]] == heads[by_letter[:-1]]) & (heads[by_letter[1:]] > 0))
    upper, lower = by_letter[next_to], by_letter[next_to + 1]
    match = 1 + common_prefix(x, levels, order[ends[upper]], order[starts[lower]])
    ahead, behind = np.zeros((2, len(starts)), np.int64)
    ahead[lower], behind[upper] = match, match
    return Index(heads, starts, lands, ahead, behind, sizes)


def stream(index: Index, length: int) -> list[list[tuple[int, int]]]:
    """Matching statistics of every text against all others and itself elsewhere: the spans covered by matches of ``length`` or more."""
    n = len(index.sizes)
    text, rank = np.arange(n), np.arange(n)  # each text starts at its mark
    ahead, behind, left = np.zeros(n, np.int64), np.zeros(n, np.int64), index.sizes.copy()
    ends = np.concatenate([index.starts[1:], [index.sizes.sum() + n]]) - 1
    found = []
    while len(text):
        going = left > 0
        if not going.all():
            text, rank, ahead, behind, left = text[going], rank[going], ahead[going], behind[going], left[going]
            continue
        run = np.searchsorted(index.starts, rank, side="right") - 1
        first, last = rank == index.starts[run], rank == ends[run]
        ahead = np.where(first, index.ahead[run], ahead + 1)
        behind = np.where(last, index.behind[run], behind + 1)
        rank = index.lands[run] + rank - index.starts[run]
        left = left - 1
        match = np.maximum(ahead, behind)
        long = match >= length
        if long.any():
            found.append((text[long], left[long], match[long]))
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if found:
        who, start, match = (np.concatenate(c) for c in zip(*found, strict=True))
        base = np.cumsum(index.sizes + 1) - (index.sizes + 1)
        cover = np.zeros(index.sizes.sum() + n + 1, np.int64)
        np.add.at(cover, base[who] + start, 1)
        np.add.at(cover, base[who] + start + match, -1)
        inside = np.concatenate([[0], (np.cumsum(cover[:-1]) > 0).astype(np.int8), [0]])
        rise, fall = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
        for s, e, t in zip(rise.tolist(), fall.tolist(), (np.searchsorted(base, rise, side="right") - 1).tolist(), strict=True):
            spans[t].append((s - int(base[t]), e - int(base[t])))
    return spans


INDEX = "length long, heads binary, starts binary, lands binary, ahead binary, behind binary, sizes binary, docs binary, places binary, single binary"

KINDS = ("<i4",) * 6 + ("<i8", "<i8", "u1")


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    words = bool(pdf["words"].iloc[0])
    index = build_index([np.frombuffer(t, np.uint64 if words else np.uint8) for t in pdf["run"]])
    rest = pdf["doc"].to_numpy(np.int64), pdf["start"].to_numpy(np.int64), pdf["single"].to_numpy(np.int64)
    return pd.DataFrame([(int(pdf["length"].iloc[0]), *(c.astype(kind).tobytes() for c, kind in zip((*index, *rest), KINDS, strict=True)))], columns=[c.split()[0] for c in INDEX.split(", ")])


def _stream(batches):
    for b in batches:
        for k in range(b.num_rows):
            row = b.slice(k, 1).to_pylist()[0]
            heads, starts, lands, ahead, behind, sizes, docs, places, single = (np.frombuffer(row[c], kind).astype(np.int64) for c, kind in zip(b.schema.names[1:], KINDS, strict=True))
            found = stream(Index(heads, starts, lands, ahead, behind, sizes), row["length"])
            out = [(docs[j], places[j] + s, places[j] + e) for j, spans in enumerate(found) if single[j] for s, e in spans]
            columns = np.array(out, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "start", "stop"])


def _cut_runs(kinds: list[Measure]):
    """Runs out of documents: (doc, text, runs: array of h, at, single, hot) to rows.  Copies of a row that follow each other give theirs once."""

    def run(batches):
        last = None
        for b in batches:
            rows = [[], [], [], [], [], []]
            for doc, text, runs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if doc == last:
                    continue
                last, units = doc, {}
                for r in runs:
                    words = r["h"] & 1
                    if words not in units:
                        units[words] = kinds[words].units(text)
                    start = r["at"] >> 20
                    stop = start + ((r["at"] >> 10) & 1023) + kinds[words].length
                    for column, value in zip(rows, (r["h"], doc, start, r["single"], r["hot"], units[words][start:stop].tobytes()), strict=True):
                        column.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["h", "doc", "start", "single", "hot", "run"])

    return run


def _single_windows(kinds: list[Measure]):
    def run(batches):
        for b in batches:
            columns = [[], [], [], []]
            for h, doc, start, units in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                measure = kinds[h & 1]
                w = rolling(np.frombuffer(units, np.uint64 if measure.words else np.uint8)).every(measure.length)
                n = len(w)
                for column, values in zip(columns, (np.full(n, h, np.int64), w.view(np.int64), np.full(n, doc, np.int64), start + np.arange(n, dtype=np.int64)), strict=True):
                    column.append(values)
                if len(columns[0]) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["h", "w", "doc", "start"])
                    columns = [[], [], [], []]
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["h", "w", "doc", "start"])

    return run


def repeated_spans(docs: DataFrame, kinds: list[Measure]) -> DataFrame:
    """``docs`` (doc: long key of the text's row, text) to spans doc, words, start, stop: counted in bytes, or in words where
    ``words`` is set.  They may overlap."""
    words = F.col("h").bitwiseAND(F.lit(1).cast("long")) == 1
    length = F.when(words, kinds[-1].length).otherwise(kinds[0].length)
    first = F.shiftright("at", 20)
    whole_run = ["doc", words.alias("words"), first.alias("start"), (first + F.shiftright(F.col("at").bitwiseAND(0xFFC00), 10) + length).alias("stop")]

    anchors = cut(docs.where("text IS NOT NULL").select("doc", "text").mapInArrow(_anchors(kinds), ANCHORS))
    seen = anchors.groupBy("h").agg(F.count("*").alias("n"), F.min("sup").alias("x"), F.max("sup").alias("y")).where("n > 1").select("h", "n", (F.col("x") < F.col("y")).alias("mixed"))
    seen = cut(seen)
    again = cut(join_hot(anchors, seen, "h", "n").drop("n"))
    discard(anchors, seen)
    mixed = again.where("mixed").drop("mixed")
    entries = cut(mixed.groupBy("h", "sup").agg(F.count("*").alias("n"), F.min(F.struct("doc", "at")).alias("one")))
    twice = join_hot(mixed, entries.where("n > 1").select("h", "sup", "n"), ["h", "sup"], "n", "left_semi")
    groups = entries.groupBy("h").agg(F.count("*").alias("entries"), F.min("n").alias("least")).where("least = 1")
    wanted = entries.join(groups, "h").select("h", F.col("one.doc").alias("doc"), F.col("one.at").alias("at"), (F.col("n") == 1).alias("single"), (F.col("entries") > GROUP_MAX).alias("hot"))
    per_doc = wanted.groupBy("doc").agg(F.collect_list(F.struct("h", "at", "single", "hot")).alias("runs"))
    runs = cut(docs.select("doc", "text").join(per_doc, "doc").mapInArrow(_cut_runs(kinds), "h long, doc long, start long, single boolean, hot boolean, run binary"))

    windows = runs.where("hot").select("h", "doc", "start", "run").mapInArrow(_single_windows(kinds), "h long, w long, doc long, start long")
    common = windows.groupBy("h", "w").agg(F.count("*").alias("n")).where("n > 1").select("h", "w")
    hot = windows.join(common, ["h", "w"], "left_semi").select("doc", words.alias("words"), "start", (F.col("start") + length).alias("stop"))

    cold = runs.where("NOT hot").withColumn("words", words).withColumn("length", length.cast("long"))
    letters = {r.words: r.n for r in cold.groupBy("words").agg(F.sum(F.octet_length("run") / F.when(F.col("words"), 8).otherwise(1)).alias("n")).collect()}  # two rows at most
    found = [again.where("NOT mixed").select(*whole_run), twice.select(*whole_run), hot]
    for kind, n in letters.items():
        buckets = F.pmod(F.xxhash64("h"), F.lit(max(1, int(n) // BUCKET_LETTERS)))
        own = cold.where(F.col("words") == kind).select("doc", "start", "single", "run", "words", "length", buckets.alias("bucket"))
        indexes = cut(own.groupBy("bucket").applyInPandas(_build, INDEX))
        found.append(indexes.mapInArrow(_stream, "doc long, start long, stop long").select("doc", F.lit(kind).alias("words"), "start", "stop"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _remove(batches):
    """Rows row, text, spans, passages to row, kept_bytes, removed, kept_text: the first two without the spans, the last also without the passages of words."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def without(data, cuts):
        joined, rest, at = [], [], 0
        for s, e in sorted(cuts):
            if joined and s <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], e)
            else:
                joined.append([s, e])
        for s, e in joined:
            rest.append(data[at:s])
            at = e
        return b"".join([*rest, data[at:]]), joined

    for b in batches:
        kept, removed, kept_text = [], [], []
        for text, spans, passages in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            cuts = [(s["start"], s["stop"]) for s in spans or ()]
            left, joined = without(data, cuts)
            kept.append(left)
            removed.append([{"start": s, "stop": e} for s, e in joined])
            if passages:
                first, after = word_places(np.frombuffer(data, np.uint8))
                left = without(data, cuts + [(int(first[s["start"]]), int(after[s["stop"] - 1])) for s in passages])[0]
            kept_text.append(left.decode("utf-8", "ignore"))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), pa.array(removed, kind), pa.array(kept_text, pa.string())], ["row", "kept_bytes", "removed", "kept_text"])


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, words: int | None = None) -> DataFrame:
    """``docs`` with three columns in place of the text column: kept_bytes (binary) and removed (array of start, stop in bytes) by
    strings of ``length`` bytes; kept_text, what is left of it as text, without the characters of which only a part is left and,
    where ``words`` is given, without passages of so many words that also start anywhere else."""
    kinds = measures(length, words)
    key = F.xxhash64(F.col(doc_id), F.col(text)).alias("doc")
    spans = repeated_spans(docs.select(key, F.col(text).alias("text")), kinds)
    found = [F.collect_set(F.when(F.col("words") == side, F.struct("start", "stop"))).alias(name) for name, side in (("spans", False), ("passages", True))]
    per_doc = spans.groupBy("doc").agg(*found)
    names = [c for c in docs.columns if c not in ("kept_bytes", "kept_text", "removed", text)]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text).alias("text"), key)
    joined = rows.join(per_doc, "doc", "left").select("row", "text", "spans", "passages")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("kept_bytes", T.BinaryType()), T.StructField("removed", span), T.StructField("kept_text", T.StringType())])
    return joined.mapInArrow(_remove, schema).select("row.*", "kept_bytes", "removed", "kept_text")
