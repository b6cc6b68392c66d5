"""MinHash near-duplicates: many universal hash minima, banding, signature verification, exact confirmation, components.

Steps.  (1) Every text becomes its set of word shingles and the keys of its bands of minima.  (2) Equal sets form a class and
only its smallest id goes on.  (3) Texts that share a band bucket are candidates.  A bucket is searched by its leader, not by
pairs: its smallest member meets all others.  (4) A candidate must first agree in its signature, then on the full sets of
64-bit shingle hashes.  (5) Components by alternating large-star and small-star.  (6) Buckets whose members are not all in one
component by then are open and are compared in one task, between components only.  Open buckets too large for one task are
first dealt anew by a prefix filter: with all shingles in one order, rare ones first, two texts at the percentage share one of
their first few, so such a bucket costs by rare shingles in common and not by pairs.  What a rare shingle still brings together in numbers is dealt
once more by pairs of shingles: a prefix longer by one holds two that both texts share.  Only links leave a task.

Bands and the least agreement of signatures follow from the percentage (``plan``): a pair just at it is missed by either with
probability under 6e-7, and less above.  At 85 that makes 25 bands of 5 minima, at 80 28 bands of 4.

Defined results: null and empty texts and texts without words have no shingles and are linked with nothing; fewer words than
a shingle make one shingle; a row without an id takes no part (component null, kept); rows that share an id are one document,
linked by whatever links one of their texts; very long texts are used whole; an empty table gives an empty result; other
columns do not take part.
"""

from __future__ import annotations

import functools
import math
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, discard, join_hot
from gridloom.llm.components import components

WORDS = 5
#: Minima of a signature, unless the least percentages need more.
MOST_MINIMA = 125
#: Probability that the bands, or the agreement of signatures, miss a pair just at the percentage.
MISS = 6e-7
#: Rows of a group that are compared with each other, or with another block, in one task.
BLOCK_ROWS = 1000
#: Rows of a shingle from which its texts are dealt by pairs of shingles.  That copies a row once for each other shingle of its prefix, where blocks copy
#: it once for each other block: below so many blocks these are fewer.
PAIR_ROWS = 16 * BLOCK_ROWS
#: Rows of an open bucket up to which it is compared as it is; larger ones are dealt anew by prefix.
BUCKET_ROWS = 64
#: Bits of the filter that picks the texts whose sets are needed (4 MB).
FILTER_BITS = 1 << 25
#: Counters of the table that orders shingles by how often they occur: about four a text, within these bounds (2 to 32 MB).
ORDER_SLOTS = 1 << 18, 1 << 22
_PLACES = np.random.default_rng(77).integers(1, 2**63, size=64, dtype=np.uint64) | np.uint64(1)


class Plan(NamedTuple):
    """Bands of a signature, minima of a band, and the share of minima that must agree."""

    bands: int
    rows: int
    agree: float


@functools.cache
def plan(percent: int) -> Plan:
    """The longest bands that MOST_MINIMA minima can give within MISS, and the largest share of them within MISS."""
    p = min(max(percent, 1), 99) / 100

    def needed(rows: int) -> int:
        return math.ceil(math.log(MISS) / math.log1p(-(p**rows)))

    rows = max((r for r in range(1, 32) if r * needed(r) <= MOST_MINIMA), default=1)
    n = rows * needed(rows)
    least, below = 0, 0.0
    while (below := below + math.comb(n, least) * p**least * (1 - p) ** (n - least)) < MISS:
        least += 1
    return Plan(needed(rows), rows, least / n)


@functools.cache
def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20240501).integers(1, 2**32, size=(2, n), dtype=np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (multiply and shift, three times)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class shingler:
    """Distinct shingle hashes of texts, ascending; word hashes are remembered within a task."""

    def __init__(self, n_words: int = WORDS, most: int = 150_000):
        import xxhash

        self.n, self.most, self.hash, self.known = n_words, most, xxhash.xxh3_64_intdigest, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
        if not words:
            return np.empty(0, np.uint64)
        if len(self.known) > self.most:
            self.known = {}
        known, digest = self.known, self.hash
        for w in set(words).difference(known):
            known[w] = digest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(h) < self.n:
            return mix(np.array([(h * _PLACES[: len(h)]).sum() + np.uint64(len(h))], np.uint64))
        total = np.zeros(len(h) - self.n + 1, np.uint64)
        for k in range(self.n):
            total += h[k : len(h) - self.n + 1 + k] * _PLACES[k]
        return np.unique(mix(total))


def signature(s: np.ndarray, n: int) -> np.ndarray:
    """``n`` minima of the universal hashes a * x + b modulo 2**32 over the upper halves x of the shingle hashes."""
    a, b = _multipliers(n)[0][:, None] | np.uint32(1), _multipliers(n)[1][:, None]
    x, least = (s >> np.uint64(32)).astype(np.uint32), np.full(n, np.uint32(2**32 - 1))
    for at in range(0, len(x), 2048):
        np.minimum(least, (x[None, at : at + 2048] * a + b).min(axis=1), out=least)
    return least


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    return int(s.sum(dtype=np.uint64).astype(np.int64)), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))


SCHEMA = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"


def _sketch(bands: int, band_rows: int):
    def run(batches):
        make = shingler()
        for b in batches:
            columns = [[], [], [], [], []]
            for ident, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s, keys = make(text), []
                if len(s):
                    grid = signature(s, bands * band_rows).reshape(bands, band_rows).astype(np.uint64)
                    key = np.arange(bands, dtype=np.uint64)
                    for k in range(band_rows):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + grid[:, k])
                    keys = key.view(np.int64)
                for column, value in zip(columns, (ident, len(s), *set_key(s), keys), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return run


def sketches(docs: DataFrame, percent: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    own = plan(percent)
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(_sketch(own.bands, own.rows), SCHEMA)


def id_filter(rows: DataFrame) -> np.ndarray:
    """Bits set at the hashes of the ids: a Bloom filter of fixed size, so it may go to every task; more ids only let more rows pass."""
    bit = rows.select(F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).alias("bit"))
    words = bit.select(F.floor(F.col("bit") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    found, bits = words.toPandas(), np.zeros(FILTER_BITS // 64, np.int64)  # at most FILTER_BITS / 64 rows
    bits[found["w"].to_numpy()] = found["b"].to_numpy()
    return bits


def _sets(wanted, minima: int):
    """Sets and signatures (the lower byte of each minimum, which can only agree more often than the whole) of the texts that pass the filter."""

    def run(batches):
        make = shingler()
        for b in batches:
            bit = b.column(2).to_numpy()
            at = pa.array(np.flatnonzero((wanted.value[bit // 64] >> (bit % 64)) & 1 == 1))
            columns = [[], [], [], []]
            for text in b.column(1).take(at).to_pylist():
                s = make(text)
                for column, value in zip(columns, (set_key(s)[0], len(s), signature(s, minima).astype("u1").tobytes(), s.astype("<u8").tobytes()), strict=True):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["id", "tag", "n", "signature", "set"])

    return run


def _agree(least: float):
    def run(batches):
        for b in batches:
            share = [(np.frombuffer(x, "u1") == np.frombuffer(y, "u1")).mean() for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
            at = pa.array(np.flatnonzero(np.array(share) >= least))
            yield pa.RecordBatch.from_arrays([b.column(k).take(at) for k in range(4)], ["a", "tag_a", "b", "tag_b"])

    return run


def shared_size(left: np.ndarray, right: np.ndarray) -> int:
    """Number of common members of two ascending sets."""
    return len(np.intersect1d(left, right, assume_unique=True))


def members_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An inverted index: all members of the sets in order, and whose they are."""
    owners, members = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
    order = np.argsort(members, kind="stable")
    return members[order], owners[order]


def shared_sizes(mine: np.ndarray, members: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """Number of members that each of the ``n`` indexed sets shares with ``mine``."""
    lo, hi = np.searchsorted(members, mine, "left"), np.searchsorted(members, mine, "right")
    size = hi - lo
    places = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
    return np.bincount(owners[places], minlength=n)


def _confirm(percent: int):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                left, right = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = shared_size(left, right)
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["u", "v"])

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, tag_a, b, tag_b) that agree in their signatures and then on the full sets, as edges u, v."""

    def beside(rows: DataFrame, column: str) -> DataFrame:
        for c in ("b", "a"):  # the side with few rows an id first; the other is a plain join, which adaptive execution can split
            rows = rows.join(sets.select(F.col("id").alias(c), F.col("tag").alias("tag_" + c), F.col(column).alias(f"{column}_{c}")), [c, "tag_" + c])
        return rows

    signed = beside(pairs, "signature").select("a", "tag_a", "b", "tag_b", "signature_a", "signature_b")
    likely = cut(signed.mapInArrow(_agree(plan(percent).agree), "a long, tag_a long, b long, tag_b long"))
    return beside(likely, "set").select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "u long, v long")


def _slots(s: np.ndarray, n: int) -> np.ndarray:
    return (s >> np.uint64(20)).astype(np.int64) % n


def _occurrences(slots: int):
    def run(batches):
        found = np.zeros(slots, np.int64)
        for b in batches:
            texts = [np.frombuffer(x, "<u8") for x in b.column(0).to_pylist()]
            found += np.bincount(_slots(np.concatenate([np.empty(0, np.uint64), *texts]), slots), minlength=slots)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["slot", "n"])

    return run


def prefix(s: np.ndarray, count: np.ndarray, percent: int, common: int = 1) -> np.ndarray:
    """The first shingles of a set in the order (count of the slot, hash): sets at the percentage have their first ``common`` shared ones in
    both prefixes, if they have to share so many."""
    n = len(s) - -(-percent * len(s) // 100) + common
    return s[np.lexsort((s, count[_slots(s, len(count))]))[:n]]


def _prefixes(count, percent: int):
    def run(batches):
        for b in batches:
            found = [prefix(np.frombuffer(x, "<u8"), count.value, percent) for x in b.column(2).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]).astype(np.int64))
            shingles = np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in (0, 1, 3)), pa.array(shingles)], ["id", "tag", "comp", "key"])

    return run


def _further(count, percent: int):
    """Rows key (a shingle), id, tag, comp, set to rows dealt by that shingle and each other one of the prefix that holds two shared ones."""

    def run(batches):
        for b in batches:
            found = []
            for key, x in zip(b.column(0).to_numpy().view(np.uint64), b.column(4).to_pylist(), strict=True):
                s = np.frombuffer(x, "<u8")
                other = prefix(s, count.value, percent, 2)
                other = other[other != key]
                if percent * len(s) <= 100:  # may share one shingle only, with a set as small
                    other = np.append(other, np.uint64(0))
                with np.errstate(over="ignore"):
                    found.append(mix(key * _PLACES[0] + other))
            at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]).astype(np.int64))
            keys = np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(b.column(k).take(at) for k in (1, 2, 3))], ["key", "id", "tag", "comp"])

    return run


def _compare(percent: int):
    """Links between different components in a block, or between two blocks of a group: signatures first, then full sets.
    For each text one link to each other component leaves the task."""
    agree = plan(percent).agree

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf["lo"].iloc[0] == pdf["hi"].iloc[0]
        pdf = pdf.sort_values("id")
        left, right = (pdf, pdf) if same else (pdf[pdf["block"] == pdf["lo"]], pdf[pdf["block"] == pdf["hi"]])
        s, t = (np.frombuffer(b"".join(x["signature"]), "u1").reshape(len(x), -1) for x in (left, right))
        i_id, j_id, i_comp, j_comp, i_n, j_n = (x[c].to_numpy() for c in ("id", "comp", "n") for x in (left, right))
        i_set, j_set = ([np.frombuffer(v, "<u8") for v in x["set"]] for x in (left, right))
        index, found = None, set()
        for i in range(len(s)):
            near = (j_comp != i_comp[i]) & (100 * np.minimum(i_n[i], j_n) >= percent * np.maximum(i_n[i], j_n))
            if same:
                near &= i_id[i] < j_id
            js = np.flatnonzero(near)
            js = js[(t[js] == s[i]).sum(axis=1) >= agree * s.shape[1]] if len(js) else js
            if len(js) > 8:
                index = index or members_of(j_set)
                both = shared_sizes(i_set[i], *index, len(j_set))[js]
            else:
                both = np.array([shared_size(i_set[i], j_set[j]) for j in js], np.int64)
            js = js[100 * both >= percent * (i_n[i] + j_n[js] - both)]
            found.update((int(i_id[i]), int(j_id[j])) for j in js[np.unique(j_comp[js], return_index=True)[1]])
        return pd.DataFrame(sorted(found), columns=["u", "v"]).astype("int64")

    return run


def _by_prefix(rows: DataFrame, sets: DataFrame, percent: int) -> list[tuple[DataFrame, DataFrame]]:
    """The texts of buckets (id, tag, comp) dealt anew, with the keys that are open (key, rows), all written: by the shingles of their prefixes, and what
    has over PAIR_ROWS rows under one shingle by pairs of shingles."""
    known = cut(sets.select("id", "tag", "set").join(rows.select("id", "tag", "comp").distinct(), ["id", "tag"]))
    size = min(ORDER_SLOTS[1], max(ORDER_SLOTS[0], 1 << (4 * known.count()).bit_length()))
    slots = known.select("set").mapInArrow(_occurrences(size), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # at most ``size`` rows
    count = np.zeros(size, np.int64)
    count[slots["slot"].to_numpy()] = slots["n"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(count)
    one = cut(known.mapInArrow(_prefixes(shared, percent), "id long, tag long, comp long, key long").select("key", "id", "tag", "comp"))
    keys = _open(one)
    many = keys.where(F.col("rows") > PAIR_ROWS)
    found = [(one, keys)]
    if not many.isEmpty():
        full = join_hot(one, many, "key", "rows").select("key", "id", "tag", "comp").join(known.select("id", "tag", "set"), ["id", "tag"])
        two = cut(full.select("key", "id", "tag", "comp", "set").mapInArrow(_further(shared, percent), "key long, id long, tag long, comp long"))
        few = cut(keys.where(F.col("rows") <= PAIR_ROWS))
        discard(keys)
        found = [(one, few), (two, _open(two))]
    discard(known)
    return found


def _open(rows: DataFrame) -> DataFrame:
    """The keys of rows (key, id, tag, comp) with two or more components and their number of rows, written."""
    return cut(rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("rows")).where("x < y").select("key", "rows"))


def _between(rows: DataFrame, keys: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links u, v between different components of the buckets (key, id, tag, comp; ``keys``: key, rows), written.  Up to
    BUCKET_ROWS rows a bucket is compared at once; larger ones are first dealt anew by prefix."""
    small = join_hot(rows, keys, "key", "rows")
    large = cut(small.where(F.col("rows") > BUCKET_ROWS).drop("rows"))
    small = small.where(F.col("rows") <= BUCKET_ROWS).withColumn("blocks", F.lit(1))
    written = [large]
    if not large.isEmpty():
        for dealt, groups in _by_prefix(large, sets, percent):
            placed = join_hot(dealt, groups, "key", "rows").withColumn("blocks", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int"))
            small = small.unionByName(placed)
            written += [dealt, groups]
    small = small.withColumn("block", F.pmod(F.xxhash64("id", "tag"), F.col("blocks")).cast("int"))
    met = small.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = met.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "tag", "comp")
    links = cut(paired.join(sets, ["id", "tag"]).groupBy("key", "lo", "hi").applyInPandas(_compare(percent), "u long, v long").distinct())
    discard(*written)
    return links


def _components(docs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Components (id, component) of the texts in ``docs`` (id, text) that share buckets: ``members`` (key, id, tag, n, lead)."""
    wanted = docs.sparkSession.sparkContext.broadcast(id_filter(members))
    own = plan(percent)
    keyed = docs.where("id IS NOT NULL").select("id", "text", F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).alias("bit"))
    found = keyed.mapInArrow(_sets(wanted, own.bands * own.rows), "id long, tag long, n long, signature binary, set binary")
    sets = cut(found.where("n > 0").dropDuplicates(["id", "tag"]))
    near = (F.col("id") != F.col("lead.id")) & (100 * F.least("n", "lead.n") >= percent * F.greatest("n", "lead.n"))
    pairs = members.where(near).select(F.col("lead.id").alias("a"), F.col("lead.tag").alias("tag_a"), F.col("id").alias("b"), F.col("tag").alias("tag_b")).distinct()
    comps = components(_linked(pairs, sets, percent))
    # The leader of a bucket has met all others; the bucket is open where these are in two or more components.
    rest = members.where("id <> lead.id").select("key", "id", "tag").join(comps, "id", "left").select("key", "id", "tag", F.coalesce("component", "id").alias("comp"))
    rest = cut(rest)
    keys = _open(rest)
    if not keys.isEmpty():
        links = _between(rest, keys, sets, percent)
        kept = comps.where("id <> component").select(F.col("id").alias("u"), F.col("component").alias("v"))
        before, comps = comps, components(kept.unionByName(links))
        discard(before, links)
    discard(sets, rest, keys)
    return comps


def near_duplicates(docs: DataFrame, percent: int = 85, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    all_rows = cut(sketches(docs, percent, text, doc_id))
    ids = all_rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = cut(ids.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")))
    rep = ids.join(classes.select("set_a", "set_b", F.col("rep").alias("doc_id")), ["set_a", "set_b", "doc_id"], "left_semi")
    banded = rep.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id"), F.col("set_a").alias("tag"), F.col("n_shingles").alias("n"))
    buckets = cut(banded.groupBy("key").agg(F.min(F.struct("id", "tag", "n")).alias("lead"), F.max("id").alias("last"), F.count("*").alias("rows")).where("lead.id < last").drop("last"))
    members = cut(join_hot(banded, buckets, "key", "rows"))

    if members.isEmpty():
        groups = classes.select("set_a", "set_b", F.col("rep").alias("component"))
    else:
        comps = _components(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")), members, percent)
        known = comps.select(F.col("id").alias("rep"), "component")
        groups = classes.join(known, "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    placed = all_rows.select("doc_id", "n_shingles", "set_a", "set_b").join(cut(groups), ["set_a", "set_b"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
    discard(buckets, members, classes)
    return placed.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))
