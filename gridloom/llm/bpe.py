"""BPE encoding and decoding through a distinct-word table.

(1) Words.  Spark cuts every text into an array of words (a run of white space and the run of other characters after it, where the
byte-level vocabulary always cuts too).  (2) Blocks.  A block of texts becomes its distinct words and each text as positions in that
list.  (3) Word table.  A block's distinct words go to buckets by their hash, packed into one row per block and bucket, so that
equal words of all blocks meet in one place, where each is encoded once.  (4) Join.  The ids go back, packed the same way, to the
block they came from and meet its positions: a join of one row per block and bucket, never of occurrences.  Ids of a text are its
words' ids in order of position.  (5) Decoding.  Every block is preceded by a row for each of its distinct ids; these meet the id-to-piece table
by a join, which is broadcast, as the table is as long as the vocabulary.  Such a join leaves rows where they are and in their order, so
the pieces reach the block without a shuffle, and its texts are put together from them; a piece that is not there fails loudly.

The blocks are derived twice from the same scan, once for their words and once for their positions, because that costs less
disk than keeping them; a block's key is a hash of its texts, and a block that does not find its words fails loudly.

Defined results: a null text is an empty one (no ids, empty text); an empty text likewise; very long texts are one row of one
block; repeated rows are encoded row by row; control strings of the vocabulary inside texts become their special ids, as in
the library's default; an empty table gives an empty result; other columns do not take part.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import width
from gridloom.llm.words import WHITE, encode_words, load

#: Bytes of text in a block, about.
BLOCK_BYTES = 10_000_000


class block:
    """Texts as an array of ids, an array of all their words and the number of words of each."""

    def __init__(self, ids: list[pa.Array], words: list[pa.Array]):
        self.ids = pa.concat_arrays(ids)
        self.words = pa.concat_arrays([w.flatten() for w in words])
        self.sizes = np.concatenate([np.diff(w.offsets.to_numpy()) for w in words])

    def key(self) -> int:
        import xxhash

        h = xxhash.xxh3_64(repr(self.ids.to_pylist()))
        h.update(self.sizes.astype("<i8").tobytes())
        for x in (pc.binary_length(self.words), self.words):  # concatenated anew, so the buffers hold no more than these words
            h.update(x.buffers()[-1])
        return int(np.uint64(h.intdigest()).astype(np.int64))


def _blocks(batches):
    """Blocks of about BLOCK_BYTES, over the batches (doc_id, words) of a task."""
    ids, words, size = [], [], 0
    for b in batches:
        lists = b.column(1)
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(lists.flatten()), 0).to_numpy())])
        at = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]  # bytes before each text of the batch
        begin = 0
        while begin < b.num_rows:
            end = min(b.num_rows, max(begin + 1, int(np.searchsorted(at, at[begin] + BLOCK_BYTES - size, "right")) - 1))
            ids.append(b.column(0).slice(begin, end - begin))
            words.append(lists.slice(begin, end - begin))
            size += int(at[end] - at[begin])
            begin = end
            if size >= BLOCK_BYTES or begin < b.num_rows:
                yield block(ids, words)
                ids, words, size = [], [], 0
    if ids:
        yield block(ids, words)


def _pack(*arrays) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(b"".join(bytes(x) if isinstance(x, pa.Buffer) else x for x in arrays))


def _unpack(x: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(x)


def _coded(own: block, buckets: int):
    """Distinct words in order of their bucket, the first of each bucket, and the texts as positions in that order."""
    coded = own.words.dictionary_encode()
    bucket = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), "<u4")
    rank[order] = np.arange(len(order), dtype="<u4")
    starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return coded.dictionary.take(pa.array(order)), starts, rank[coded.indices.to_numpy(zero_copy_only=False)]


def _word_lists(buckets: int):
    def run(batches):
        for own in _blocks(batches):
            words, starts, _ = _coded(own, buckets)
            if not len(words):
                continue
            ends = np.frombuffer(words.buffers()[1], "<i4")[: len(words) + 1]
            data, sizes = words.buffers()[2], np.diff(ends).astype("<u4")
            full = [k for k in range(buckets) if starts[k + 1] > starts[k]]
            packed = [_pack(sizes[starts[k] : starts[k + 1]].tobytes(), data.slice(int(ends[starts[k]]), int(ends[starts[k + 1]] - ends[starts[k]]))) for k in full]
            counts = [int(starts[k + 1] - starts[k]) for k in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([own.key()] * len(full), pa.int64()), pa.array(counts, pa.int32()), pa.array(packed, pa.binary())], ["bucket", "block", "n", "words"])

    return run


def _positions(buckets: int):
    def run(batches):
        for own in _blocks(batches):
            words, _, codes = _coded(own, buckets)
            planes = _pack(np.ascontiguousarray(codes.view(np.uint8).reshape(-1, 4).T).tobytes())
            columns = [pa.array([own.key()], pa.int64()), pa.array([own.ids.to_pylist()], pa.list_(pa.int64())), pa.array([own.sizes], pa.list_(pa.int32())), pa.array([len(words)], pa.int32()), pa.array([planes], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "doc_ids", "sizes", "n", "codes"])

    return run


def _encode(path: str):
    """Rows of one bucket stand together: every distinct word of a bucket is encoded once."""

    def run(batches):
        known: dict[str, bytes] = {}
        bucket = None
        for b in batches:
            for at in range(b.num_rows):
                if b.column(0)[at].as_py() != bucket:
                    bucket, known = b.column(0)[at].as_py(), {}
                n, raw = b.column(2)[at].as_py(), _unpack(b.column(3)[at].as_py())
                ends = np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<u4", n))]).astype("<i4")
                words = pa.StringArray.from_buffers(n, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw[4 * n :])).to_pylist()
                new = list(set(words).difference(known))
                known.update(zip(new, encode_words(path, new), strict=True))
                ids = [known[w] for w in words]
                sizes = np.fromiter(map(len, ids), "<u4", n) // 4
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 1), b.column(1).slice(at, 1), b.column(2).slice(at, 1), pa.array([_pack(sizes.astype("<u4").tobytes(), *ids)], pa.binary())], ["bucket", "block", "n", "ids"])

    return run


@lru_cache(maxsize=2)
def piece_table(path: str) -> np.ndarray:
    """Bytes of each id.  Byte-level pieces write every byte as one printable character."""
    tok = load(path)
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in keep)}
    special = {i: t.content for i, t in tok.get_added_tokens_decoder().items()}
    pieces = np.empty(tok.get_vocab_size(), dtype=object)
    for token, i in tok.get_vocab().items():
        pieces[i] = special[i].encode() if i in special else bytes(byte_of[c] for c in token)
    return pieces


def id_pieces(spark: SparkSession, path: str) -> DataFrame:
    """id and piece (bytes) of a vocabulary file: a row for each id."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                pieces = piece_table(path)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array(pieces.tolist(), pa.binary())], ["id", "piece"])

    return spark.range(1).mapInArrow(run, "id int, piece binary")


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """flat[starts[c] : starts[c] + sizes[c]] for each c of codes, one after the other."""
    n = sizes[codes]
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
    return flat[np.repeat(starts[codes], n) + at]


def _ids_of(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Number of ids of each word of a block, and all ids, from its packed ids in order of their buckets."""
    raw = [(_unpack(p["ids"]), p["n"]) for p in parts]
    sizes = np.concatenate([np.frombuffer(x, "<u4", n) for x, n in raw] or [np.empty(0, "<u4")]).astype(np.int64)
    return sizes, np.concatenate([np.frombuffer(x, "<u4", -1, 4 * n) if len(x) > 4 * n else np.empty(0, "<u4") for x, n in raw] or [np.empty(0, "<u4")])


def block_texts(row: dict):
    """doc_id and ids of every text of a block, from positions and packed ids."""
    planes = np.frombuffer(_unpack(row["codes"]), np.uint8).reshape(4, -1)  # the bytes of equal weight stand together
    codes = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
    parts = row["coded"] or []
    if sum(p["n"] for p in parts) != row["n"]:
        raise ValueError("a block of texts did not find its words: its scan did not repeat")
    width, flat = _ids_of(parts)
    starts = np.cumsum(width) - width
    at = 0
    for ident, n in zip(row["doc_ids"], row["sizes"], strict=True):
        yield ident, ragged(flat, starts, width, codes[at : at + n])
        at += n


def texts_of(batches):
    """doc_id and ids of every text, block by block."""
    for b in batches:
        for row in b.to_pylist():
            yield from block_texts(row)


BLOCK = "block long, doc_ids array<long>, sizes array<int>, n int, codes binary, coded array<struct<bucket:int,n:int,ids:binary>>"


def _name_ids(batches):
    """Every block after a row for each of its distinct ids."""
    for b in batches:
        for at in range(b.num_rows):
            one = b.slice(at, 1)
            used = np.unique(_ids_of(one.column("coded").to_pylist()[0] or [])[1]).astype("i4")
            names = [*b.schema.names, "id"]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(used), f.type) for f in b.schema], pa.array(used)], names)
            yield pa.RecordBatch.from_arrays([*one.columns, pa.nulls(1, pa.int32())], names)


def _decode(batches):
    pieces: dict[int, bytes] = {}  # of all blocks so far; no more than the vocabulary has
    out = [[], [], []]
    for b in batches:
        named = pc.is_valid(b.column("id"))
        told = b.filter(named)
        pieces.update(zip(told.column("id").to_pylist(), told.column("piece").to_pylist(), strict=True))
        for row in b.filter(pc.invert(named)).to_pylist():
            table = np.empty(max(pieces, default=-1) + 1, object)
            table[list(pieces)] = list(pieces.values())
            for ident, ids in block_texts(row):
                for column, value in zip(out, (ident, ids.tobytes(), b"".join(table[ids].tolist()).decode("utf-8", "replace")), strict=True):
                    column.append(value)
                if len(out[0]) == 500:
                    yield _out(out)
                    out = [[], [], []]
    yield _out(out)


def _out(columns):
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.string())], ["doc_id", "ids", "decoded"])


def words_of(text: Column) -> Column:
    """The words of a text, cut by Spark: together they are the whole text."""
    return F.split(F.coalesce(text, F.lit("")), f"(?=[{WHITE}])(?<=[^{WHITE}])")


def coded_blocks(docs: DataFrame, tokenizer_file: str, text: str, doc_id: str) -> DataFrame:
    """Blocks of texts with the ids of their distinct words, for :func:`texts_of`."""
    buckets = width(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), words_of(F.col(text)).alias("words"))
    lists = rows.mapInArrow(_word_lists(buckets), "bucket int, block long, n int, words binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    table = lists.mapInArrow(_encode(tokenizer_file), "bucket int, block long, n int, ids binary")
    coded = table.groupBy("block").agg(F.array_sort(F.collect_set(F.struct("bucket", "n", "ids"))).alias("coded"))
    positions = rows.mapInArrow(_positions(buckets), "block long, doc_ids array<long>, sizes array<int>, n int, codes binary")
    return positions.join(coded, "block", "left")


def encode_decode(docs: DataFrame, tokenizer_file: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, ids (binary: little-endian unsigned 32-bit), decoded."""
    named = coded_blocks(docs, tokenizer_file, text, doc_id).mapInArrow(_name_ids, f"{BLOCK}, id int")
    pieced = named.join(F.broadcast(id_pieces(docs.sparkSession, tokenizer_file)), "id", "left")
    return pieced.mapInArrow(_decode, "doc_id long, ids binary, decoded string")
