"""Blosc's chunk format, version 1 and 2 of it, which is what array stores hold: a header, a table of block starts, and blocks that are
shuffled and compressed each on its own, some of them as one stream for each byte of an element.

The compressors are those of Arrow and the standard library; only the format's own one (blosclz) is undone here, and is not written.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from gridloom.sources.codecs import DamagedChunk, UnsupportedCodec

# Fixed values of the format: numbers of the compressors, bits of the flags, and when blocks are split into streams.
NUMBERS = {"blosclz": 0, "lz4": 1, "lz4hc": 1, "snappy": 2, "zlib": 3, "zstd": 4}
BYTES, STORED, BITS, WHOLE = 0x01, 0x02, 0x04, 0x10
MAX_STREAMS, MIN_STREAM = 16, 128
#: Bytes of a block that is written, about.
BLOCK = 1 << 18


def _arrow(name: str):
    import pyarrow as pa

    return pa.Codec(name)


def _expand(data: bytes, number: int, size: int) -> bytes:
    """One stream of ``size`` bytes."""
    if len(data) == size:
        return data
    if number == 0:
        return blosclz(data)
    if number == 3:
        return zlib.decompress(data)
    if number not in (1, 2, 4):
        raise UnsupportedCodec(f"blosc compressor {number}")
    return _arrow({1: "lz4_raw", 2: "snappy", 4: "zstd"}[number]).decompress(data, size, asbytes=True)


def blosclz(data: bytes) -> bytes:
    """Runs of literals (lengths 1 to 32) and copies from before: three bits of length, thirteen of distance, both continued in further
    bytes where all their bits are set."""
    out, at, token = bytearray(), 1, data[0] & 31
    while True:
        if token < 32:
            out += data[at : at + token + 1]
            at += token + 1
        else:
            length, more = (token >> 5) + 2, 255 if token >> 5 == 7 else 0
            while more == 255:
                more = data[at]
                length, at = length + more, at + 1
            back, at = (token & 31) << 8 | data[at], at + 1
            if back == 0x1FFF:
                back, at = back + int.from_bytes(data[at : at + 2], "big"), at + 2
            back += 1
            if back > len(out):
                raise DamagedChunk("blosclz")
            seen = bytes(out[len(out) - back : len(out) - back + length])
            out += (seen * (length // back + 1))[:length]
        if at >= len(data):
            return bytes(out)
        token, at = data[at], at + 1


def _planes(block: bytes, size: int, bits: bool, undo: bool) -> bytes:
    """Elements of ``size`` bytes to planes of their bytes or bits, or back; what is no whole element stays behind them."""
    n = len(block) // size
    if n == 0 or (bits and n % 8) or (not bits and size == 1):
        return block
    raw, rest = np.frombuffer(block, np.uint8, n * size), block[n * size :]
    if not bits:
        return raw.reshape((size, n) if undo else (n, size)).T.tobytes() + rest
    if undo:
        flat = np.unpackbits(raw.reshape(size * 8, n // 8), axis=1, bitorder="little").T
    else:
        flat = np.unpackbits(raw.reshape(n, size), axis=1, bitorder="little").T
    return np.packbits(flat, axis=1, bitorder="little").tobytes() + rest


def decode(data: bytes) -> bytes:
    if len(data) < 16:
        raise DamagedChunk("blosc")
    version, _, flags, size, total, block, held = struct.unpack_from("<BBBBIII", data)
    if version > 2 or flags & (BYTES | BITS) == BYTES | BITS:
        raise UnsupportedCodec(f"blosc format {version}")
    if held > len(data) or (total and not block):
        raise DamagedChunk("blosc")
    if flags & STORED or not total:
        return data[16 : 16 + total]
    size, out = max(1, size), []
    starts = struct.unpack_from(f"<{-(-total // block)}I", data, 16)
    for k, at in enumerate(starts):
        length = min(block, total - k * block)
        split = not flags & WHOLE and size <= MAX_STREAMS and block // size >= MIN_STREAM and length == block
        streams = size if split else 1
        parts = []
        for _ in range(streams):
            (n,) = struct.unpack_from("<I", data, at)
            parts.append(_expand(data[at + 4 : at + 4 + n], flags >> 5, length // streams))
            at += 4 + n
        plain = b"".join(parts)
        if len(plain) != length:
            raise DamagedChunk("blosc")
        out.append(_planes(plain, size, bool(flags & BITS), True) if flags & (BYTES | BITS) else plain)
    return b"".join(out)


def encode(data: bytes, size: int, compressor: str = "lz4", level: int = 5, shuffle: str | int = "shuffle") -> bytes:
    """The inverse of :func:`decode`, a stream a block; bytes that do not shrink are stored."""
    number = NUMBERS.get(compressor)
    if not number:
        raise UnsupportedCodec(f"blosc with {compressor}")
    if shuffle == -1:
        shuffle = 2 if size == 1 else 1
    flag = {"noshuffle": 0, "shuffle": BYTES, "bitshuffle": BITS, 0: 0, 1: BYTES, 2: BITS}[shuffle]
    flags = number << 5 | flag | WHOLE
    block = max(1, min(len(data), max(BLOCK // (size * 8), 1) * size * 8))
    starts, body = [], bytearray()
    first = 16 + 4 * -(-len(data) // block)
    for at in range(0, len(data), block):
        plain = data[at : at + block]
        if flag:
            plain = _planes(plain, size, flag == BITS, False)
        if number == 3:
            small = zlib.compress(plain, level)
        else:
            name = {1: "lz4_raw", 2: "snappy", 4: "zstd"}[number]
            small = _arrow(name).compress(plain, asbytes=True)
        starts.append(first + len(body))
        small = small if len(small) < len(plain) else plain
        body += struct.pack("<I", len(small)) + small
    if first + len(body) >= 16 + len(data):
        return struct.pack("<BBBBIII", 2, 1, flags | STORED, size, len(data), block, 16 + len(data)) + data
    return struct.pack("<BBBBIII", 2, 1, flags, size, len(data), block, first + len(body)) + struct.pack(f"<{len(starts)}I", *starts) + body
