"""Bytes of array chunks to numpy arrays.  Codecs that are not at hand raise; none is passed over."""

from __future__ import annotations

import gzip
import zlib

import numpy as np


class UnsupportedCodec(ValueError):
    """A store names a codec that this library cannot undo."""


def _unshuffle(data: bytes, size: int) -> bytes:
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.tobytes() if size > 1 else data


class DamagedChunk(ValueError):
    """The checksum of a chunk does not fit its bytes."""


# Fixed value: the reversed Castagnoli polynomial.
CASTAGNOLI = 0x82F63B78


def _byte_steps() -> np.ndarray:
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, state >> 1 ^ np.uint32(CASTAGNOLI), state >> 1)
    return state


_STEP = _byte_steps()


def _apply(columns: np.ndarray, states: np.ndarray) -> np.ndarray:
    """A linear map, given by what it makes of each of the 32 bits."""
    bits = states[:, None] >> np.arange(32, dtype=np.uint32) & 1
    return np.bitwise_xor.reduce(np.where(bits == 1, columns[None, :], np.uint32(0)), axis=1)


def crc32c(data: bytes) -> int:
    """CRC-32C, over many stretches of the bytes at once: the checksum is linear, so those of neighbours combine."""
    raw = np.frombuffer(data, np.uint8)
    head = np.zeros(max(4, len(raw)), np.uint8)
    if len(raw) < 4:  # too short for the start value to be folded into the bytes
        state = 0xFFFFFFFF
        for byte in raw.tolist():
            state = int(_STEP[(state ^ byte) & 255]) ^ state >> 8
        return state ^ 0xFFFFFFFF
    head[:] = raw
    head[:4] ^= 255
    lanes = 1 << (len(head).bit_length() // 2)
    length = -(-len(head) // lanes)
    grid = np.concatenate([np.zeros(lanes * length - len(head), np.uint8), head]).reshape(lanes, length)
    state = np.zeros(lanes, np.uint32)
    for column in grid.T:
        state = _STEP[(state ^ column) & 255] ^ state >> 8
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    zero, far, n = _STEP[bits & 255] ^ bits >> 8, bits, length  # one zero byte; ``length`` of them
    while n:
        if n & 1:
            far = _apply(zero, far)
        zero, n = _apply(zero, zero), n >> 1
    while len(state) > 1:
        state, far = _apply(far, state[::2]) ^ state[1::2], _apply(far, far)
    return int(state[0]) ^ 0xFFFFFFFF


def decode(data: bytes, codecs: list[dict], itemsize: int, verify: bool = False) -> bytes:
    """Undo ``codecs`` (name, configuration), listed in the order in which they were applied; ``verify`` compares checksums, which
    are cut off otherwise."""
    for codec in reversed(codecs):
        name = codec["name"].removeprefix("numcodecs.")
        if name in ("bytes", "bitround"):
            continue
        if name == "gzip":
            data = gzip.decompress(data)
        elif name == "zlib":
            data = zlib.decompress(data)
        elif name == "zstd":
            import zstandard

            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        elif name == "shuffle":
            data = _unshuffle(data, codec.get("configuration", {}).get("elementsize", itemsize))
        elif name == "crc32c":
            if verify and crc32c(data[:-4]) != int.from_bytes(data[-4:], "little"):
                raise DamagedChunk("crc32c")
            data = data[:-4]
        elif name == "blosc":
            from gridloom.sources import blosc

            data = blosc.decode(data)
        else:
            raise UnsupportedCodec(name)
    return data


def encode(data: bytes, codecs: list[dict], itemsize: int) -> bytes:
    """Apply ``codecs`` in order; the inverse of :func:`decode` for those that it can undo and that keep every bit."""
    for codec in codecs:
        name, size = codec["name"], codec.get("configuration", {}).get("elementsize", itemsize)
        if name == "bytes":
            continue
        if name == "gzip":
            data = gzip.compress(data, mtime=0)
        elif name == "zlib":
            data = zlib.compress(data)
        elif name == "zstd":
            import zstandard

            data = zstandard.ZstdCompressor().compress(data)
        elif name == "shuffle":
            data = np.frombuffer(data, np.uint8).reshape(-1, size).T.tobytes() if size > 1 else data
        elif name == "crc32c":
            data += crc32c(data).to_bytes(4, "little")
        elif name == "blosc":
            from gridloom.sources import blosc

            how = codec.get("configuration", {})
            data = blosc.encode(data, how.get("typesize", itemsize), how.get("cname", "lz4"), how.get("clevel", 5), how.get("shuffle", "shuffle"))
        else:
            raise UnsupportedCodec(name)
    return data


def packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, highest bit first, 256 clears and 257 ends; widths grow one code early."""
    table: list[bytes] = []
    out, width, bits, held, last = [], 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        while bits >= width:
            bits -= width
            code = (held >> bits) & ((1 << width) - 1)
            held &= (1 << bits) - 1
            if code == 256:
                table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
                continue
            if code == 257:
                return b"".join(out)
            if not last:
                last = table[code]
                out.append(last)
                continue
            entry = table[code] if code < len(table) else last + last[:1]
            out.append(entry)
            table.append(last + entry[:1])
            last = entry
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
    return b"".join(out)


def unpredict(rows: np.ndarray, predictor: int) -> np.ndarray:
    """Rows of samples (height, width, samples); 2: running sums that wrap, 3: byte planes of floats, high bytes first."""
    if predictor == 2:
        kind = rows.dtype
        whole = rows.view(f"u{kind.itemsize}") if kind.kind != "u" else rows
        return np.cumsum(whole, axis=1, dtype=whole.dtype).view(kind)
    if predictor == 3:
        height, width, samples = rows.shape
        size = rows.dtype.itemsize
        flat = np.ascontiguousarray(rows).view(np.uint8).reshape(height, width * samples * size)
        steps = flat.reshape(height, -1, samples)
        planes = np.cumsum(steps, axis=1, dtype=np.uint8).reshape(height, size, width * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{size}").reshape(height, width, samples).astype(f"f{size}")
    return rows
