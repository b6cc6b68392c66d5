"""Blosc chunks: what is written is read back, and streams put together by the format's description."""

import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.sources import blosc, codecs


def chunk(blocks, total, block, size, flags):
    """Blocks (lists of streams) with their header."""
    starts, body, at = [], b"", 16 + 4 * len(blocks)
    for streams in blocks:
        starts.append(at + len(body))
        body += b"".join(struct.pack("<I", len(s)) + s for s in streams)
    return struct.pack("<BBBBIII", 2, 1, flags, size, total, block, at + len(body)) + struct.pack(f"<{len(starts)}I", *starts) + body


@settings(deadline=None, max_examples=150)
@given(st.binary(max_size=700), st.sampled_from([1, 2, 3, 4, 8]), st.sampled_from(["lz4", "lz4hc", "snappy", "zlib", "zstd"]), st.sampled_from([-1, 0, 1, 2]), st.integers(1, 40))
def test_round_trip(data, size, compressor, shuffle, often):
    data = data * often
    assert blosc.decode(blosc.encode(data, size, compressor, 5, shuffle)) == data


def test_several_blocks(monkeypatch):
    monkeypatch.setattr(blosc, "BLOCK", 256)
    data = np.arange(5003, dtype="<u2").tobytes()[:-1]
    small = blosc.encode(data, 2)
    assert struct.unpack_from("<I", small, 8)[0] == 256 and blosc.decode(small) == data


@pytest.mark.parametrize("number,press", [(1, lambda b: pa.Codec("lz4_raw").compress(b, asbytes=True)), (3, zlib.compress), (4, lambda b: pa.Codec("zstd").compress(b, asbytes=True))])
def test_blocks_split_into_streams(number, press):
    """Whole blocks have a stream for each byte of an element; the last one, which is shorter, has one."""
    data = np.arange(700, dtype="<u4")
    full, rest = data[:512].view(np.uint8).reshape(-1, 4).T, data[512:].view(np.uint8).reshape(-1, 4).T.tobytes()
    streams = [press(p.tobytes()) if len(press(p.tobytes())) < 512 else p.tobytes() for p in full]
    raw = chunk([streams, [press(rest)]], 2800, 2048, 4, number << 5 | 1)
    assert blosc.decode(raw) == data.tobytes()
    assert codecs.decode(raw, [{"name": "bytes"}, {"name": "numcodecs.blosc"}], 4) == data.tobytes()


def test_bits_are_planes_from_the_lowest():
    data = bytes([1, 0, 1, 0, 1, 0, 1, 0, 128, 0, 0, 0, 0, 0, 0, 255])
    planes = [sum((data[k] >> b & 1) << k for k in range(8)) | sum((data[8 + k] >> b & 1) << 8 + k for k in range(8)) for b in range(8)]
    stored = b"".join(p.to_bytes(2, "little") for p in planes)
    assert blosc.decode(chunk([[stored]], 16, 16, 1, 1 << 5 | 4 | 16)) == data


@pytest.mark.parametrize(
    "stream,want",
    [
        (bytes([2]) + b"abc", b"abc"),
        (bytes([0]) + b"a" + bytes([1 << 5, 0]), b"a" * 4),  # three bytes from one back
        (bytes([2]) + b"abc" + bytes([7 << 5, 4, 2]) + bytes([1]) + b"xy", b"abc" + (b"abc" * 5)[:13] + b"xy"),  # nine bytes and four more
        (bytes([0]) + b"a" + bytes([7 << 5, 255, 1, 0]), b"a" * 266),
    ],
)
def test_own_compressor(stream, want):
    assert blosc.blosclz(stream) == want
    assert len(stream) == len(want) or blosc.decode(chunk([[stream]], len(want), len(want), 1, 16)) == want


def test_own_compressor_far_back():
    far = b"".join(bytes([31]) + bytes((k * 7 + j) % 251 for j in range(32)) for k in range(300))
    plain = blosc.blosclz(far)
    # 8191 and 300 more, and one.
    got = blosc.blosclz(far + bytes([(2 << 5) | 31, 255]) + (300).to_bytes(2, "big"))
    assert got == plain + plain[len(plain) - 8492 :][:4]


@pytest.mark.parametrize("data", [b"", b"short", struct.pack("<BBBBIII", 2, 1, 0, 1, 100, 100, 999), chunk([[zlib.compress(b"abc")]], 90, 90, 1, 3 << 5 | 16)])
def test_damaged(data):
    with pytest.raises(codecs.DamagedChunk):
        blosc.decode(data)


def test_other_formats_raise():
    with pytest.raises(codecs.UnsupportedCodec):
        blosc.decode(struct.pack("<BBBBIII", 5, 1, 5, 4, 8, 8, 24) + bytes(16))
    with pytest.raises(codecs.UnsupportedCodec):
        blosc.encode(b"abc", 1, "blosclz")
