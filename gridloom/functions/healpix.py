"""HEALPix pixels (Gorski et al. 2005) as column expressions; angles in radians, pixels as long."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ring and longitude offsets of the twelve base faces.
FACE_RING = [2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4]
FACE_PHI = [1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7]


def _long(c: Column) -> Column:
    return c.cast("long")


def let(body, **values: Column) -> Column:
    """``body`` of a struct of the values, each computed once however often the body names it."""
    return F.element_at(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), 1)


def npix(nside: int) -> int:
    return 12 * nside * nside


def nside_of(pixels: Column) -> Column:
    """nside for a pixel count; null unless it is 12 times a square."""
    n = _long(F.round(F.sqrt(pixels / 12)))
    return F.when(12 * n * n == pixels, n)


def _cap_ring(p: Column) -> Column:
    """Ring, from 1, of the p-th pixel counted from a pole."""
    return F.greatest(_long(F.floor((1.0 + F.sqrt(1.0 + 2.0 * p)) * 0.5)), F.lit(1).cast("long"))


def pix2ring(nside: int, pix: Column) -> Column:
    """struct<ring, index>: ring from 1 and place in it from 0."""
    cap, total = 2 * nside * (nside - 1), npix(nside)
    north, south = _cap_ring(pix), _cap_ring(total - 1 - pix)
    belt = pix - cap
    pair = lambda r, i: F.struct(_long(r).alias("ring"), _long(i).alias("index"))
    return (
        F.when(pix < cap, pair(north, pix - 2 * north * (north - 1)))
        .when(pix < total - cap, pair(nside + F.floor(belt / (4 * nside)), belt % (4 * nside)))
        .otherwise(pair(4 * nside - south, pix - (total - 2 * south * (south + 1))))
    )


def pix2ang(nside: int, pix: Column) -> Column:
    """struct<lon, lat> of a pixel's centre, ring order."""

    def centre(s: Column) -> Column:
        r, i = s["at"]["ring"], s["at"]["index"]
        cap = F.least(r, 4 * nside - r)
        z = F.when(cap < nside, F.when(r < nside, 1.0).otherwise(-1.0) * (1.0 - (cap * cap) / (3.0 * nside * nside))).otherwise(2.0 * (2.0 * nside - r) / (3.0 * nside))
        lon = F.when(cap < nside, (i + 0.5) * math.pi / (2.0 * cap)).otherwise((i + F.when((r - nside) % 2 == 0, 0.5).otherwise(0.0)) * math.pi / (2.0 * nside))
        return F.struct(lon.alias("lon"), F.asin(z).alias("lat"))

    return let(centre, at=pix2ring(nside, pix))


def ang2pix(nside: int, lon: Column, lat: Column) -> Column:
    """Pixel that holds a point, ring order."""
    total, cap = npix(nside), 2 * nside * (nside - 1)

    def belt(s: Column) -> Column:
        jp, jm = _long(F.floor(nside * (0.5 + s["tt"]) - nside * (0.75 * s["z"]))), _long(F.floor(nside * (0.5 + s["tt"]) + nside * (0.75 * s["z"])))

        def place(q: Column) -> Column:
            ir = nside + 1 + q["jp"] - q["jm"]
            ip = _long(F.floor((q["jp"] + q["jm"] - nside + (1 - F.pmod(ir, F.lit(2))) + 1) / 2))
            return cap + (ir - 1) * (4 * nside) + F.pmod(ip, F.lit(4 * nside))

        return let(place, jp=jp, jm=jm)

    def polar(s: Column) -> Column:
        tp = s["tt"] - F.floor(s["tt"])
        reach = nside * F.sqrt(3.0 * (1.0 - F.abs(s["z"])))
        ring = _long(F.floor(tp * reach)) + _long(F.floor((1.0 - tp) * reach)) + 1

        def place(q: Column) -> Column:
            inner = _long(F.floor(q["tt"] * q["ring"])) % (4 * q["ring"])
            return F.when(q["z"] > 0, 2 * q["ring"] * (q["ring"] - 1) + inner).otherwise(total - 2 * q["ring"] * (q["ring"] + 1) + inner)

        return let(place, ring=ring, tt=s["tt"], z=s["z"])

    point = {"z": F.sin(lat), "tt": F.pmod(lon, F.lit(2 * math.pi)) / (0.5 * math.pi)}
    return let(lambda s: _long(F.when(F.abs(s["z"]) <= 2.0 / 3.0, belt(s)).otherwise(polar(s))), **point)


#: For each byte: its bits at even places of 16, and its bits at even places together in 4.
SPREAD = [sum((v >> k & 1) << 2 * k for k in range(8)) for v in range(256)]
GATHER = [sum((v >> 2 * k & 1) << k for k in range(4)) for v in range(256)]


def _by_byte(table: list[int], c: Column, n: int, step: int) -> Column:
    """The table's entries for the ``n`` lowest bytes of c, ``step`` bits apart."""
    entries = F.array(*[F.lit(v).cast("long") for v in table])
    out = F.lit(0).cast("long")
    for k in range(n):
        byte = F.shiftright(c, 8 * k).bitwiseAND(F.lit(255).cast("long")).cast("int")
        out = out.bitwiseOR(F.shiftleft(F.get(entries, byte), step * k))
    return out


def interleave(x: Column, y: Column, bits: int = 29) -> Column:
    """The lower ``bits`` bits of x at even and of y at odd places; bit by bit, which generated code does fastest."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        for odd, c in enumerate((x, y)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(_long(c), k).bitwiseAND(1), 2 * k + odd))
    return out


def _interleave_by_byte(x: Column, y: Column, bits: int) -> Column:
    """The same for variables of a lambda, which is interpreted: fewer steps."""
    low, n = F.lit((1 << bits) - 1), -(-bits // 8)
    return _by_byte(SPREAD, _long(x).bitwiseAND(low), n, 16).bitwiseOR(F.shiftleft(_by_byte(SPREAD, _long(y).bitwiseAND(low), n, 16), 1))


def deinterleave(m: Column, bits: int = 29) -> Column:
    """struct<x, y> of :func:`interleave`."""
    n = -(-bits // 4)
    parts = lambda s: F.struct(_by_byte(GATHER, s["m"], n, 4).alias("x"), _by_byte(GATHER, F.shiftright(s["m"], 1), n, 4).alias("y"))
    return let(parts, m=_long(m).bitwiseAND(F.lit((1 << 2 * bits) - 1)))


def _of_face(table: list[int], face: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in table]), (face + 1).cast("int"))


def nest2ring(nside: int, pix: Column) -> Column:
    """Ring-order pixel of a nested-order pixel."""
    bits = max(1, nside.bit_length() - 1)
    area, total, cap = nside * nside, npix(nside), 2 * nside * (nside - 1)

    def ringed(s: Column) -> Column:
        return let(number, ring=_of_face(FACE_RING, s["face"]) * nside - s["at"]["x"] - s["at"]["y"] - 1, lean=s["at"]["x"] - s["at"]["y"], phi=_of_face(FACE_PHI, s["face"]))

    def number(s: Column) -> Column:
        ring = s["ring"]
        edge = F.least(ring, 4 * nside - ring)
        n = F.least(edge, F.lit(nside))
        shift = F.when((ring < nside) | (ring > 3 * nside), 0).otherwise(F.pmod(ring - nside, F.lit(2)))
        ip = _long(F.floor((s["phi"] * n + s["lean"] + 1 + shift) / 2))
        start = F.when(ring < nside, 2 * ring * (ring - 1)).when(ring <= 3 * nside, cap + (ring - nside) * (4 * nside)).otherwise(total - 2 * edge * (edge + 1))
        return _long(start + F.pmod(ip - 1, 4 * n))

    return let(ringed, face=_long(F.floor(pix / area)), at=deinterleave(pix % area, bits))


def ring2nest(nside: int, pix: Column) -> Column:
    """Nested-order pixel of a ring-order pixel.

    On a face, x + y falls with the ring and x - y grows with the longitude.  In a polar cap the quarter of the ring says the face; in
    the belt the two diagonal coordinates, taken over all faces at once, count faces in multiples of nside."""
    bits = max(1, nside.bit_length() - 1)

    def placed(s: Column) -> Column:
        ring, i = s["at"]["ring"], s["at"]["index"]
        south = ring > 3 * nside
        edge = F.least(ring, 4 * nside - ring)
        quarter = _long(F.floor(i / edge))
        turn = 2 * (i - quarter * edge) + 1 - edge  # x - y in a cap
        height = F.when(south, 4 * nside - 1 - ring).otherwise(2 * nside - 1 - ring)  # x + y there
        cap_face = quarter + F.when(south, 8).otherwise(0)
        u = 2 * i + 1 - F.pmod(ring - nside, F.lit(2))
        a, b = u - ring - 1 + nside, -u - ring - 1 + nside  # twice x and y, but for whole faces
        kx, ky = -_long(F.floor(a / (2 * nside))), -_long(F.floor(b / (2 * nside)))
        row = kx + ky + 1  # 2, 3, 4: the ring of faces
        column = F.pmod(ky - kx, F.lit(8))
        belt_face = 4 * (row - 2) + _long(F.floor(column / 2))
        in_cap = (ring < nside) | south
        x = F.when(in_cap, (height + turn) / 2).otherwise(F.pmod(a, F.lit(2 * nside)) / 2)
        y = F.when(in_cap, (height - turn) / 2).otherwise(F.pmod(b, F.lit(2 * nside)) / 2)
        face = F.when(in_cap, cap_face).otherwise(belt_face)
        return let(lambda f: f["face"] * (nside * nside) + _interleave_by_byte(f["x"], f["y"], bits), face=face, x=x, y=y)

    return _long(let(placed, at=pix2ring(nside, pix)))


def pix2ang_nested(nside: int, pix: Column) -> Column:
    """struct<lon, lat> of a nested-order pixel's centre."""
    return pix2ang(nside, nest2ring(nside, pix))


def ang2pix_nested(nside: int, lon: Column, lat: Column) -> Column:
    """Pixel that holds a point, nested order."""
    return ring2nest(nside, ang2pix(nside, lon, lat))
