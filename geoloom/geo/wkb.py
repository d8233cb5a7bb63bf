"""Geometries as plain values, and their codecs: WKB, WKT, GeoJSON.

A geometry is ``(kind, parts)``. kind is the name. parts is an (n, 2) float array for
Point and LineString (n = 0: empty), a list of such rings for Polygon, and a list of
geometries for the multi types and GeometryCollection. Z and M are dropped.
"""

from __future__ import annotations

import json
import math
import re
import struct

import numpy as np
import pyarrow as pa

Geometry = tuple[str, object]

KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
CURVES = {8: "CircularString", 9: "CompoundCurve", 10: "CurvePolygon", 11: "MultiCurve", 12: "MultiSurface", 13: "Curve", 14: "Surface", 15: "PolyhedralSurface", 16: "TIN", 17: "Triangle"}
CODES = {v: k for k, v in KINDS.items()}
#: Segments that a quarter of a circle is drawn with.
QUARTER = 8


class GeometryError(ValueError):
    """Bytes or text that are no geometry."""


def _points(values) -> np.ndarray:
    return np.asarray(values, np.float64).reshape(-1, 2)


class _Reader:
    def __init__(self, data: bytes, quarter: int) -> None:
        self.data, self.at, self.quarter = data, 0, quarter

    def take(self, fmt: str):
        try:
            out = struct.unpack_from(fmt, self.data, self.at)
        except struct.error as e:
            raise GeometryError("WKB ends too early") from e
        self.at += struct.calcsize(fmt)
        return out

    def header(self) -> tuple[str, int, int]:
        order = "<" if self.take("B")[0] == 1 else ">"
        code = self.take(order + "I")[0]
        dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
        if code & 0x20000000:
            self.take(order + "I")
        code &= 0x0FFFFFFF
        iso, code = divmod(code, 1000)
        dims = max(dims, {0: 2, 1: 3, 2: 3, 3: 4}.get(iso, 2))
        return order, code, dims

    def coords(self, order: str, dims: int, n: int | None = None) -> np.ndarray:
        n = self.take(order + "I")[0] if n is None else n
        size = 8 * dims * n
        if self.at + size > len(self.data):
            raise GeometryError("WKB ends too early")
        out = np.frombuffer(self.data, order + "f8", dims * n, self.at).reshape(n, dims)[:, :2].astype(np.float64)
        self.at += size
        return out

    def geometry(self) -> Geometry:
        order, code, dims = self.header()
        if code == 1:
            p = self.coords(order, dims, 1)
            return "Point", p[:0] if np.isnan(p).all() else p
        if code == 2:
            return "LineString", self.coords(order, dims)
        if code in (3, 17):
            return "Polygon", [self.coords(order, dims) for _ in range(self.take(order + "I")[0])]
        if code == 8:
            return "LineString", arc_points(self.coords(order, dims), self.quarter)
        if code in (4, 5, 6, 7, 9, 10, 11, 12, 15, 16):
            parts = [self.geometry() for _ in range(self.take(order + "I")[0])]
            if code == 9:
                return "LineString", _chain(p[1] for p in parts)
            if code == 10:
                return "Polygon", [p[1] for p in parts]
            if code in (11, 5):
                return "MultiLineString", parts
            if code in (12, 6, 15, 16):
                return "MultiPolygon", parts
            return KINDS[code], parts
        raise GeometryError(f"WKB type {code} isn't known")


def _chain(lines) -> np.ndarray:
    out: list[np.ndarray] = []
    for line in lines:
        out.append(line[1:] if out and len(line) and len(out[-1]) and np.array_equal(out[-1][-1], line[0]) else line)
    return np.concatenate(out) if out else _points([])


def arc_points(control: np.ndarray, quarter: int = QUARTER) -> np.ndarray:
    """A circular string as straight segments; collinear control points give chords."""
    if len(control) < 3:
        return control
    out = [control[0]]
    for i in range(0, len(control) - 2, 2):
        a, b, c = control[i : i + 3]
        if np.array_equal(a, c):
            # A whole circle whose far point is b.
            center, turn = (a + b) / 2, 2 * math.pi
        else:
            (ax, ay), (bx, by), (cx, cy) = a, b, c
            d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
            if abs(d) < 1e-12 * max(1.0, abs(ax), abs(ay), abs(cx), abs(cy)):
                out += [b, c]
                continue
            sa, sb, sc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
            center = np.array([(sa * (by - cy) + sb * (cy - ay) + sc * (ay - by)) / d, (sa * (cx - bx) + sb * (ax - cx) + sc * (bx - ax)) / d])
            ta, tb, tc = (math.atan2(*(p - center)[::-1]) for p in (a, b, c))
            turn = (tc - ta) % (2 * math.pi)
            if (tb - ta) % (2 * math.pi) > turn:
                turn -= 2 * math.pi
        steps = max(2, math.ceil(abs(turn) / (math.pi / 2) * quarter))
        radius, begin = math.hypot(*(a - center)), math.atan2(*(a - center)[::-1])
        angles = begin + turn * np.arange(1, steps) / steps
        out += list(center + radius * np.column_stack([np.cos(angles), np.sin(angles)]))
        out.append(c)
    return _points(out)


def decode(data: bytes, quarter: int = QUARTER) -> Geometry:
    """WKB or EWKB of any type; curves become straight segments."""
    return _Reader(bytes(data), quarter).geometry()


def wkb_type(data: bytes) -> str:
    """Name of the type in a WKB header."""
    code = _Reader(bytes(data), QUARTER).header()[1]
    return KINDS.get(code) or CURVES.get(code) or f"Unknown({code})"


def is_nonlinear(data: bytes) -> bool:
    return 8 <= _Reader(bytes(data), QUARTER).header()[1] <= 14


def linearize(data: bytes | None, quarter: int = QUARTER) -> bytes | None:
    """WKB without curves; null stays null."""
    return None if data is None else encode(decode(data, quarter)) if is_nonlinear(data) else bytes(data)


_PLAIN = {bytes([1]) + struct.pack("<I", k) for k in KINDS} | {bytes([0]) + struct.pack(">I", k) for k in KINDS}


def linearized(values) -> list[bytes | None]:
    """``linearize`` of many: what has no curves is told by its first bytes, single arcs are drawn together."""
    out = [None if v is None else bytes(v) for v in values]
    single: list[int] = []
    for i, v in enumerate(out):
        if v is None or v[:5] in _PLAIN:
            continue
        if len(v) == 57 and v[:9] == _ARC:
            single.append(i)
        else:
            out[i] = linearize(v)
    if single:
        control = np.frombuffer(b"".join(out[i][9:] for i in single), "<f8").reshape(-1, 3, 2)
        for i, c, points in zip(single, control, arcs(control)):
            out[i] = encode(("LineString", arc_points(c) if points is None else points))
    return out


_ARC = struct.pack("<BII", 1, 8, 3)


def arcs(control: np.ndarray, quarter: int = QUARTER) -> list[np.ndarray | None]:
    """``arc_points`` of many arcs of three points; None where it goes another way (whole circles, points on a line, any not finite)."""
    a, b, c = (control[:, i] for i in range(3))
    (ax, ay), (bx, by), (cx, cy) = a.T, b.T, c.T
    with np.errstate(all="ignore"):
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        plain = np.isfinite(control).all((1, 2)) & (a != c).any(1) & ~(np.abs(d) < 1e-12 * np.maximum.reduce([np.ones(len(d)), abs(ax), abs(ay), abs(cx), abs(cy)]))
        sa, sb, sc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        center = np.column_stack([(sa * (by - cy) + sb * (cy - ay) + sc * (ay - by)) / d, (sa * (cx - bx) + sb * (ax - cx) + sc * (bx - ax)) / d])
        ta, tb, tc = (np.arctan2(*(p - center).T[::-1]) for p in (a, b, c))
        turn = (tc - ta) % (2 * math.pi)
        turn = np.where((tb - ta) % (2 * math.pi) > turn, turn - 2 * math.pi, turn)
        steps = np.maximum(2, np.ceil(np.abs(turn) / (math.pi / 2) * quarter))
        radius = np.hypot(*(a - center).T)
    out: list[np.ndarray | None] = [None] * len(control)
    for k in np.unique(steps[plain]).astype(int).tolist():
        own = np.flatnonzero(plain & (steps == k))
        angles = ta[own, None] + turn[own, None] * np.arange(1, k) / k
        inner = center[own, None] + radius[own, None, None] * np.stack([np.cos(angles), np.sin(angles)], 2)
        for i, points in zip(own.tolist(), np.concatenate([a[own, None], inner, c[own, None]], 1)):
            out[i] = points
    return out


def encode(g: Geometry) -> bytes:
    """Little-endian 2-D WKB."""
    kind, parts = g
    head = struct.pack("<BI", 1, CODES[kind])
    if kind == "Point":
        return head + (np.ascontiguousarray(parts, "<f8").tobytes() if len(parts) else struct.pack("<2d", math.nan, math.nan))
    if kind == "LineString":
        return head + struct.pack("<I", len(parts)) + np.ascontiguousarray(parts, "<f8").tobytes()
    if kind == "Polygon":
        return head + struct.pack("<I", len(parts)) + b"".join(struct.pack("<I", len(r)) + np.ascontiguousarray(r, "<f8").tobytes() for r in parts)
    return head + struct.pack("<I", len(parts)) + b"".join(map(encode, parts))


def vertices(g: Geometry) -> np.ndarray:
    """All coordinates, parts in order."""
    kind, parts = g
    if kind in ("Point", "LineString"):
        return parts
    if not parts:
        return _points([])
    return np.concatenate([p if kind == "Polygon" else vertices(p) for p in parts])


def is_empty(g: Geometry) -> bool:
    return not len(vertices(g))


def bounds(g: Geometry) -> tuple[float, float, float, float] | None:
    v = vertices(g)
    return None if not len(v) else (*v.min(axis=0).tolist(), *v.max(axis=0).tolist())


def atoms(g: Geometry) -> list[Geometry]:
    """Points, lines and polygons, collections of any depth opened."""
    kind, parts = g
    return [g] if kind in ("Point", "LineString", "Polygon") else [a for p in parts for a in atoms(p)]


def _ring_moment(r: np.ndarray) -> tuple[float, float, float]:
    o = r[0]
    x, y = (r - o).T
    cross = x[:-1] * y[1:] - x[1:] * y[:-1]
    return float(cross.sum()) / 2, float(((x[:-1] + x[1:]) * cross).sum()) / 6, float(((y[:-1] + y[1:]) * cross).sum()) / 6


def centroid(g: Geometry) -> tuple[float, float] | None:
    """Of the parts of the highest dimension, weighted by area, length or number."""
    parts = [a for a in atoms(g) if not is_empty(a)]
    if not parts:
        return None
    area = mx = my = 0.0
    for kind, rings in parts:
        if kind == "Polygon":
            for i, r in enumerate(rings):
                if len(r) < 3:
                    continue
                s, a, b = _ring_moment(r if np.array_equal(r[0], r[-1]) else np.vstack([r, r[:1]]))
                sign = math.copysign(1, s) * (1 if i == 0 else -1)
                area += sign * s
                mx += sign * (a + r[0][0] * s)
                my += sign * (b + r[0][1] * s)
    if area:
        return mx / area, my / area
    total = 0.0
    for kind, v in parts:
        for line in [v] if kind == "LineString" else v if kind == "Polygon" else []:
            d = np.hypot(*np.diff(line, axis=0).T)
            mid = (line[:-1] + line[1:]) / 2
            total += float(d.sum())
            mx += float((mid[:, 0] * d).sum())
            my += float((mid[:, 1] * d).sum())
    if total:
        return mx / total, my / total
    v = np.concatenate([vertices(p) for p in parts])
    return tuple(v.mean(axis=0).tolist())


# --- GeoJSON ---------------------------------------------------------------


def from_geojson(value: dict | str | None) -> Geometry | None:
    """A GeoJSON geometry or feature; null stays null."""
    if isinstance(value, str):
        value = json.loads(value)
    if value is None:
        return None
    kind = value.get("type")
    if kind == "Feature":
        return from_geojson(value.get("geometry"))
    if kind == "GeometryCollection":
        return kind, [from_geojson(x) for x in value.get("geometries") or []]
    c = value.get("coordinates") or []
    xy = lambda ps: _points([p[:2] for p in ps])
    if kind == "Point":
        return kind, xy([c] if c else [])
    if kind == "LineString":
        return kind, xy(c)
    if kind == "Polygon":
        return kind, [xy(r) for r in c]
    if kind == "MultiPoint":
        return kind, [("Point", xy([p])) for p in c]
    if kind == "MultiLineString":
        return kind, [("LineString", xy(p)) for p in c]
    if kind == "MultiPolygon":
        return kind, [("Polygon", [xy(r) for r in p]) for p in c]
    raise GeometryError(f"GeoJSON type {kind!r} isn't known")


def to_geojson(g: Geometry) -> dict:
    kind, parts = g
    if kind == "GeometryCollection":
        return {"type": kind, "geometries": [to_geojson(p) for p in parts]}
    if kind == "Point":
        c = parts[0].tolist() if len(parts) else []
    elif kind == "LineString":
        c = parts.tolist()
    elif kind == "Polygon":
        c = [r.tolist() for r in parts]
    else:
        c = [to_geojson(p)["coordinates"] for p in parts]
    return {"type": kind, "coordinates": c}


# --- WKT -------------------------------------------------------------------

_WKT = re.compile(r"\s*([A-Za-z]+|[(),]|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)")
_NAMES = {k.upper(): k for k in CODES}


def from_wkt(text: str) -> Geometry:
    text = re.sub(r"^\s*SRID=\d+;", "", text)
    words, at = [], 0
    while at < len(text.rstrip()):
        m = _WKT.match(text, at)
        if not m:
            raise GeometryError(f"no WKT: {text[:40]!r}")
        words.append(m[1])
        at = m.end()
    words.reverse()

    def expect(what: str) -> None:
        if not words or words.pop() != what:
            raise GeometryError(f"no WKT: {text[:40]!r}")

    def listed(item):
        if words and words[-1].upper() == "EMPTY":
            words.pop()
            return []
        expect("(")
        out = [item()]
        while words and words[-1] == ",":
            words.pop()
            out.append(item())
        expect(")")
        return out

    def point() -> list[float]:
        bare = words and words[-1] != "("
        if not bare:
            expect("(")
        n = []
        while words and words[-1] not in "(),":
            n.append(float(words.pop()))
        if not bare:
            expect(")")
        if len(n) < 2:
            raise GeometryError(f"no WKT: {text[:40]!r}")
        return n[:2]

    def geometry() -> Geometry:
        kind = _NAMES.get(words.pop().upper() if words else "")
        if not kind:
            raise GeometryError(f"no WKT: {text[:40]!r}")
        if words and words[-1].upper() in ("Z", "M", "ZM"):
            words.pop()
        line = lambda: _points(listed(point))
        if kind in ("Point", "LineString"):
            return kind, line()
        if kind == "Polygon":
            return kind, listed(line)
        item = {"MultiPoint": lambda: ("Point", _points([point()])), "MultiLineString": lambda: ("LineString", line()), "MultiPolygon": lambda: ("Polygon", listed(line)), "GeometryCollection": geometry}[kind]
        return kind, listed(item)

    g = geometry()
    if words:
        raise GeometryError(f"no WKT: {text[:40]!r}")
    return g


def box(xmin: float, ymin: float, xmax: float, ymax: float) -> Geometry:
    return "Polygon", [_points([(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)])]


def point_wkb(x: np.ndarray, y: np.ndarray) -> list[bytes | None]:
    """WKB points of coordinate columns; null where either is not finite."""
    out = np.zeros(len(x), np.dtype([("o", "u1"), ("t", "<u4"), ("x", "<f8"), ("y", "<f8")]))
    out["o"], out["t"], out["x"], out["y"] = 1, 1, x, y
    raw, good = out.tobytes(), np.isfinite(x) & np.isfinite(y)
    return [raw[i * 21 : i * 21 + 21] if ok else None for i, ok in enumerate(good)]


_STACKED = {b"\x01\x01\x00\x00\x00": ("Point", 5, 21), b"\x01\x02\x00\x00\x00": ("LineString", 9, None), b"\x01\x03\x00\x00\x00\x01\x00\x00\x00": ("Polygon", 13, None)}


def stacked(values) -> tuple[list[tuple[str, np.ndarray, np.ndarray]], np.ndarray]:
    """Little-endian 2-D points, lines and polygons of one ring as arrays: kind, places and coordinates (rows, vertices, 2) of those of one length; and the places of all others that aren't null."""
    by: dict[tuple[str, int], list[int]] = {}
    rest: list[int] = []
    for i, v in enumerate(values):
        if v is None:
            continue
        n = len(v)
        found = _STACKED.get(bytes(v[:5])) or (_STACKED.get(bytes(v[:9])) if n > 13 else None)
        if found is None or n <= found[1] or (n - found[1]) % 16 or (found[2] or n) != n or (found[2] is None and int.from_bytes(v[found[1] - 4 : found[1]], "little") * 16 != n - found[1]):
            rest.append(i)
        else:
            by.setdefault((found[0], n), []).append(i)
    out = []
    for (kind, n), places in by.items():
        head = n % 16
        raw = np.frombuffer(b"".join([values[i] for i in places]), np.uint8).reshape(len(places), n)
        xy = np.ascontiguousarray(raw[:, head:]).view("<f8").reshape(len(places), -1, 2)
        good = np.isfinite(xy).all((1, 2))
        rest += np.asarray(places)[~good].tolist()
        if good.any():
            out.append((kind, np.asarray(places)[good], xy[good]))
    return out, np.array(sorted(rest), np.int64)


def binary_buffers(array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow array of binaries, nulls empty."""
    wide = array.type in (pa.large_binary(), pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64) if len(array) else np.zeros(1, np.int64)
    data = np.frombuffer(array.buffers()[2], np.uint8) if len(array) and array.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def all_points(array) -> np.ndarray | None:
    """Coordinates of an Arrow array of little-endian 2-D points that are finite, none null; None if any is something else."""
    if array.null_count or not len(array):
        return None
    data, offsets = binary_buffers(array)
    if (np.diff(offsets) != 21).any():
        return None
    raw = data[offsets[0] : offsets[-1]].reshape(-1, 21)
    if (raw[:, :5] != np.frombuffer(b"\x01\x01\x00\x00\x00", np.uint8)).any():
        return None
    xy = np.ascontiguousarray(raw[:, 5:]).view("<f8")
    return xy if np.isfinite(xy).all() else None


def centroids(kind: str, xy: np.ndarray) -> np.ndarray:
    """``centroid`` of many geometries of one kind and length; NaN where it takes another way (no area, no length)."""
    if kind == "Point":
        return xy[:, 0].copy()
    o = xy[:, :1]
    with np.errstate(divide="ignore", invalid="ignore"):
        if kind == "LineString":
            d = np.hypot(*np.moveaxis(np.diff(xy, axis=1), 2, 0))
            return ((xy[:, :-1] + xy[:, 1:]) / 2 * d[..., None]).sum(1) / d.sum(1)[:, None]
        p = xy - o
        cross = p[:, :-1, 0] * p[:, 1:, 1] - p[:, 1:, 0] * p[:, :-1, 1]
        area = cross.sum(1) / 2
        m = ((p[:, :-1] + p[:, 1:]) * cross[..., None]).sum(1) / 6
        out = (m + o[:, 0] * area[:, None]) / area[:, None]
    # Rings that don't close, or hold no area.
    out[(xy[:, 0] != xy[:, -1]).any(1) | (area == 0) | (xy.shape[1] < 3)] = np.nan
    return out
