"""Geometry kernels in numpy: exact intersection, simplification, clipping."""

from __future__ import annotations

import numpy as np

from geoloom.geo.wkb import Geometry, atoms, bounds, box, centroid, is_empty


def boxes_meet(a, b) -> bool:
    """Closed: touching counts."""
    return a[2] >= b[0] and a[0] <= b[2] and a[3] >= b[1] and a[1] <= b[3]


def _segments(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (v[:-1], v[1:]) if len(v) > 1 else (v, v)


def _orient(a, b, c):
    return (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])


def _on(a, b, p):
    return (np.minimum(a, b) <= p).all(-1) & (p <= np.maximum(a, b)).all(-1)


def lines_meet(u: np.ndarray, v: np.ndarray) -> bool:
    """Whether two vertex chains share a point; u in blocks against all of v."""
    c, d = (x[None] for x in _segments(v))
    p, q = _segments(u)
    for i in range(0, len(p), 512):
        a, b = p[i : i + 512, None], q[i : i + 512, None]
        o1, o2, o3, o4 = _orient(a, b, c), _orient(a, b, d), _orient(c, d, a), _orient(c, d, b)
        cross = (np.sign(o1) * np.sign(o2) < 0) & (np.sign(o3) * np.sign(o4) < 0)
        touch = ((o1 == 0) & _on(a, b, c)) | ((o2 == 0) & _on(a, b, d)) | ((o3 == 0) & _on(c, d, a)) | ((o4 == 0) & _on(c, d, b))
        if (cross | touch).any():
            return True
    return False


def inside(points: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Even-odd rule over all rings; points on an edge are inside."""
    odd, edge = np.zeros(len(points), bool), np.zeros(len(points), bool)
    for r in rings:
        if len(r) < 3:
            continue
        r = r if np.array_equal(r[0], r[-1]) else np.vstack([r, r[:1]])
        a, b = r[:-1], r[1:]
        for i in range(0, len(points), 4096):
            p = points[i : i + 4096, None]
            above = (a[:, 1] > p[..., 1]) != (b[:, 1] > p[..., 1])
            with np.errstate(divide="ignore", invalid="ignore"):
                x = a[:, 0] + (p[..., 1] - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
            odd[i : i + 4096] ^= (above & (p[..., 0] < x)).sum(1) % 2 == 1
            edge[i : i + 4096] |= ((_orient(a, b, p) == 0) & _on(a, b, p)).any(1)
    return odd | edge


def _pair(p: Geometry, q: Geometry) -> bool:
    (k, u), (m, v) = p, q
    if k == "Polygon" and m != "Polygon":
        return _pair(q, p)
    if k == "Point" and m == "Point":
        return bool((u == v).all())
    if m == "Polygon":
        first = u if k != "Polygon" else np.concatenate([r[:1] for r in u])
        if inside(first[:1], v).any():
            return True
        if k == "Polygon" and inside(v[0][:1], u).any():
            return True
        chains = [u] if k != "Polygon" else u
        return any(lines_meet(c, r) for c in chains for r in v)
    return lines_meet(u, v)


def intersects(a: Geometry, b: Geometry) -> bool:
    """Whether two geometries share a point; the boundary belongs to each."""
    if is_empty(a) or is_empty(b) or not boxes_meet(bounds(a), bounds(b)):
        return False
    q = [(y, bounds(y)) for y in atoms(b) if not is_empty(y)]
    return any(boxes_meet(bx, by) and _pair(x, y) for x in atoms(a) if (bx := bounds(x)) for y, by in q)


def as_query(value) -> Geometry:
    """A query region from a box, a GeoJSON mapping, WKB, WKT or a geometry."""
    from geoloom.geo.wkb import decode, from_geojson, from_wkt

    if isinstance(value, dict):
        return from_geojson(value)
    if isinstance(value, (bytes, bytearray)):
        return decode(value)
    if isinstance(value, str):
        return from_wkt(value)
    if isinstance(value, (tuple, list)) and len(value) == 4:
        return box(*map(float, value))
    if isinstance(value, tuple) and len(value) == 2 and isinstance(value[0], str):
        return value
    raise TypeError("a region is (xmin, ymin, xmax, ymax), a GeoJSON mapping, WKB, WKT or a geometry")


def douglas_peucker(v: np.ndarray, tolerance: float) -> np.ndarray:
    if len(v) < 3:
        return v
    keep = np.zeros(len(v), bool)
    keep[[0, -1]] = True
    stack = [(0, len(v) - 1)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        a, d = v[i], v[j] - v[i]
        p = v[i + 1 : j] - a
        n = float(d @ d)
        t = np.clip(p @ d / n, 0, 1) if n else np.zeros(len(p))
        far = np.hypot(*(p - t[:, None] * d).T)
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[i + 1 + k] = True
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return v[keep]


def simplify(g: Geometry, tolerance: float) -> Geometry:
    kind, parts = g
    if kind == "LineString":
        return kind, douglas_peucker(parts, tolerance)
    if kind == "Polygon":
        # A ring that falls below a triangle stays as it was.
        return kind, [s if len(s := douglas_peucker(r, tolerance)) >= 4 else r for r in parts]
    if kind == "Point":
        return g
    return kind, [simplify(p, tolerance) for p in parts]


def _clip_ring(v: np.ndarray, axis: int, at: float, upper: bool) -> np.ndarray:
    """Sutherland-Hodgman against one side."""
    if not len(v):
        return v
    sign = -1 if upper else 1
    d = (v[:, axis] - at) * sign
    out = []
    for i in range(len(v)):
        j = i - 1
        if (d[i] >= 0) != (d[j] >= 0):
            out.append(v[j] + (v[i] - v[j]) * (d[j] / (d[j] - d[i])))
        if d[i] >= 0:
            out.append(v[i])
    return np.array(out).reshape(-1, 2)


def _clip_line(v: np.ndarray, lo: float, hi: float) -> list[np.ndarray]:
    """Liang-Barsky on every segment; pieces that follow on are joined."""
    pieces: list[list[np.ndarray]] = []
    for a, b in zip(v[:-1], v[1:]):
        d = b - a
        t0, t1 = 0.0, 1.0
        for k in (0, 1):
            for p, q in ((-d[k], a[k] - lo), (d[k], hi - a[k])):
                if p == 0:
                    if q < 0:
                        t0, t1 = 1.0, 0.0
                elif p < 0:
                    t0 = max(t0, q / p)
                else:
                    t1 = min(t1, q / p)
        if t0 > t1:
            continue
        s, e = a + t0 * d, a + t1 * d
        if pieces and np.array_equal(pieces[-1][-1], s):
            pieces[-1].append(e)
        else:
            pieces.append([s, e])
    return [np.array(p) for p in pieces]


def clip(g: Geometry, lo: float, hi: float) -> Geometry | None:
    """The part within the square [lo, hi]; None if there is none."""
    kind, parts = g
    if kind == "Point":
        return g if len(parts) and (parts >= lo).all() and (parts <= hi).all() else None
    if kind == "LineString":
        lines = _clip_line(parts, lo, hi)
        return None if not lines else ("LineString", lines[0]) if len(lines) == 1 else ("MultiLineString", [("LineString", x) for x in lines])
    if kind == "Polygon":
        rings = []
        for i, r in enumerate(parts):
            r = r[:-1] if len(r) > 1 and np.array_equal(r[0], r[-1]) else r
            for axis in (0, 1):
                r = _clip_ring(_clip_ring(r, axis, lo, False), axis, hi, True)
            if len(r) >= 3:
                rings.append(np.vstack([r, r[:1]]))
            elif i == 0:
                return None
        return "Polygon", rings
    out = []
    for p in parts:
        c = clip(p, lo, hi)
        if c is not None:
            out += c[1] if c[0].startswith("Multi") else [c]
    return (kind, out) if out else None


def tile_shapes(g: Geometry, tile: tuple[int, int, int], extent: int, buffer: int) -> list[Geometry]:
    """A geometry in metres as it is drawn in a tile (z, x, y): pixels with y up, small ones as their centroid, simplified, clipped, collections opened."""
    from geoloom.geo.mercator import map_geometry, tile_pixels

    g = map_geometry(g, lambda v: tile_pixels(v, *tile, extent))
    b = bounds(g)
    if b is None:
        return []
    point = g[0] in ("Point", "MultiPoint")
    least = 5.5 * extent / 4096
    if not point and b[2] - b[0] <= least and b[3] - b[1] <= least:
        g, point = ("Point", np.array([centroid(g)])), True
    if not point:
        from geoloom.geo.wkb import vertices

        if len(vertices(g)) > 10:
            g = simplify(g, 1.0)
        g = clip(g, -buffer, extent + buffer)
    return [] if g is None else [x for x in _opened(g) if not is_empty(x)]


def _opened(g: Geometry) -> list[Geometry]:
    return [x for p in g[1] for x in _opened(p)] if g[0] == "GeometryCollection" else [g]
