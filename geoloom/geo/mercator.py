"""Web Mercator and tile arithmetic, as Column expressions and as numpy twins.

Everything here is plain arithmetic: it stays in whole-stage codegen, and filters on
it reach the scan. Columns take Columns or numbers.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

R = 6378137.0
WORLD = 20037508.342789244
MAX_LAT = 85.05112877980659
DEGREES, METRES = 4326, 3857


class UnsupportedCrsError(ValueError):
    """A coordinate system other than EPSG:4326, EPSG:3857 and the UTM zones."""


#: UTM by EPSG code: first zone's code, last, whether in the south, inverse flattening (WGS 84 or GRS 80).
_UTM = ((32601, 32660, False, 298.257223563), (32701, 32760, True, 298.257223563), (25828, 25838, False, 298.257222101), (26901, 26923, False, 298.257222101))


def utm_zone(code: int) -> tuple[int, bool, float] | None:
    """Zone, whether it is southern, and inverse flattening of a UTM code."""
    for first, last, south, flat in _UTM:
        if first <= code <= last:
            return code - first + (28 if first == 25828 else 1), south, flat
    return None


def epsg(crs: object) -> int:
    """The code of 4326, 3857 or a UTM zone, from a code, a name or PROJJSON; None means 4326."""
    if crs is None:
        return DEGREES
    if isinstance(crs, dict):
        crs = (crs.get("id") or {}).get("code") or crs.get("name") or ""
    text = str(crs).upper()
    if text in ("4326", "EPSG:4326", "OGC:CRS84", "CRS84", "WGS84", "WGS 84", "WGS 84 (CRS84)") or text.endswith(("CRS84", "EPSG::4326")):
        return DEGREES
    if text in ("3857", "EPSG:3857", "900913", "EPSG:900913", "WGS 84 / PSEUDO-MERCATOR") or text.endswith("EPSG::3857"):
        return METRES
    number = re.search(r"(?:^|EPSG:+)(\d{5})$", text)
    if number and utm_zone(int(number[1])):
        return int(number[1])
    zone = re.fullmatch(r"WGS[ _]?(?:19)?84 ?[/_] ?UTM[ _]ZONE[ _](\d{1,2})([NS])", text)
    if zone and 1 <= int(zone[1]) <= 60:
        return (32600 if zone[2] == "N" else 32700) + int(zone[1])
    raise UnsupportedCrsError(f"coordinate system {crs!r}: only EPSG:4326, EPSG:3857 and UTM zones are known here")


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


# --- Columns ---------------------------------------------------------------


def x_of_lon(lon) -> Column:
    return _c(lon) * F.lit(WORLD) / F.lit(180.0)


def y_of_lat(lat) -> Column:
    return F.lit(R) * F.log(F.tan(F.lit(math.pi) / F.lit(4.0) + F.radians(_c(lat)) / F.lit(2.0)))


def lon_of_x(x) -> Column:
    return _c(x) / F.lit(WORLD) * F.lit(180.0)


def lat_of_y(y) -> Column:
    return F.degrees(F.lit(2.0) * F.atan(F.exp(_c(y) / F.lit(R))) - F.lit(math.pi / 2))


def cell(v, n) -> Column:
    """Number of the cell of n along one axis, clamped to the world's edge cells."""
    n = _c(n)
    return F.least(F.greatest(F.floor((_c(v) + F.lit(WORLD)) / F.lit(2 * WORLD) * n).cast("double"), F.lit(0.0)), n - F.lit(1.0)).cast("long")


def tile_x(x, z) -> Column:
    return cell(x, F.pow(F.lit(2.0), _c(z)))


def tile_y(y, z) -> Column:
    """Rows count from the north."""
    n = F.pow(F.lit(2.0), _c(z))
    return F.least(F.greatest(F.floor((F.lit(WORLD) - _c(y)) / F.lit(2 * WORLD) * n).cast("double"), F.lit(0.0)), n - F.lit(1.0)).cast("long")


def tile_id(z, x, y) -> Column:
    """z, x, y packed into one long: 6, 29 and 29 bits."""
    return F.shiftleft(_c(z).cast("long"), 58).bitwiseOR(F.shiftleft(_c(x).cast("long"), 29)).bitwiseOR(_c(y).cast("long"))


def tile_of_id(tile: Column) -> tuple[Column, Column, Column]:
    mask = F.lit((1 << 29) - 1)
    return F.shiftrightunsigned(tile, 58), F.shiftrightunsigned(tile, 29).bitwiseAND(mask), tile.bitwiseAND(mask)


def tile_bounds_columns(z, x, y) -> tuple[Column, Column, Column, Column]:
    size = F.lit(2 * WORLD) / F.pow(F.lit(2.0), _c(z))
    return _c(x) * size - WORLD, F.lit(WORLD) - (_c(y) + 1) * size, (_c(x) + 1) * size - WORLD, F.lit(WORLD) - _c(y) * size


def morton(x: Column, y: Column, bits: int) -> Column:
    """Z-order key: x in the even bits, y in the odd ones."""
    key = F.lit(0).cast("long")
    for i in range(bits):
        key = key.bitwiseOR(F.shiftleft(F.shiftright(x.cast("long"), i).bitwiseAND(F.lit(1)), 2 * i))
        key = key.bitwiseOR(F.shiftleft(F.shiftright(y.cast("long"), i).bitwiseAND(F.lit(1)), 2 * i + 1))
    return key


def scaled(v: Column, low, high, bits: int) -> Column:
    """v between low and high as an integer of so many bits, rounded and clamped."""
    top = float((1 << bits) - 1)
    share = F.when(_c(high) > _c(low), (v - _c(low)) / (_c(high) - _c(low))).otherwise(F.lit(0.0))
    return F.least(F.greatest(F.round(share * F.lit(top)), F.lit(0.0)), F.lit(top)).cast("long")


# --- numpy -----------------------------------------------------------------


def forward(v: np.ndarray) -> np.ndarray:
    """Degrees to metres; latitudes beyond the square world are clamped to its edge's far reach by the logarithm."""
    with np.errstate(divide="ignore", invalid="ignore"):
        lat = np.clip(v[:, 1], -89.999999, 89.999999)
        return np.column_stack([v[:, 0] * WORLD / 180, R * np.log(np.tan(math.pi / 4 + np.radians(lat) / 2))])


def backward(v: np.ndarray) -> np.ndarray:
    return np.column_stack([v[:, 0] / WORLD * 180, np.degrees(2 * np.arctan(np.exp(v[:, 1] / R)) - math.pi / 2)])


def _krueger(flat: float) -> tuple[float, float, list[float], list[float]]:
    """Eccentricity, rectifying radius and series of the transverse Mercator projection (Krueger's, to the fourth order of n)."""
    f = 1 / flat
    n = f / (2 - f)
    a = R / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    there = [n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4, 13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4, 61 / 240 * n**3 - 103 / 140 * n**4, 49561 / 161280 * n**4]
    back = [n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3 - 1 / 360 * n**4, n**2 / 48 + n**3 / 15 - 437 / 1440 * n**4, 17 / 480 * n**3 - 37 / 840 * n**4, 4397 / 161280 * n**4]
    return math.sqrt(f * (2 - f)), a, there, back


def to_utm(v: np.ndarray, code: int) -> np.ndarray:
    zone, south, flat = utm_zone(code)
    e, a, series, _ = _krueger(flat)
    lat, d = np.radians(v[:, 1]), np.radians(v[:, 0] - (6 * zone - 183))
    t = np.sinh(np.arctanh(np.sin(lat)) - e * np.arctanh(e * np.sin(lat)))
    xi, eta = np.arctan2(t, np.cos(d)), np.arcsinh(np.sin(d) / np.hypot(t, np.cos(d)))
    x, y = eta.copy(), xi.copy()
    for j, c in enumerate(series, 1):
        x += c * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        y += c * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
    return np.column_stack([500_000 + 0.9996 * a * x, (10_000_000 if south else 0) + 0.9996 * a * y])


def from_utm(v: np.ndarray, code: int) -> np.ndarray:
    zone, south, flat = utm_zone(code)
    e, a, _, series = _krueger(flat)
    eta0, xi0 = (v[:, 0] - 500_000) / (0.9996 * a), (v[:, 1] - (10_000_000 if south else 0)) / (0.9996 * a)
    xi, eta = xi0.copy(), eta0.copy()
    for j, c in enumerate(series, 1):
        xi -= c * np.sin(2 * j * xi0) * np.cosh(2 * j * eta0)
        eta -= c * np.cos(2 * j * xi0) * np.sinh(2 * j * eta0)
    goal = np.sin(xi) / np.hypot(np.sinh(eta), np.cos(xi))
    tau = goal.copy()
    for _ in range(4):
        # Newton's method for the latitude of a conformal one.
        s = np.sinh(e * np.arctanh(e * tau / np.hypot(1, tau)))
        now = tau * np.hypot(1, s) - s * np.hypot(1, tau)
        tau += (goal - now) / np.hypot(1, now) * (1 + (1 - e * e) * tau**2) / ((1 - e * e) * np.hypot(1, tau))
    return np.column_stack([6 * zone - 183 + np.degrees(np.arctan2(np.sinh(eta), np.cos(xi))), np.degrees(np.arctan(tau))])


def transform(v: np.ndarray, source: object, target: object) -> np.ndarray:
    """Between any two of the known systems, by way of degrees."""
    a, b = epsg(source), epsg(target)
    if a == b:
        return v
    degrees = v if a == DEGREES else backward(v) if a == METRES else from_utm(v, a)
    return degrees if b == DEGREES else forward(degrees) if b == METRES else to_utm(degrees, b)


def transform_box(box: tuple[float, float, float, float], source: object, target: object) -> tuple[float, float, float, float]:
    """Degrees and Mercator are monotone along each axis, so two corners suffice; of a UTM box 21 points of each side are taken."""
    if epsg(source) != epsg(target) and {epsg(source), epsg(target)} - {DEGREES, METRES}:
        s = np.linspace(0, 1, 21)
        x, y = box[0] + (box[2] - box[0]) * s, box[1] + (box[3] - box[1]) * s
        edge = np.concatenate([np.column_stack([x, np.full(21, b)]) for b in (box[1], box[3])] + [np.column_stack([np.full(21, a), y]) for a in (box[0], box[2])])
        v = transform(edge, source, target)
        return (*v.min(0).tolist(), *v.max(0).tolist())
    return tuple(transform(np.array(box, np.float64).reshape(2, 2), source, target).ravel().tolist())


def map_geometry(g, f):
    """``f`` on every coordinate array of a geometry."""
    kind, parts = g
    if kind in ("Point", "LineString"):
        return kind, f(parts) if len(parts) else parts
    return kind, [f(p) if kind == "Polygon" else map_geometry(p, f) for p in parts]


def tile_bounds(z: int, x: int, y: int) -> tuple[float, float, float, float]:
    size = 2 * WORLD / (1 << z)
    return x * size - WORLD, WORLD - (y + 1) * size, (x + 1) * size - WORLD, WORLD - y * size


def tile_pixels(v: np.ndarray, z: int, x: int, y: int, extent: int) -> np.ndarray:
    """Coordinates in metres as pixels of a tile, with y up: by their share of the world's side, so that the tile's corner isn't rounded first."""
    n = 1 << z
    return ((v + WORLD) / (2 * WORLD) * n - np.array([x, n - 1 - y])) * float(extent)


def tile_range(z: int, box: tuple[float, float, float, float]) -> tuple[int, int, int, int]:
    """First and last column and row of the tiles that a box in metres meets, clamped."""
    n = 1 << z
    at = lambda v: int(min(max(math.floor(v / (2 * WORLD) * n), 0), n - 1))
    return at(box[0] + WORLD), at(WORLD - box[3]), at(box[2] + WORLD), at(WORLD - box[1])


def encode_tile(z: int, x: int, y: int) -> int:
    return z << 58 | x << 29 | y


def decode_tile(tile: int) -> tuple[int, int, int]:
    return tile >> 58, tile >> 29 & (1 << 29) - 1, tile & (1 << 29) - 1


def buffered(box: tuple[float, float, float, float], share: float) -> tuple[float, float, float, float]:
    """A box grown by a share of its sides, within the world."""
    dx, dy = (box[2] - box[0]) * share, (box[3] - box[1]) * share
    return max(box[0] - dx, -WORLD), max(box[1] - dy, -WORLD), min(box[2] + dx, WORLD), min(box[3] + dy, WORLD)
