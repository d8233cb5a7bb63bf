"""Mapbox Vector Tile 2.1: a protobuf writer, and a reader for tests and for tile counts."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

from geoloom.geo.wkb import Geometry

MOVE, LINE, CLOSE = 1, 2, 7


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def _field(number: int, payload: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(payload)) + payload


def _packed(number: int, values: list[int]) -> bytes:
    return _field(number, b"".join(map(varint, values)))


def _value(v) -> bytes:
    if isinstance(v, (bool, np.bool_)):
        return varint(7 << 3) + varint(int(v))
    if isinstance(v, (int, np.integer)):
        v = int(v)
        return varint(4 << 3) + varint(v) if v >= 0 else varint(6 << 3) + varint(zigzag(v))
    if isinstance(v, (float, np.floating)):
        return varint(3 << 3 | 1) + struct.pack("<d", float(v))
    return _field(1, str(v).encode())


class _Pen:
    def __init__(self) -> None:
        self.at, self.out = (0, 0), []

    def draw(self, command: int, points: list[tuple[int, int]]) -> None:
        self.out.append(len(points) << 3 | command)
        for x, y in points:
            self.out += [zigzag(x - self.at[0]), zigzag(y - self.at[1])]
            self.at = (x, y)


def _pixels(v: np.ndarray, extent: int) -> list[tuple[int, int]]:
    """Whole pixels with y down; points that fall together are one."""
    p = np.column_stack([np.rint(v[:, 0]), np.rint(extent - v[:, 1])]).astype(np.int64).tolist()
    return [tuple(a) for i, a in enumerate(p) if i == 0 or a != p[i - 1]]


def _area(ring: list[tuple[int, int]]) -> int:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))


def commands(g: Geometry, extent: int) -> tuple[int, list[int]] | None:
    """Geometry type and commands; None if nothing is left on the pixel grid."""
    kind, parts = g
    pen = _Pen()
    single = [g] if not kind.startswith("Multi") else parts
    base = kind.removeprefix("Multi")
    if base == "Point":
        points = [_pixels(p[1], extent)[0] for p in single if len(p[1])]
        if not points:
            return None
        pen.draw(MOVE, points)
        return 1, pen.out
    if base == "LineString":
        for p in single:
            line = _pixels(p[1], extent)
            if len(line) > 1:
                pen.draw(MOVE, line[:1])
                pen.draw(LINE, line[1:])
        return (2, pen.out) if pen.out else None
    for p in single:
        for i, r in enumerate(p[1]):
            ring = _pixels(r, extent)
            if len(ring) > 1 and ring[0] == ring[-1]:
                ring = ring[:-1]
            turn = _area(ring) if len(ring) > 2 else 0
            if not turn:
                if i == 0:
                    break
                continue
            # With y down an outer ring has positive area, a hole negative.
            if (turn > 0) != (i == 0):
                ring.reverse()
            pen.draw(MOVE, ring[:1])
            pen.draw(LINE, ring[1:])
            pen.out.append(1 << 3 | CLOSE)
    return (3, pen.out) if pen.out else None


#: Distinct values of a tile that are kept once; a value beyond them is written wherever it is, so that memory is bounded.
KNOWN = 1 << 18


def varints(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of many unsigned varints, and each one's length."""
    v = numbers.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1 << 7 * k)
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(v) else 0, np.uint8)
    at = end - size
    left = np.arange(len(v))
    for k in range(10):
        left = left[size[left] > k]
        if not len(left):
            break
        out[at[left] + k] = (v[left] >> np.uint64(7 * k) & np.uint64(0x7F)).astype(np.uint8) | ((size[left] > k + 1).astype(np.uint8) << 7)
    return out, size


class Layer:
    """A layer written feature by feature, or many points at once. What is held is its bytes, and ``KNOWN`` values at most."""

    def __init__(self, name: str = "layer0", extent: int = 4096) -> None:
        self.name, self.extent, self.n_drawn = name, extent, 0
        self.keys: dict[str, int] = {}
        self.values: dict[tuple, int] = {}
        self.n_values = 0
        self.blobs, self.encoded = bytearray(), bytearray()

    def _place(self, v) -> int:
        key = (type(v).__name__, v if isinstance(v, (str, bool, int, float)) else str(v))
        found = self.values.get(key)
        if found is None:
            found = self.n_values
            self.n_values += 1
            if len(self.values) < KNOWN:
                self.values[key] = found
            self.encoded += _field(4, _value(v))
        return found

    def add(self, g: Geometry, properties: dict) -> None:
        drawn = commands(g, self.extent)
        if drawn is None:
            return
        tags = []
        for k, v in properties.items():
            if v is not None:
                value = self._place(v)
                tags += [self.keys.setdefault(str(k), len(self.keys)), value]
        self.blobs += _field(2, (_packed(2, tags) if tags else b"") + varint(3 << 3) + varint(drawn[0]) + _packed(4, drawn[1]))
        self.n_drawn += 1

    def add_points(self, pixels: np.ndarray, columns: list[tuple[str, pa.Array]]) -> None:
        """Points in pixels with y up, and columns of their properties: the same bytes as one by one."""
        n, m = len(pixels), len(columns)
        if not n:
            return
        keyed, there = np.zeros((n, m), np.int64), np.zeros((n, m), bool)
        first: list[tuple[int, int]] = []
        fresh: list[tuple[int, int, int, object]] = []
        codes: list[tuple[np.ndarray, np.ndarray]] = []
        for j, (name, column) in enumerate(columns):
            d = column.dictionary_encode()
            ok = ~np.asarray(d.indices.is_null())
            code = np.asarray(d.indices.fill_null(0)).astype(np.int64)
            there[:, j] = ok
            at = np.flatnonzero(ok)
            if len(at):
                first.append((int(at[0]), j))
            seen, begin = np.unique(code[ok], return_index=True)
            held = d.dictionary.to_pylist()
            place = np.full(max(1, len(held)), -1, np.int64)
            for c, i in zip(seen.tolist(), at[begin].tolist()):
                v = held[c]
                known = self.values.get((type(v).__name__, v))
                if known is None:
                    fresh.append((i, j, c, v))
                else:
                    place[c] = known
            codes.append((code, place))
        fresh.sort(key=lambda x: x[:2])
        for _, j, c, v in fresh:
            codes[j][1][c] = self._place(v)
        for _, j in sorted(first):
            self.keys.setdefault(str(columns[j][0]), len(self.keys))
        for j, (code, place) in enumerate(codes):
            keyed[:, j] = place[code]
        p = np.column_stack([np.rint(pixels[:, 0]), np.rint(self.extent - pixels[:, 1])]).astype(np.int64)
        drawn = np.where(p >= 0, p << 1, (-p << 1) - 1)
        # Every number of a feature is a varint, lengths and field numbers too: a row of them for each feature.
        names = np.array([self.keys.get(str(name), 0) for name, _ in columns], np.int64)
        tag = np.empty((n, 2 * m), np.int64)
        tag[:, ::2], tag[:, 1::2] = names, keyed
        tagged = np.repeat(there, 2, axis=1)
        width = lambda v: 1 + sum((v >= 1 << 7 * k).astype(np.int64) for k in range(1, 9))
        n_tags = (width(tag) * tagged).sum(1)
        some = n_tags > 0
        n_drawn = 1 + width(drawn).sum(1)
        whole = np.where(some, 1 + width(n_tags) + n_tags, 0) + 2 + 1 + width(n_drawn) + n_drawn
        numbers = np.column_stack([np.full(n, 2 << 3 | 2), whole, np.full(n, 2 << 3 | 2), n_tags, tag, np.full(n, 3 << 3), np.ones(n, np.int64), np.full(n, 4 << 3 | 2), n_drawn, np.full(n, 1 << 3 | MOVE), drawn])
        kept = np.ones(numbers.shape, bool)
        kept[:, 2] = kept[:, 3] = some
        kept[:, 4 : 4 + 2 * m] = tagged
        self.blobs += varints(numbers[kept])[0].tobytes()
        self.n_drawn += n

    def bytes(self) -> bytes:
        head = _field(1, self.name.encode())
        tail = b"".join(_field(3, k.encode()) for k in self.keys)
        end = varint(5 << 3) + varint(self.extent) + varint(15 << 3) + varint(2)
        return b"".join([varint(3 << 3 | 2), varint(len(head) + len(self.blobs) + len(tail) + len(self.encoded) + len(end)), head, self.blobs, tail, self.encoded, end])


def encode(features: list[tuple[Geometry, dict]], layer: str = "layer0", extent: int = 4096) -> bytes:
    """A tile of one layer; geometries in pixels with y up. Null properties are left out."""
    out = Layer(layer, extent)
    for g, properties in features:
        out.add(g, properties)
    return out.bytes()


# --- Reading ---------------------------------------------------------------


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (b[at] & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b[at - 1] < 0x80:
            return n, at


def _fields(b: bytes, at: int = 0, end: int | None = None, spans: bool = False):
    """Field number and value; with ``spans`` what has a length is given as its place, not copied."""
    end = len(b) if end is None else end
    while at < end:
        key, at = _read_varint(b, at)
        if key & 7 == 0:
            v, at = _read_varint(b, at)
        elif key & 7 == 1:
            v, at = struct.unpack_from("<d", b, at)[0], at + 8
        elif key & 7 == 5:
            v, at = struct.unpack_from("<f", b, at)[0], at + 4
        else:
            n, at = _read_varint(b, at)
            v, at = (at, at + n) if spans else b[at : at + n], at + n
        yield key >> 3, v


def _numbers(b: bytes) -> list[int]:
    out, at = [], 0
    while at < len(b):
        v, at = _read_varint(b, at)
        out.append(v)
    return out


def _unzigzag(n: int) -> int:
    return n >> 1 ^ -(n & 1)


def count_features(tile: bytes) -> int:
    """Features of all layers, without decoding any."""
    return sum(1 for number, layer in _fields(tile, spans=True) if number == 3 for n, _ in _fields(tile, *layer, spans=True) if n == 2)


def _feature(f: bytes, keys: list, values: list) -> dict:
    tags, kind, geometry = [], 0, []
    for n, v in _fields(f):
        if n == 2:
            tags = _numbers(v)
        elif n == 3:
            kind = v
        elif n == 4:
            geometry = _numbers(v)
    parts, x, y, i = [], 0, 0, 0
    while i < len(geometry):
        command, count = geometry[i] & 7, geometry[i] >> 3
        i += 1
        if command == CLOSE:
            parts[-1].append(parts[-1][0])
            continue
        for _ in range(count):
            x, y, i = x + _unzigzag(geometry[i]), y + _unzigzag(geometry[i + 1]), i + 2
            if command == MOVE:
                parts.append([])
            parts[-1].append((x, y))
    return {"type": {1: "Point", 2: "LineString", 3: "Polygon"}[kind], "parts": parts, "properties": {keys[tags[j]]: values[tags[j + 1]] for j in range(0, len(tags), 2)}}


def layers(tile: bytes):
    """Name, extent and an iterator of the features of each layer; features are decoded one at a time."""
    for number, span in _fields(tile, spans=True):
        if number != 3:
            continue
        name, extent, keys, values = "", 4096, [], []
        for n, v in _fields(tile, *span, spans=True):
            if n == 1:
                name = tile[slice(*v)].decode()
            elif n == 3:
                keys.append(tile[slice(*v)].decode())
            elif n == 4:
                k, x = next(_fields(tile, *v))
                values.append(x.decode() if k == 1 else bool(x) if k == 7 else _unzigzag(x) if k == 6 else x)
            elif n == 5:
                extent = v
        yield name, extent, (_feature(tile[slice(*v)], keys, values) for n, v in _fields(tile, *span, spans=True) if n == 2)


def decode(tile: bytes) -> dict[str, dict]:
    """Layers with extent and features (type, parts in pixels with y down, properties)."""
    return {name: {"extent": extent, "features": list(found)} for name, extent, found in layers(tile)}
