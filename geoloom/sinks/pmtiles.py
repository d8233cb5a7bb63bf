"""PMTiles v3: a writer of one archive, and a reader of single tiles."""

from __future__ import annotations

import gzip
import json
import struct
from collections.abc import Iterator
from pathlib import Path

from geoloom.geo.mvt import _read_varint, varint

CODECS = {"none": 1, "gzip": 2, "brotli": 3, "zstd": 4}
TYPES = {"mvt": 1, "png": 2, "jpeg": 3, "webp": 4, "avif": 5}
_HEADER = struct.Struct("<7sB11Q6B4iB2i")
#: Entries that the root directory has at most; more go to leaves.
ROOT = 4096


def tile_number(z: int, x: int, y: int) -> int:
    """Place of a tile on the Hilbert curves of all zooms, one after another."""
    d, s = 0, 1 << z >> 1
    a, b = x, y
    while s:
        rx, ry = int(a & s > 0), int(b & s > 0)
        d += s * s * (3 * rx ^ ry)
        if not ry:
            if rx:
                a, b = s - 1 - a & (2 * s - 1), s - 1 - b & (2 * s - 1)
            a, b = b, a
        s >>= 1
    return ((1 << 2 * z) - 1) // 3 + d


def number_tile(n: int) -> tuple[int, int, int]:
    z = 0
    while n >= 1 << 2 * z:
        n -= 1 << 2 * z
        z += 1
    x = y = 0
    s = 1
    while s < 1 << z:
        rx = n // 2 & 1
        ry = (n ^ rx) & 1
        if not ry:
            if rx:
                x, y = s - 1 - x, s - 1 - y
            x, y = y, x
        x, y = x + s * rx, y + s * ry
        n //= 4
        s *= 2
    return z, x, y


def compress(data: bytes, codec: str) -> bytes:
    if codec == "gzip":
        return gzip.compress(data, mtime=0)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdCompressor().compress(data)
    if codec == "brotli":
        raise ValueError("there is no brotli codec here; use gzip, zstd or none")
    return data


def decompress(data: bytes, codec: int) -> bytes:
    if codec == CODECS["gzip"]:
        return gzip.decompress(data)
    if codec == CODECS["zstd"]:
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if codec == CODECS["brotli"]:
        raise ValueError("there is no brotli codec here")
    return data


Entry = tuple[int, int, int, int]


def _directory(entries: list[Entry]) -> bytes:
    """Entries of (tile number, offset, length, run), column by column, gzipped."""
    out, last = [varint(len(entries))], 0
    for e in entries:
        out.append(varint(e[0] - last))
        last = e[0]
    out += [varint(e[3]) for e in entries] + [varint(e[2]) for e in entries]
    for i, e in enumerate(entries):
        follows = i and e[1] == entries[i - 1][1] + entries[i - 1][2]
        out.append(varint(0 if follows else e[1] + 1))
    return gzip.compress(b"".join(out), mtime=0)


def _entries(data: bytes) -> list[Entry]:
    data = gzip.decompress(data)
    n, at = _read_varint(data, 0)
    columns = []
    for _ in range(4):
        column = []
        for _ in range(n):
            v, at = _read_varint(data, at)
            column.append(v)
        columns.append(column)
    number, out = 0, []
    for i in range(n):
        number += columns[0][i]
        offset = out[-1][1] + out[-1][2] if not columns[3][i] and i else columns[3][i] - 1
        out.append((number, offset, columns[2][i], columns[1][i]))
    return out


def write(path: str | Path, tiles: Iterator[tuple[int, int, int, bytes]], codec: str = "gzip", tile_type: str = "mvt", bounds: tuple[float, float, float, float] = (-180.0, -85.051129, 180.0, 85.051129), metadata: dict | None = None) -> int:
    """One archive of ``tiles``, which come in the order of ``tile_number``. Equal tiles are kept once."""
    codec = codec if codec in CODECS else "gzip"
    path = Path(path)
    body = path.with_name(path.name + ".part")
    entries: list[Entry] = []
    known: dict[bytes, tuple[int, int]] = {}
    offset = n = 0
    low, high = 99, 0
    with body.open("wb") as f:
        for z, x, y, data in tiles:
            number, packed = tile_number(z, x, y), compress(data, codec)
            place = known.get(packed) if len(packed) < 4096 else None
            if place is None:
                place = (offset, len(packed))
                f.write(packed)
                offset += len(packed)
                if len(packed) < 4096 and len(known) < 100_000:
                    known[packed] = place
            if entries and entries[-1][1:3] == place and entries[-1][0] + entries[-1][3] == number:
                entries[-1] = (*entries[-1][:3], entries[-1][3] + 1)
            else:
                entries.append((number, *place, 1))
            n, low, high = n + 1, min(low, z), max(high, z)
    if not n:
        body.unlink()
        raise ValueError("there are no tiles to export")
    leaves = b""
    root = entries
    if len(entries) > ROOT:
        root, step = [], max(ROOT, -(-len(entries) // ROOT))
        for i in range(0, len(entries), step):
            leaf = _directory(entries[i : i + step])
            root.append((entries[i][0], len(leaves), len(leaf), 0))
            leaves += leaf
    root_bytes, meta = _directory(root), gzip.compress(json.dumps(metadata or {}).encode(), mtime=0)
    at_root = _HEADER.size
    at_meta = at_root + len(root_bytes)
    at_leaves = at_meta + len(meta)
    at_data = at_leaves + len(leaves)
    e7 = [round(v * 1e7) for v in bounds]
    center = [round((bounds[0] + bounds[2]) / 2 * 1e7), round((bounds[1] + bounds[3]) / 2 * 1e7)]
    header = _HEADER.pack(b"PMTiles", 3, at_root, len(root_bytes), at_meta, len(meta), at_leaves, len(leaves), at_data, offset, n, len(entries), len({e[1] for e in entries}), 1, CODECS["gzip"], CODECS[codec], TYPES.get(tile_type, 0), low, high, *e7, low, *center)
    with path.open("wb") as f:
        f.write(header + root_bytes + meta + leaves)
        with body.open("rb") as g:
            while chunk := g.read(1 << 24):
                f.write(chunk)
    body.unlink()
    return n


class Reader:
    """Tiles of an archive by z, x, y."""

    def __init__(self, path: str | Path) -> None:
        self.path = Path(path)
        with self.path.open("rb") as f:
            h = _HEADER.unpack(f.read(_HEADER.size))
            if h[0] != b"PMTiles" or h[1] != 3:
                raise ValueError(f"{path} is no PMTiles v3 archive")
            (self.at_root, self.n_root, self.at_meta, self.n_meta, self.at_leaves, _, self.at_data) = h[2:9]
            self.codec, self.min_zoom, self.max_zoom = h[15], h[17], h[18]
            f.seek(self.at_root)
            self.root = _entries(f.read(self.n_root))

    def _read(self, at: int, n: int) -> bytes:
        with self.path.open("rb") as f:
            f.seek(at)
            return f.read(n)

    def metadata(self) -> dict:
        return json.loads(gzip.decompress(self._read(self.at_meta, self.n_meta)))

    def tile(self, z: int, x: int, y: int) -> bytes | None:
        number, entries = tile_number(z, x, y), self.root
        while True:
            before = [e for e in entries if e[0] <= number]
            if not before:
                return None
            e = before[-1]
            if e[3]:
                return decompress(self._read(self.at_data + e[1], e[2]), self.codec) if number < e[0] + e[3] else None
            entries = _entries(self._read(self.at_leaves + e[1], e[2]))

    def tiles(self, entries: list[Entry] | None = None) -> Iterator[tuple[int, int, int]]:
        """z, x, y of all tiles."""
        for e in self.root if entries is None else entries:
            if e[3]:
                yield from (number_tile(e[0] + i) for i in range(e[3]))
            else:
                yield from self.tiles(_entries(self._read(self.at_leaves + e[1], e[2])))


def discover(root: str | Path) -> Path | None:
    """The archive of a dataset: tiles.pmtiles, or one named after it beside or in it."""
    root = Path(root)
    return next((p for p in (root / "tiles.pmtiles", root.with_name(root.name + ".pmtiles"), root / f"{root.name}.pmtiles") if p.is_file()), None)


def export(mvt_dir: str | Path, output_path: str | Path, tile_type: str = "mvt", compression: str = "gzip", bounds=None) -> int:
    """All z/x/y.mvt files of a folder as one archive."""
    found = []
    for p in Path(mvt_dir).glob("*/*/*.mvt"):
        z, x, y = int(p.parts[-3]), int(p.parts[-2]), int(p.stem)
        found.append((tile_number(z, x, y), z, x, y, p))
    found.sort()
    return write(output_path, ((z, x, y, p.read_bytes()) for _, z, x, y, p in found), compression, tile_type, **({"bounds": bounds} if bounds else {}))
