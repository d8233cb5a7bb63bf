"""Vectorised tokenisation: numpy passes over the UTF-8 buffer of an Arrow column.

No Python object is made per token. A token is a maximal run of bytes of one
class; its hash is a 64-bit mix of a position-weighted byte sum. Every byte of
0x80 and above counts as part of a word, so letters of any script do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
GROUP_BYTES = 1 << 20

_SPACE = b" \t\n\r\x0b\x0c"
#: Bytes of ASCII-whitespace-separated words.
NONSPACE = np.array([b not in _SPACE for b in range(256)])
#: Bytes of lower-cased alphanumeric words (Python: ``[0-9a-z_]`` or not ASCII).
WORD = np.array([b >= 0x80 or chr(b).isalnum() or b == 0x5F for b in range(256)])

_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=U64) | U64(1)
_BASE = U64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64 finaliser of ``h`` offset by ``seed``."""
    with np.errstate(over="ignore"):
        z = h.astype(U64) + U64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
        z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
        return z ^ (z >> U64(31))


_powers = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    """``_BASE ** i`` modulo 2**64 for i < n."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 4096), _BASE, U64)
        grown[0] = 1
        _powers = np.cumprod(grown, dtype=U64)
    return _powers[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and len+1 offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, size: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi
        lo = hi


class Tokens:
    """Tokens of some rows: ``hash``, byte ``start`` and ``end``, and per row ``first`` (len rows+1)."""

    __slots__ = ("hash", "start", "end", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> None:
        hashes, starts, ends = [], [], []
        at, n = 0, len(data)
        while at < n:
            stop = min(n, at + 4 * GROUP_BYTES)
            while stop < n and table[data[stop - 1]] and table[data[stop]]:
                # Never cut a token: look for its end in growing steps.
                ahead = np.flatnonzero(~table[data[stop : stop + GROUP_BYTES]])
                stop = stop + int(ahead[0]) if len(ahead) else min(n, stop + GROUP_BYTES)
            lo, hi = np.searchsorted(offsets, [at, stop])
            h, s, e = _piece(data[at:stop], offsets[lo:hi] - at, table)
            hashes.append(h)
            starts.append(s + at)
            ends.append(e + at)
            at = stop
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        self.start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, offsets)


def _piece(data: np.ndarray, row_starts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = table[data]
    row_starts = row_starts[row_starts < len(data)]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[row_starts] |= inside[row_starts]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    before = row_starts[row_starts > 0] - 1
    stops[before] |= inside[before]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    if not len(start):
        return np.zeros(0, U64), start, end
    length = end - start
    first = np.cumsum(length) - length
    position = np.arange(first[-1] + length[-1]) - np.repeat(first, length)
    with np.errstate(over="ignore"):
        value = _BYTE_VALUE[data[inside]] * powers(int(length.max()))[position]
        return mix(np.add.reduceat(value, first) + length.astype(U64)), start, end


class Lookup:
    """Numbers of hashes in a sorted array; a table of bits spares most hashes the search."""

    def __init__(self, known: np.ndarray, bits: int = 20) -> None:
        self.known, self.mask = known, U64((1 << bits) - 1)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[known & self.mask] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` that are known, and their numbers."""
        place = np.flatnonzero(self.maybe[hashes & self.mask])
        number = np.searchsorted(self.known, hashes[place])
        number[number == len(self.known)] = 0
        good = self.known[number] == hashes[place] if len(self.known) else np.zeros(0, bool)
        return place[good], number[good]


class Buckets:
    """The same for large arrays of which most hashes are found: a table has where the first bits of a hash begin."""

    #: Numbers that are tried one after the other; a search finds what is still further.
    STEPS = 8

    def __init__(self, known: np.ndarray) -> None:
        bits = max(1, len(known).bit_length())
        self.known, self.shift = known, U64(64 - bits)
        self.start = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount((known >> self.shift).astype(np.int64), minlength=1 << bits), out=self.start[1:])

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` that are known, and their numbers."""
        if not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        last = len(self.known) - 1
        number = np.minimum(self.start[(hashes >> self.shift).astype(np.int64)], last)
        less = np.flatnonzero(self.known[number] < hashes)
        for _ in range(self.STEPS):
            less = less[number[less] < last]
            number[less] += 1
            less = less[self.known[number[less]] < hashes[less]]
        number[less] = np.minimum(np.searchsorted(self.known, hashes[less]), last)
        place = np.flatnonzero(self.known[number] == hashes)
        return place, number[place].astype(np.int64)


def ngrams(tokens: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that start at each token, and whether they end within their row."""
    h, total = tokens.hash, len(tokens.hash)
    out = np.zeros(total, U64)
    valid = np.zeros(total, bool)
    if total >= n:
        with np.errstate(over="ignore"):
            m = total - n + 1
            out[:m] = h[:m]
            for j in range(1, n):
                out[:m] = out[:m] * _BASE + h[j : j + m]
            out[:m] = mix(out[:m], n)
        row_end = np.repeat(tokens.first[1:], np.diff(tokens.first))
        valid = np.arange(total) + n <= row_end
    return out, valid


def rows_of(tokens: Tokens) -> np.ndarray:
    """Row number of every token."""
    return np.repeat(np.arange(len(tokens.first) - 1), np.diff(tokens.first))


def token_hashes(text: str, table: np.ndarray = WORD) -> np.ndarray:
    """Token hashes of one lower-cased text, as ``Tokens`` gives them."""
    data = np.frombuffer(text.encode(), np.uint8)
    return Tokens(data, np.array([0, len(data)]), table).hash
