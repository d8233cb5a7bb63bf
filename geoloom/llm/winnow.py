"""Document fingerprints by winnowing.

Rolling hashes of all k-grams of a document's letters and digits; of every window
of w consecutive hashes the least is chosen, the rightmost of equals, and kept
with its position. Two documents that share k + w - 1 letters and digits in a row
share a fingerprint within them.

Defined results
  * Text is lower-cased and all but letters and digits left out; ``pos`` is the
    number of the k-gram's first letter in what remains.
  * Fewer than k letters and digits (null and empty text too) give no fingerprint;
    fewer than k + w - 1 give one, of the single window of all their k-grams.
  * A null doc_id passes through; repeated rows give repeated fingerprints.
  * The hash is the polynomial of the code points modulo 2**31 - 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from geoloom.llm.common import documents, read
from geoloom.llm.tokens import groups, utf8

K, WINDOW = 30, 71
PRIME, BASE = 2**31 - 1, 1_000_003

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter or a digit."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(i).isalnum() for i in range(0x110000)])
    return _letters


def rolling_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every k-gram, all positions at once: powers of two are joined as k's bits say."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p = np.uint64(PRIME)
    block, length = codes.astype(np.uint64) % p, 1
    out, done = np.zeros(len(codes), np.uint64), 0
    while True:
        if k & length:
            # out covers [i, i + done); this block follows it.
            shifted = block[done:] if done else block
            m = len(shifted)
            out = (out[:m] * np.uint64(pow(BASE, length, PRIME)) + shifted) % p
            done += length
        if done == k:
            return out[:n]
        m = len(block) - length
        block = (block[:m] * np.uint64(pow(BASE, length, PRIME)) + block[length:]) % p
        length *= 2


def winnow(hashes: np.ndarray, bounds: np.ndarray, window: int) -> np.ndarray:
    """Positions chosen among ``hashes``; no window crosses a bound, and a shorter run is one window."""
    total = len(hashes)
    if not total:
        return np.zeros(0, np.int64)
    # Equal hashes: the larger position has the smaller key, so it is chosen.
    keys = (hashes << np.uint64(32)) | np.uint64(0xFFFFFFFF) - np.arange(total, dtype=np.uint64)
    least, length = keys, 1
    while length * 2 <= window:
        least = np.minimum(least[: len(least) - length], least[length:]) if len(least) > length else least[:0]
        length *= 2
    if length < window:
        rest = window - length
        least = np.minimum(least[: len(least) - rest], least[rest:]) if len(least) > rest else least[:0]
    lo, hi = bounds[:-1], bounds[1:]
    runs = np.repeat(hi, hi - lo)[: len(least)]
    inside = least[np.arange(len(least)) + window <= runs]
    short = (hi - lo < window) & (hi > lo)
    few = np.array([keys[a:b].min() for a, b in zip(lo[short], hi[short])], np.uint64)
    return np.unique(np.uint64(0xFFFFFFFF) - (np.concatenate([inside, few]) & np.uint64(0xFFFFFFFF))).astype(np.int64)


def fingerprint_batch(ids: pa.Array, texts: pa.Array, k: int, window: int):
    """Arrow batches of doc_id, pos, fingerprint."""
    data, offsets = utf8(texts)
    for lo, hi in groups(offsets):
        base = offsets[lo]
        codes = np.frombuffer(data[base : offsets[hi]].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        # Offsets in characters: continuation bytes don't begin one.
        begins = np.cumsum((data[base : offsets[hi]] & 0xC0) != 0x80) if len(codes) else np.zeros(0, np.int64)
        chars = np.concatenate([[0], begins])[offsets[lo : hi + 1] - base]
        keep = letters()[np.minimum(codes, 0x10FFFF)]
        kept = np.concatenate([[0], np.cumsum(keep)])[chars]
        codes = codes[keep]
        hashes = rolling_hashes(codes, k)
        # Only k-grams within one document count.
        sizes = np.maximum(np.diff(kept) - k + 1, 0)
        row = np.repeat(np.arange(hi - lo), sizes)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        own = np.arange(bounds[-1]) - bounds[row] + kept[row]
        hashes = hashes[own] if len(own) else hashes[:0]
        chosen = winnow(hashes, bounds, window)
        yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).take(pa.array(row[chosen])), pa.array(chosen - bounds[row[chosen]]), pa.array(hashes[chosen].astype(np.int64))], ["doc_id", "pos", "fingerprint"])


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, pos, fingerprint. No shuffle: a document is fingerprinted where it is read."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fingerprint_batch(batch.column("doc_id"), batch.column("text"), k, window)

    return documents(docs, lower=True).mapInArrow(run, "doc_id long, pos long, fingerprint long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))


_POLY = " + ".join(f"lead(c, {j}) OVER w * {pow(BASE, K - 1 - j, PRIME)}" for j in range(K))
ORACLE = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS s FROM documents WHERE text IS NOT NULL),
c AS (SELECT r, doc_id, length(s) - {K} AS last, unnest(range(length(s))) AS pos, unnest(list_transform(string_split(s, ''), lambda x: ord(x)::BIGINT)) AS c FROM t WHERE length(s) >= {K}),
h AS (SELECT r, doc_id, pos, last, ({_POLY}) % {PRIME} AS fp FROM c WINDOW w AS (PARTITION BY r ORDER BY pos)),
k AS (SELECT *, fp * 4294967296 + (4294967295 - pos) AS key FROM h WHERE pos <= last),
m AS (SELECT r, doc_id, pos, last, min(key) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS key FROM k),
d AS (SELECT DISTINCT r, doc_id, key FROM m WHERE pos = 0 OR pos + {WINDOW - 1} <= last)
SELECT doc_id, 4294967295 - (key % 4294967296) AS pos, key // 4294967296 AS fingerprint FROM d
"""
