"""Suffix-array dedup: passages of ``LENGTH`` words and more that documents share.

Two documents share a passage where the suffixes that begin there agree in their
first LENGTH words, which makes them neighbours in a sorted array of suffixes. To
sort only suffixes that can have such a neighbour:

1. Every window of LENGTH words is stood for by its least k-gram (k = LENGTH // 2),
   which depends on the window alone; the k-grams' hashes are counted over the
   corpus. A window can be shared only if its k-gram is in two documents.
2. Around each shared k-gram the text of the windows that it stands for is gathered
   in one place, by the k-gram's hash.
3. There the suffixes are sorted by mergesort. Two suffixes are compared by binary
   search for their longest common extension over prefix polynomial hashes, in
   O(log LENGTH). All comparisons of a merge step run at once in numpy. Neighbours
   that agree by hash are verified word by word, and words byte by byte; should a
   hash have collided, the piece is done again with another base.
4. Windows found in two documents are joined to spans.

Defined results
  * Words are what ASCII white space separates, compared exactly. Spans are given by
    the numbers of their first word and of the word after their last; spans of a
    document that touch or overlap are one.
  * A passage counts if at least two doc_ids have it. Repeats within one document
    don't, nor do rows that repeat a doc_id; their spans are given once.
  * Null doc_ids are left out; null, empty and short texts (fewer than LENGTH words)
    have no spans. Very long texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.llm.common import documents, read, written
from geoloom.llm.tokens import NONSPACE, U64, Tokens, groups, mix, ngrams, rows_of, utf8

LENGTH = 50
#: Rows that the sort takes at a time; a k-gram's rows are never parted.
PIECE_ROWS = 30_000


def sliding_least(h: np.ndarray, window: int) -> np.ndarray:
    """Position of the least of each ``window`` values (by their leading 40 bits), the leftmost of equals."""
    least = (h >> U64(24) << U64(24)) | np.arange(len(h), dtype=U64)
    length = 1
    while length * 2 <= window:
        least = np.minimum(least[:-length], least[length:])
        length *= 2
    if window > length:
        least = np.minimum(least[: length - window], least[window - length :])
    return (least & U64(0xFFFFFF)).astype(np.int64)


class Anchors:
    """The k-grams that stand for windows: hash, row, word number in the row, and the windows lo..hi (last included)."""

    def __init__(self, tokens: Tokens, length: int) -> None:
        k = length // 2
        span = length - k + 1
        total = len(tokens.hash)
        self.hash, self.row, self.word, self.lo, self.hi = (np.zeros(0, t) for t in (U64, np.int64, np.int64, np.int64, np.int64))
        out: list[tuple[np.ndarray, ...]] = []
        # Positions fit 24 bits: longer input is taken in overlapping parts.
        step = (1 << 24) - length
        for base in range(0, max(0, total - length + 1), step):
            part = slice(base, min(total, base + step + length - 1))
            t = Tokens.__new__(Tokens)
            t.hash, t.first = tokens.hash[part], np.array([0, part.stop - base])
            grams, _ = ngrams(t, k)
            grams = grams[: len(grams) - k + 1]
            least = sliding_least(grams, span) + base
            p = np.arange(len(least)) + base
            row = np.searchsorted(tokens.first, p, "right") - 1
            good = p + length <= tokens.first[row + 1]
            p, least, row = p[good], least[good], row[good]
            if not len(p):
                continue
            new = np.concatenate([[True], (least[1:] != least[:-1]) | (row[1:] != row[:-1])])
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(p)) - 1
            out.append((grams[least[at] - base], row[at], least[at] - tokens.first[row[at]], p[at] - tokens.first[row[at]], p[last] - tokens.first[row[at]]))
        if out:
            self.hash, self.row, self.word, self.lo, self.hi = (np.concatenate(x) for x in zip(*out))


def _anchor_blobs(docs: DataFrame, length: int, shards: int) -> DataFrame:
    """shard, hashes, docs: the anchors of many documents as columns of bytes, cut by hash."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"))
            data, offsets = utf8(batch.column("text"))
            hashes, docs_, words = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for lo, hi in groups(offsets):
                a = Anchors(Tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], NONSPACE), length)
                hashes.append(a.hash)
                docs_.append(ids[lo:hi][a.row])
                words.append(a.word.astype(np.int32))
            h, d, w = map(np.concatenate, (hashes, docs_, words))
            shard = (mix(h, 3) % U64(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange(shards + 1))
            some = np.flatnonzero(np.diff(cut))
            parts = [order[cut[s] : cut[s + 1]] for s in some]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array([x[p].tobytes() for p in parts], pa.binary()) for x in (h, d, w))], ["shard", "hashes", "docs", "words"])

    return docs.mapInArrow(run, "shard int, hashes binary, docs binary, words binary")


def _shared_anchors(blobs: DataFrame) -> DataFrame:
    """doc_id, word of the anchors whose hash two documents have."""
    import pandas as pd

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.frombuffer(b"".join(pdf["hashes"]), U64)
        d = np.frombuffer(b"".join(pdf["docs"]), np.int64)
        w = np.frombuffer(b"".join(pdf["words"]), np.int32)
        order = np.lexsort((d, h))
        h, d, w = h[order], d[order], w[order]
        begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        end = np.append(begin[1:], len(h))
        keep = np.repeat(d[begin] != d[end - 1], end - begin) if len(h) else np.zeros(0, bool)
        return pd.DataFrame({"doc_id": d[keep], "word": w[keep]})

    return blobs.groupBy("shard").applyInPandas(pick, "doc_id long, word int")


def _contexts(docs: DataFrame, shared: DataFrame, length: int) -> DataFrame:
    """anchor, doc_id, lo, text: the words of all windows that a shared anchor stands for."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = utf8(batch.column("text"))
            lists = batch.column("words")
            own = np.asarray(pc.list_parent_indices(lists)).astype(np.int64) << 32 | np.asarray(pc.list_flatten(lists)).astype(np.int64)
            for lo, hi in groups(offsets):
                t = Tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], NONSPACE)
                a = Anchors(t, length)
                keep = np.isin((a.row + lo) << 32 | a.word, own)
                row, first, last = a.row[keep], a.lo[keep], a.hi[keep]
                raw = data[offsets[lo] : offsets[hi]].tobytes()
                begin = t.start[t.first[row] + first].tolist()
                end = t.end[t.first[row] + last + length - 1].tolist()
                for p in range(0, len(row), PIECE_ROWS):
                    q = slice(p, p + PIECE_ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array(a.hash[keep][q].view(np.int64)), batch.column("doc_id").take(pa.array(row[q] + lo)), pa.array(first[q].astype(np.int32)), pa.array([raw[b:e] for b, e in zip(begin[q], end[q])], pa.binary())], ["anchor", "doc_id", "lo", "text"])

    words = shared.groupBy("doc_id").agg(F.collect_set("word").alias("words")).withColumnRenamed("doc_id", "_doc")
    joined = words.hint("shuffle_hash").join(docs, F.col("_doc") == F.col("doc_id")).select("doc_id", "text", "words")
    return joined.mapInArrow(run, "anchor long, doc_id long, lo int, text binary")


class Collision(Exception):
    """Two different pieces of text had one hash."""


class SuffixSorter:
    """Sorts suffixes of a word array by their first ``length`` words, within buckets."""

    def __init__(self, words: np.ndarray, length: int, base: int) -> None:
        self.words, self.length = words, length
        b = (0x9E3779B97F4A7C15 * (2 * base + 1)) & (2**64 - 1) | 1
        n = len(words) + 1
        with np.errstate(over="ignore"):
            power = np.full(n, U64(b))
            power[0] = 1
            inverse = np.full(n, U64(pow(b, -1, 2**64)))
            inverse[0] = 1
            self.inverse = np.cumprod(inverse, dtype=U64)
            self.prefix = np.concatenate([np.zeros(1, U64), np.cumsum(words * np.cumprod(power, dtype=U64)[:-1], dtype=U64)])

    def hash(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Polynomial hash of ``length`` words from ``at``."""
        with np.errstate(over="ignore"):
            return (self.prefix[at + length] - self.prefix[at]) * self.inverse[at]

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of words, at most ``length``, in which suffixes a and b agree: binary search over hashes."""
        common = np.zeros(len(a), np.int64)
        step = 1 << (self.length.bit_length() - 1)
        while step:
            longer = common + step
            fits = longer <= self.length
            longer = np.where(fits, longer, common)
            common = np.where(self.hash(a, longer) == self.hash(b, longer), longer, common)
            step >>= 1
        return common

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        common = self.extension(a, b)
        differ = common < self.length
        last = np.minimum(common, self.length - 1)
        return differ & (self.words[a + last] < self.words[b + last])

    def sort(self, suffix: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Order of the suffixes (buckets ascending, each contiguous): bottom-up mergesort, all merges of a width at once."""
        n = len(suffix)
        order = np.arange(n)
        if not n:
            return order
        begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        size = np.diff(np.append(begin, n))
        begin, end = np.repeat(begin, size), np.repeat(begin + size, size)
        place = np.arange(n)
        width = 1
        while width < size.max():
            base = begin + (place - begin) // (2 * width) * (2 * width)
            middle, top = np.minimum(base + width, end), np.minimum(base + 2 * width, end)
            right = place >= middle
            lo, hi = np.where(right, base, middle), np.where(right, middle, top)
            start = lo.copy()
            active = np.flatnonzero(lo < hi)
            sorted_ = suffix[order]
            while len(active):
                mid = (lo[active] + hi[active]) >> 1
                mine, other, r = sorted_[active], sorted_[mid], right[active]
                # From the right: how many of the left are not greater; from the left: how many of the right are less.
                before = np.empty(len(active), bool)
                before[r] = ~self.less(mine[r], other[r])
                before[~r] = self.less(other[~r], mine[~r])
                lo[active] = np.where(before, mid + 1, lo[active])
                hi[active] = np.where(before, hi[active], mid)
                active = active[lo[active] < hi[active]]
            rank = np.where(right, base + (place - middle), place) + (lo - start)
            merged = np.empty_like(order)
            merged[rank] = order
            order = merged
            width *= 2
        return order

    def verify(self, a: np.ndarray, b: np.ndarray, length: int) -> None:
        """Suffixes a and b agree word by word."""
        for j in range(length):
            if not np.array_equal(self.words[a + j], self.words[b + j]):
                raise Collision


def exact_words(data: np.ndarray, t: Tokens) -> np.ndarray:
    """Word hashes, after holding the bytes of equal hashes against each other; numbers if they differ."""
    order = np.argsort(t.hash, kind="stable")
    a, b = order[:-1], order[1:]
    same = t.hash[a] == t.hash[b]
    a, b = a[same], b[same]
    size = t.end - t.start
    fine = np.array_equal(size[a], size[b])
    for p in range(0, len(a) if fine else 0, 1 << 18):
        x, y = a[p : p + (1 << 18)], b[p : p + (1 << 18)]
        inside = np.arange(size[x].sum()) - np.repeat(np.cumsum(size[x]) - size[x], size[x])
        fine = fine and np.array_equal(data[np.repeat(t.start[x], size[x]) + inside], data[np.repeat(t.start[y], size[y]) + inside])
    if fine:
        return t.hash
    raw = data.tobytes()
    return mix(np.unique(np.array([raw[s:e] for s, e in zip(t.start, t.end)], object), return_inverse=True)[1].astype(U64), 5)


def shared_windows(anchor: np.ndarray, doc: np.ndarray, lo: np.ndarray, texts: pa.Array, length: int, base: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_id, first and last (exclusive) of the runs of windows that two documents have. Rows ascend by anchor."""
    data, offsets = utf8(texts)
    t = Tokens(data, offsets, NONSPACE)
    words = exact_words(data, t)
    while True:
        try:
            return _shared_windows(anchor, doc, lo, words, t.first, length, base)
        except Collision:
            base += 1


def _shared_windows(anchor: np.ndarray, doc: np.ndarray, lo: np.ndarray, words: np.ndarray, first: np.ndarray, length: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sorter = SuffixSorter(words, length, base)
    size = np.diff(first)
    whole = sorter.hash(first[:-1], size)
    # Equal texts under one anchor (copies) are sorted once.
    order = np.lexsort((doc, size, whole, anchor))
    a, w, s = anchor[order], whole[order], size[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (w[1:] != w[:-1]) | (s[1:] != s[:-1])])
    kind = np.cumsum(new) - 1
    head = order[new]
    stop = np.append(np.flatnonzero(new)[1:], len(order)) - 1
    least, most = doc[head], doc[order[stop]]
    copies = np.flatnonzero(order != head[kind])
    if len(copies):
        x, y, n = first[order[copies]], first[head[kind[copies]]], size[order[copies]]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if not np.array_equal(words[np.repeat(x, n) + inside], words[np.repeat(y, n) + inside]):
            raise Collision
    windows = size[head] - length + 1
    of = np.repeat(np.arange(len(head)), windows)
    offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    suffix = first[head][of] + offset
    bucket = anchor[head][of]
    by = sorter.sort(suffix, bucket)
    x, y = suffix[by[:-1]], suffix[by[1:]]
    near = bucket[by[:-1]] == bucket[by[1:]]
    near[near] = sorter.hash(x[near], length) == sorter.hash(y[near], length)
    sorter.verify(x[near], y[near], length)
    begin = np.flatnonzero(np.concatenate([[True], ~near]))
    group = np.cumsum(np.concatenate([[True], ~near])) - 1
    found = np.zeros(len(suffix), bool)
    found[by] = (np.minimum.reduceat(least[of[by]], begin) != np.maximum.reduceat(most[of[by]], begin))[group]
    # Runs of found windows of each kind of text, then of each row of the kind.
    edge = np.diff(np.concatenate([[0], found.astype(np.int8), [0]]))
    f = np.concatenate([[True], of[1:] != of[:-1]])
    starts = np.flatnonzero(found & (f | (edge[:-1] == 1)))
    ends = np.flatnonzero(found & (np.append(f[1:], True) | (edge[1:] == -1))) + 1
    run_kind, run_lo, run_n = of[starts], offset[starts], ends - starts
    runs_of = np.searchsorted(run_kind, np.arange(len(head) + 1))
    n = (runs_of[1:] - runs_of[:-1])[kind]
    rows = np.repeat(order, n)
    which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(runs_of[kind], n)
    at = lo[rows] + run_lo[which]
    return doc[rows], at, at + run_n[which]


def _sorted_runs(contexts: DataFrame, length: int) -> DataFrame:
    """doc_id, lo, hi: runs of shared windows."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def done(table: pa.Table) -> pa.RecordBatch:
            d, a, b = shared_windows(*(np.asarray(table["anchor"].combine_chunks()), np.asarray(table["doc_id"].combine_chunks()), np.asarray(table["lo"].combine_chunks()).astype(np.int64)), table["text"].combine_chunks(), length)
            return pa.RecordBatch.from_arrays([pa.array(d), pa.array(a), pa.array(b)], ["doc_id", "lo", "hi"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= PIECE_ROWS:
                table = pa.Table.from_batches(held)
                anchor = np.asarray(table["anchor"].combine_chunks())
                # The last anchor may go on in the next batch.
                cut = int(np.searchsorted(anchor, anchor[-1]))
                if cut:
                    yield done(table.slice(0, cut))
                    held = table.slice(cut).combine_chunks().to_batches()
                    rows -= cut
        if rows:
            yield done(pa.Table.from_batches(held))

    return contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "doc_id long, lo long, hi long")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, start_word, end_word, n_words of every maximal span of shared passages."""
    texts = documents(docs).filter("doc_id is not null and text is not null")
    shards = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = written(_shared_anchors(_anchor_blobs(texts, length, shards)), "suffix-anchors")
    runs = _sorted_runs(_contexts(texts, shared, length), length)
    spans = runs.select("doc_id", "lo", (F.col("hi") + (length - 1)).alias("hi"))
    before = W.partitionBy("doc_id").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1)
    until = W.partitionBy("doc_id").orderBy("lo", "hi")
    islands = spans.withColumn("new", (F.col("lo") > F.coalesce(F.max("hi").over(before), F.lit(-1))).cast("int")).withColumn("island", F.sum("new").over(until))
    return islands.groupBy("doc_id", "island").agg(F.min("lo").alias("start_word"), F.max("hi").alias("end_word")).select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(read(spark, sf_dir, "documents"))


ORACLE = f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r\\x0b\\x0c]+'), lambda x: x <> '') AS words FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, words, unnest(range(len(words) - {LENGTH - 1})) AS p FROM w WHERE len(words) >= {LENGTH}),
k AS (SELECT doc_id, p, array_to_string(list_slice(words, p + 1, p + {LENGTH}), ' ') AS k FROM p),
d AS (SELECT k FROM k GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
r AS (SELECT DISTINCT doc_id, p AS lo, p + {LENGTH} AS hi FROM k SEMI JOIN d USING (k)),
n AS (SELECT *, (lo > coalesce(max(hi) OVER (PARTITION BY doc_id ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1))::INT AS new FROM r),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY lo) AS island FROM n)
SELECT doc_id, min(lo)::BIGINT AS start_word, max(hi)::BIGINT AS end_word, (max(hi) - min(lo))::BIGINT AS n_words FROM i GROUP BY doc_id, island
"""
