"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max index.

Fitting takes a bounded sample of labelled documents (``MAX_LABELLED``, those of the
least hash of doc_id). Terms are all words of the sample, none is left out; their
document frequencies are counted over all documents. A term's weight is its TF-IDF
times a factor of at least 1 that grows with the likelihood ratio of the toxic label.
Examples that are alike stand together, in blocks of ``BLOCK``; long postings lists
have the largest weight of every block, short ones are summed whole. For a document
the bounds of all blocks are summed; the blocks of the greatest bounds are searched
first, and then those alone whose bound reaches the k-th best cosine found there: the
neighbours are those of an exhaustive search. One task makes the index, as files in the
shared folder that searching processes map, so that none holds a copy of its own (where
the folder is not one of the machine's file systems each reads them whole). Every
document that shares a word with an example is searched. Neighbours vote by inverse distance, and the votes are calibrated by isotonic regression on the sample, each
example left out of its own search. Neighbours and similarities are the evidence.

Defined results
  * Weights are (1 + ln tf) * (1 + ln((1 + N) / (1 + df))) * max(1, g * g / ln T),
    scaled to length 1 over the terms: g is the log likelihood ratio of a term
    that goes with the toxic label, else 0, and T the number of terms. Cosines are
    rounded to 9 digits; ties go to the lower doc_id. A document is never its own
    neighbour. Null labels count for nothing; a doc_id labelled twice is toxic if
    any of its labels is. Of texts that share a labelled doc_id the least is the example.
  * Null and empty text, and text without a word of any example, has no neighbours, null
    vote, and the share of toxic examples among those without a word as its score,
    smoothed by one example of the whole sample's share.
  * Without labels (an empty table, or none that meets a document) the score is null
    and nothing is toxic. Empty documents give an empty result.
  * Rows, repeated or with null doc_id, are scored one by one, texts of any length
    whole. Extra columns don't matter; ``reject_toxic`` passes them through.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import documents, lowered, read, removed, shared_path, written
from geoloom.llm.tokens import U64, WORD, Buckets, Tokens, groups, rows_of, utf8

#: Bound of the fit: labelled documents; their words are not bounded.
MAX_LABELLED = 20_000
NEIGHBOURS, THRESHOLD = 15, 0.5
#: Examples in a block (a power of two), documents that are held against blocks at a time, those of which alike ones are chosen for that, and the most promising blocks, which set the bound for the others.
BLOCK, ROWS, CHOICE, FIRST = 16, 128, 384, 16
#: A list's example and its weight lie together: both are fetched at once.
POSTING = np.dtype([("example", np.int32), ("weight", np.float32)])
#: Postings that are summed at a time (a longer list alone).
PIECE = 1 << 17
#: Words of more than a 20th of the examples, at most 512, have block maxima; blocks are formed by so many terms, those of most weight.
COMMON, MAX_COMMON, ALIKE = 20, 512, 256
#: Examples whose terms are weighed at a time as the index is made.
RUN = 512
#: Above the error of sums in single precision.
SLACK = 1e-4
#: Added to a distance before it is inverted.
NEAR = 0.05


class Files:
    """Arrays in files of a folder of this machine, mapped: their pages are no process's own."""

    def __init__(self, folder: str) -> None:
        self.folder, self.maps = folder, []

    def new(self, name: str, shape: int | tuple[int, ...], dtype) -> np.ndarray:
        self.maps.append(np.lib.format.open_memmap(os.path.join(self.folder, f"{name}.npy"), "w+", dtype, shape if isinstance(shape, tuple) else (shape,)))
        return np.asarray(self.maps[-1])

    def keep(self, name: str, values: np.ndarray) -> None:
        np.save(os.path.join(self.folder, f"{name}.npy"), values)

    def flush(self) -> None:
        for m in self.maps:
            m.flush()


class Memory:
    """The same, held by the process."""

    def new(self, name: str, shape: int | tuple[int, ...], dtype) -> np.ndarray:
        return np.zeros(shape, dtype)


def _array(fs: pafs.FileSystem, root: str, name: str) -> np.ndarray:
    """An array that ``Files`` has made: mapped if the file is on this machine, else read whole."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.asarray(np.load(f"{root}/{name}.npy", mmap_mode="r"))
    with fs.open_input_file(f"{root}/{name}.npy") as f:
        return np.load(f)


class Room:
    """Arrays that are used again: workers give freed memory back (see ``session``), and getting it anew for every document takes a fifth of the search."""

    def __init__(self) -> None:
        self.held = {}

    def __call__(self, name: str, shape: tuple[int, ...], dtype) -> np.ndarray:
        n = math.prod(shape)
        if name not in self.held or len(self.held[name]) < n:
            self.held[name] = np.empty(n, dtype)
        return self.held[name][:n].reshape(shape)


@dataclass
class Lists:
    """Inverted lists over places of examples.

    ``rank`` is a term's number among the common terms, or -1. The lists of common terms are
    ``matrix`` (block, place in it, term), with ``most`` (term, block): the largest weights. Those
    of the others lie in ``postings``, from ``start`` of the term on.
    """

    rank: np.ndarray
    matrix: np.ndarray
    most: np.ndarray
    start: np.ndarray
    postings: np.ndarray
    room: Room = field(default_factory=Room, init=False, repr=False)

    @property
    def example(self) -> np.ndarray:
        return self.postings["example"]

    @property
    def weight(self) -> np.ndarray:
        return self.postings["weight"]

    def rare(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The sums of the lists that have no block maxima, by block and place in it. Terms are those of such lists."""
        out, whole, weights = None, self.postings.view(np.int64), weights.astype(np.float32)
        a, b = self.start[terms], self.start[terms + 1]
        for lo, hi in groups(np.cumsum(np.concatenate([[0], b - a])), PIECE):
            some = self.room("some", (int((b[lo:hi] - a[lo:hi]).sum()),), np.int64)
            np.concatenate([whole[x:y] for x, y in zip(a[lo:hi].tolist(), b[lo:hi].tolist())], out=some)
            some = some.view(POSTING)
            # As bincount takes them, which would copy others.
            example, weight = self.room("example", some.shape, np.int64), self.room("weight", some.shape, np.float64)
            example[:] = some["example"]
            np.multiply(some["weight"], np.repeat(weights[lo:hi], b[lo:hi] - a[lo:hi]), out=weight)
            sums = np.bincount(example, weight, len(self.matrix) * BLOCK)
            out = sums if out is None else out + sums
        return np.zeros((len(self.matrix), BLOCK)) if out is None else out.reshape(-1, BLOCK)

    def promising(self, common: np.ndarray, bounds: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, float]:
        """Blocks whose bound reaches the k-th best of those of the greatest bounds, and that cosine. ``common`` are the weights of the common terms."""
        some = np.flatnonzero(bounds > 0)
        first = max(FIRST, -(-k // BLOCK))
        if len(some) <= first:
            return some, 0.0
        top = some[np.argpartition(-bounds[some], first - 1)[:first]]
        best = score[top].ravel()
        if len(common):
            best += np.take(self.matrix, top, 0, self.room("top", (len(top), BLOCK, len(common)), np.float32), "clip").reshape(-1, len(common)) @ common
        least = max(0.0, float(np.partition(best, len(best) - k)[len(best) - k]))
        return some[bounds[some] >= least - SLACK], least

    def common_sums(self, queries: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """[query, block, place]: the sums of the common terms in some blocks (ascending), runs of blocks at a time."""
        out = np.empty((len(queries), len(blocks) * BLOCK), np.float32)
        cut = np.flatnonzero(np.diff(blocks) > 1) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(blocks)]):
            if lo < hi:
                np.matmul(queries, self.matrix[blocks[lo] : blocks[hi - 1] + 1].reshape((hi - lo) * BLOCK, queries.shape[1]).T, out=out[:, lo * BLOCK : hi * BLOCK])
        return out.reshape(len(queries), len(blocks), BLOCK)


def block_maxima(score: np.ndarray) -> np.ndarray:
    """The largest of each row of BLOCK places: long passes by halves, as rows are short."""
    score = score.ravel()
    for _ in range(BLOCK.bit_length() - 1):
        score = np.maximum(score[::2], score[1::2])
    return score


@dataclass
class Index:
    """Unit vectors of labelled examples. Those of example e lie from first[e] to first[e + 1]."""

    ids: np.ndarray
    toxic: np.ndarray
    idf: np.ndarray
    first: np.ndarray
    feature: np.ndarray
    count: np.ndarray
    made: Files | Memory = Memory()

    @classmethod
    def load(cls, fs: pafs.FileSystem, root: str) -> Index:
        """An index that ``save`` has made. What only its making needs isn't there."""
        of = lambda name: _array(fs, root, name)
        index = cls(*map(of, ("ids", "toxic", "idf", "first", "feature")), np.zeros(0, np.int32))
        index.weights, index.by_place = of("weights"), of("by_place")
        index.lists = Lists(*map(of, ("rank", "matrix", "most", "start", "postings")))
        return index

    def save(self) -> None:
        """All that a search reads, in the folder of ``made`` (``Files``)."""
        for name in ("ids", "toxic", "idf", "first", "feature", "by_place"):
            self.made.keep(name, getattr(self, name))
        for name in ("rank", "most", "start"):
            self.made.keep(name, getattr(self.lists, name))
        self.made.flush()

    @classmethod
    def build(cls, ids: np.ndarray, toxic: np.ndarray, vectors: list[dict[int, int]], idf: np.ndarray) -> Index:
        first = np.cumsum([0, *map(len, vectors)])
        feature, count = (np.array([x for v in vectors for x in part(v)], np.int32) for part in (dict.keys, dict.values))
        return cls(ids, toxic, idf, first, feature, count)

    def _runs(self) -> Iterator[tuple[np.ndarray, slice]]:
        """Some examples at a time: the example of each of their terms, and where these lie. Whole columns would be held several times over."""
        for lo in range(0, len(self.ids), RUN):
            first = self.first[lo : lo + RUN + 1]
            yield np.repeat(np.arange(lo, lo + len(first) - 1), np.diff(first)), slice(int(first[0]), int(first[-1]))

    @cached_property
    def weights(self) -> np.ndarray:
        out = self.made.new("weights", len(self.feature), np.float64)
        for row, own in self._runs():
            out[own] = unit(row - row[0] if len(row) else row, self.feature[own], self.count[own], self.idf)
        return out

    @cached_property
    def place(self) -> np.ndarray:
        """The place of each example in an order in which examples that are alike stand together: halves by the axis of most variance, again and again."""
        n, w = len(self.ids), self.weights
        total = np.zeros(len(self.idf))
        for _, own in self._runs():
            total += np.bincount(self.feature[own], w[own] ** 2, len(total))
        most = np.argsort(-total, kind="stable")[:ALIKE]
        rank = np.full(len(self.idf), -1)
        rank[most] = np.arange(len(most))
        x = np.zeros((n, len(most)), np.float32)
        for row, own in self._runs():
            at = rank[self.feature[own]]
            there = at >= 0
            x[row[there], at[there]] = w[own][there]
        x -= x.mean(0)
        axes = np.random.default_rng(0).normal(size=(len(most), min(8, len(most)))).astype(np.float32)
        for _ in range(6):
            axes, _ = np.linalg.qr(x.T @ (x @ axes))
        x = x @ axes
        out, parts = [], [np.arange(n)]
        while parts:
            part = parts.pop()
            if len(part) <= BLOCK:
                out.append(part)
                continue
            by = part[np.argsort(x[part, x[part].var(0).argmax()], kind="stable")]
            half = -(-len(by) // (2 * BLOCK)) * BLOCK
            parts += [by[half:], by[:half]]
        place = np.empty(n, np.int64)
        place[np.concatenate(out)] = np.arange(n)
        return place

    @cached_property
    def by_place(self) -> np.ndarray:
        return np.argsort(self.place)

    @cached_property
    def lists(self) -> Lists:
        # Places beyond the last example stay empty.
        blocks = -(-len(self.ids) // BLOCK)
        df = np.zeros(len(self.idf), np.int64)
        for _, own in self._runs():
            df += np.bincount(self.feature[own], minlength=len(df))
        common = np.argsort(-df, kind="stable")[:MAX_COMMON]
        common = common[df[common] * COMMON > len(self.ids)]
        rank = np.full(len(self.idf), -1)
        rank[common] = np.arange(len(common))
        matrix = self.made.new("matrix", (blocks, BLOCK, len(common)), np.float32)
        flat = matrix.reshape(blocks * BLOCK, len(common))
        start = np.cumsum(np.concatenate([[0], np.where(rank < 0, df, 0)]))
        postings = self.made.new("postings", int(start[-1]), POSTING)
        # In order of places, each term goes to the next free place of its list.
        free = start[:-1].copy()
        for lo in range(0, len(self.ids), RUN):
            some = self.by_place[lo : lo + RUN]
            size = self.first[some + 1] - self.first[some]
            inside = np.arange(size.sum()) + np.repeat(self.first[some] - np.cumsum(size) + size, size)
            f, w, of = self.feature[inside], self.weights[inside].astype(np.float32), np.repeat(np.arange(lo, lo + len(some)), size)
            there = rank[f] >= 0
            flat[of[there], rank[f[there]]] = w[there]
            f, w, of = f[~there], w[~there], of[~there]
            by = np.argsort(f, kind="stable")
            f = f[by]
            begin = np.flatnonzero(np.diff(f, prepend=-1))
            n = np.diff(np.append(begin, len(f)))
            to = free[f] + np.arange(len(f)) - np.repeat(begin, n)
            postings["example"][to], postings["weight"][to] = of[by], w[by]
            free[f[begin]] += n
        return Lists(rank, matrix, np.ascontiguousarray(matrix.max(1).T), start, postings)

    def searched(self, row: np.ndarray, f: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each row with terms, in any order: row, examples and cosines of the k greatest; ties to the lower doc_id."""
        if not len(row) or not len(self.ids):
            return
        lists = self.lists
        begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        end = np.append(begin[1:], len(row))
        number = np.repeat(np.arange(len(begin)), end - begin)
        q = unit(number, f, c, self.idf)
        whole = np.zeros(len(self.idf))
        at = lists.rank[f]
        there = at >= 0
        queries = np.zeros((len(begin), lists.matrix.shape[2]), np.float32)
        queries[number[there], at[there]] = q[there]
        bounds = queries @ lists.most
        for lo in range(0, len(begin), CHOICE):
            found = []
            for i in range(lo, min(lo + CHOICE, len(begin))):
                own = slice(begin[i], end[i])
                terms, weights, rare = f[own], q[own], ~there[own]
                score = lists.rare(terms[rare], weights[rare])
                blocks, least = lists.promising(queries[i], bounds[i] + block_maxima(score), score, k)
                found.append((i, terms, weights, blocks, least, score[blocks].astype(np.float32)))
            # Documents of about the same blocks are taken together.
            found.sort(key=lambda x: x[3][len(x[3]) // 2] if len(x[3]) else -1)
            for part in range(0, len(found), ROWS):
                for i, near, cosine in self._nearest(found[part : part + ROWS], queries, whole, k):
                    yield int(row[begin[i]]), near, cosine

    def _nearest(self, found: list[tuple], queries: np.ndarray, whole: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Number, examples and cosines of some documents: number, terms, weights, promising blocks, least cosine, and the sums there of the lists without block maxima. ``whole`` is 0 for every term, before and after."""
        lists, example = self.lists, self.by_place
        needed = np.zeros(len(lists.matrix), bool)
        for x in found:
            needed[x[3]] = True
        slot = np.cumsum(needed) - 1
        common = lists.common_sums(queries[[x[0] for x in found]], np.flatnonzero(needed))
        for (i, terms, weights, blocks, least, score), sums in zip(found, common):
            score = (score + sums[slot[blocks]]).ravel()
            if len(score) > k:
                least = max(least, float(np.partition(score, len(score) - k)[len(score) - k]))
            near = np.flatnonzero((score >= least - SLACK) & (score > 0))
            if not len(near):
                continue
            near = example[blocks[near // BLOCK] * BLOCK + near % BLOCK]
            whole[terms] = weights
            first, last = self.first[near], self.first[near + 1]
            places = [slice(x, y) for x, y in zip(first.tolist(), last.tolist())]
            at = np.cumsum(last - first) - (last - first)
            # Rounded, so that equal cosines are equal whatever the order of their sums.
            cosine = np.round(np.add.reduceat(np.concatenate([self.weights[p] for p in places]) * whole[np.concatenate([self.feature[p] for p in places])], at), 9)
            whole[terms] = 0
            best = np.lexsort((self.ids[near], -cosine))[:k]
            yield i, near[best], cosine[best]

    def search(self, counts: dict[int, int], k: int) -> list[tuple[int, float]]:
        """The k examples of the greatest cosine, as (example, cosine); ties to the lower doc_id."""
        f, c = np.array(list(counts), np.int64), np.array(list(counts.values()), np.int64)
        return [x for _, near, cosine in self.searched(np.zeros(len(f), np.int64), f, c, k) for x in zip(near.tolist(), cosine.tolist())]


def unit(row: np.ndarray, feature: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of feature counts, each row of length 1."""
    w = (1 + np.log(count)) * idf[feature]
    return w / np.sqrt(np.bincount(row, w * w))[row]


@dataclass
class Model:
    #: The folder of the index; None without examples. A model goes to tasks without its index.
    path: str | None
    #: Isotonic steps: votes at which the score rises, and the scores.
    steps: tuple[list[float], list[float]]
    without: float | None
    k: int = NEIGHBOURS

    def __getstate__(self) -> dict:
        return {x: self.__dict__[x] for x in ("path", "steps", "without", "k")}

    @cached_property
    def index(self) -> Index:
        none = np.zeros(0, np.int64)
        return Index.build(none, none, [], np.zeros(0)) if self.path is None else Index.load(*_filesystem(self.path))

    @cached_property
    def features(self) -> np.ndarray:
        return np.zeros(0, U64) if self.path is None else _array(*_filesystem(self.path), "features")

    @cached_property
    def numbers(self) -> Buckets:
        return Buckets(self.features)

    def votes(self, row: np.ndarray, f: np.ndarray, c: np.ndarray, ids: list[int | None]) -> Iterator[tuple[int, float, list[int], list[float]]]:
        """Row, vote, neighbours and cosines of the rows that have neighbours; ids are those of all rows."""
        for r, near, cosine in self.index.searched(row, f, c, self.k + 1):
            if ids[r] is not None:
                other = self.index.ids[near] != ids[r]
                near, cosine = near[other], cosine[other]
            near, cosine = near[: self.k], cosine[: self.k]
            if len(near):
                weights = 1 / (NEAR + np.maximum(0.0, 1 - cosine))
                yield r, float((weights * self.index.toxic[near]).sum() / weights.sum()), self.index.ids[near].tolist(), cosine.tolist()

    def score(self, vote: float | None) -> float | None:
        if vote is None or not self.steps[0]:
            return self.without
        return self.steps[1][max(0, int(np.searchsorted(self.steps[0], vote + 1e-12, "right")) - 1)]


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


def make_index(fs: pafs.FileSystem, root: str, rows: Iterator[tuple[int, int, bytes, bytes]], features: np.ndarray, idf: np.ndarray) -> tuple[int, int]:
    """The files of the index of examples (doc_id, toxic, terms and counts as bytes), in order of doc_id; how many there are, and how many are toxic. Without any there are no files."""
    local = isinstance(fs, pafs.LocalFileSystem)
    with tempfile.TemporaryDirectory(prefix="geoloom-") as scratch:
        folder = root if local else os.path.join(scratch, "index")
        os.makedirs(folder)
        ids, toxic, size = [], [], []
        with open(os.path.join(scratch, "feature"), "wb") as f, open(os.path.join(scratch, "count"), "wb") as c:
            for doc_id, bad, terms, counts in rows:
                ids.append(doc_id)
                toxic.append(bad)
                size.append(f.write(terms) // 4)
                c.write(counts)
        if not ids:
            return 0, 0
        feature, count = (np.asarray(np.memmap(os.path.join(scratch, x), np.int32, "r")) for x in ("feature", "count"))
        made = Files(folder)
        made.keep("features", features)
        Index(np.array(ids, np.int64), np.array(toxic, np.int64), idf, np.cumsum([0, *size]), feature, count, made).save()
        if not local:
            fs.create_dir(root)
            pafs.copy_files(folder, root, source_filesystem=pafs.LocalFileSystem(), destination_filesystem=fs)
    return len(ids), sum(toxic)


def isotonic(pairs: list[tuple[float, int]]) -> tuple[list[float], list[float]]:
    """Pool adjacent violators: lowest vote and mean label of each pool, smoothed by one half of each label."""
    pools: list[list[float]] = []
    for x, y in sorted(pairs):
        if pools and pools[-1][0] == x:
            pools[-1][1] += y
            pools[-1][2] += 1
        else:
            pools.append([x, y, 1])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1][1] += last[1]
            pools[-1][2] += last[2]
    return [p[0] for p in pools], [(p[1] + 0.5) / (p[2] + 1) for p in pools]


def _feature_counts(batch: pa.RecordBatch, numbers: Buckets):
    """(row, feature, count) arrays of a batch, rows ascending."""
    data, offsets = utf8(batch.column("text"))
    for lo, hi in groups(offsets):
        tokens = Tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], WORD)
        place, number = numbers(tokens.hash)
        pair, n = np.unique((rows_of(tokens)[place] + lo).astype(np.int64) << 32 | number, return_counts=True)
        yield pair >> 32, pair & 0xFFFFFFFF, n


def _term_stats(sample: DataFrame) -> DataFrame:
    """term, n, toxic: documents of the sample with the word, and toxic ones among them."""

    def run(batches):
        for batch in batches:
            toxic = np.asarray(batch.column("toxic")).astype(np.int64)
            data, offsets = utf8(batch.column("text"))
            for lo, hi in groups(offsets):
                tokens = Tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], WORD)
                h, r = tokens.hash, rows_of(tokens)
                order = np.lexsort((h, r))
                h, r = h[order], r[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])]) if len(h) else np.zeros(0, bool)
                terms, inverse = np.unique(h[new], return_inverse=True)
                n = np.bincount(inverse, minlength=len(terms))
                bad = np.bincount(inverse, weights=toxic[lo:hi][r[new]], minlength=len(terms)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n), pa.array(bad)], ["term", "n", "toxic"])

    return sample.mapInArrow(run, "term long, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def _document_frequencies(docs: DataFrame, features: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all documents each feature is, and how many documents there are."""

    def run(batches):
        df, rows, numbers = np.zeros(len(features), np.int64), 0, Buckets(features)
        for batch in batches:
            rows += batch.num_rows
            for _, f, _ in _feature_counts(batch, numbers):
                df += np.bincount(f, minlength=len(features))
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(there, -1)), pa.array(np.append(df[there], rows))], ["f", "n"])

    df = np.zeros(len(features), np.int64)
    found = docs.select("text").mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    f, n = (np.asarray(found[c]) for c in ("f", "n"))
    df[f[f >= 0]] = n[f >= 0]
    return df, int(n[f < 0].sum())


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, k: int = NEIGHBOURS, by_label: bool = True) -> Model:
    """The model of ``docs`` (doc_id, lower-cased text) and labels (doc_id, toxic). Without ``by_label`` weights are TF-IDF alone."""
    by_doc = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = written(by_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled), "toxicity-labels")
    # At most max_labelled rows of 12 bytes.
    sample = written(docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")), "toxicity-sample")
    size, bad = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not size:
        removed(chosen, sample)
        return Model(None, ([], []), None, k)
    a, n, p = F.col("toxic").cast("double"), F.col("n").cast("double"), F.lit(bad / size)
    clean = F.when(n > a, (n - a) * F.ln((n - a) / (n * (1 - p)))).otherwise(0.0)
    gain = F.when(a > n * p, a * F.ln(a / (n * p)) + clean).otherwise(0.0) if by_label and 0 < bad < size else F.lit(0.0)
    # The words of at most max_labelled documents, 16 bytes each.
    terms = _term_stats(sample).select("term", gain.alias("gain")).toArrow()
    features = np.asarray(terms["term"]).view(U64)
    by = np.argsort(features)
    features, gain = features[by], np.asarray(terms["gain"])[by]
    df, total = _document_frequencies(docs, features)
    idf = (1 + np.log((1 + total) / (1 + df))) * np.maximum(1, gain**2 / math.log(max(3, len(features))))

    def vectors(batches):
        numbers = Buckets(features)
        for batch in batches:
            if not batch.num_rows:
                continue
            for row, f, c in _feature_counts(batch, numbers):
                cut = np.flatnonzero(np.diff(row, prepend=-1))
                parts = list(zip(cut.tolist(), [*cut[1:].tolist(), len(row)]))
                blobs = (pa.array([x[lo:hi].astype(np.int32).tobytes() for lo, hi in parts], pa.binary()) for x in (f, c))
                yield pa.RecordBatch.from_arrays([*(batch.column(x).take(pa.array(row[cut])) for x in ("doc_id", "toxic")), *blobs], ["doc_id", "toxic", "f", "c"])

    path = shared_path(docs.sparkSession, "toxicity-index")

    def indexed(batches):
        # A repeated task makes files of its own.
        own = f"{path}/{uuid.uuid4().hex}"
        rows = (row for batch in batches for row in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "toxic", "f", "c"))))
        n, bad = make_index(*_filesystem(own), rows, features, idf)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([n], pa.int64()), pa.array([bad], pa.int64())], ["path", "n", "bad"])

    found = sample.mapInArrow(vectors, "doc_id long, toxic int, f binary, c binary").repartition(1).sortWithinPartitions("doc_id").mapInArrow(indexed, "path string, n long, bad long").collect()
    at, n, with_words = found[0] if found else (None, 0, 0)
    share = (bad + 0.5) / (size + 1)
    model = Model(at, ([], []), float((bad - with_words + share) / (size - n + 1)), k)

    def calibration(batches):
        for batch in batches:
            if batch.num_rows:
                toxic = np.asarray(batch.column("toxic"))
                ids = batch.column("doc_id").to_pylist()
                found = [(v, int(toxic[r])) for part in _feature_counts(batch, model.numbers) for r, v, *_ in model.votes(*part, ids)]
                yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in found], pa.float64()), pa.array([y for _, y in found], pa.int32())], ["vote", "toxic"])

    model.steps = isotonic([tuple(r) for r in sample.repartition(docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(calibration, "vote double, toxic int").collect()])
    removed(chosen, sample)
    return model


def _scored(batch: pa.RecordBatch, texts: pa.RecordBatch, model: Model):
    """Per row of a batch: score, vote, neighbours, similarities."""
    out = [(model.score(None), None, [], [])] * batch.num_rows
    ids = texts.column("doc_id").to_pylist()
    for part in _feature_counts(texts, model.numbers):
        for r, vote, near, cosines in model.votes(*part, ids):
            out[r] = (model.score(vote), vote, near, cosines)
    return out


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **parameters) -> DataFrame:
    """doc_id, score, vote, toxic, neighbours, similarities of every document."""
    texts = documents(docs, lower=True)
    model = fit(texts, labels, **parameters)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                score, vote, near, cosines = zip(*_scored(batch, batch, model))
                toxic = [s is not None and s >= threshold for s in score]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64()), pa.array(vote, pa.float64()), pa.array(toxic, pa.bool_()), pa.array(near, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64()))], ["doc_id", "score", "vote", "toxic", "neighbours", "similarities"])

    return texts.mapInArrow(run, "doc_id long, score double, vote double, toxic boolean, neighbours array<long>, similarities array<double>")


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **parameters) -> DataFrame:
    """``docs`` without the toxic documents, with all their columns; they are scored where they are read."""
    model = fit(documents(docs, lower=True), labels, **parameters)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                # The last column is the lower-cased text.
                texts = pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column(batch.num_columns - 1)], ["doc_id", "text"])
                keep = [s is None or s < threshold for s, *_ in _scored(batch, texts, model)]
                yield batch.select(range(batch.num_columns - 1)).filter(pa.array(keep, pa.bool_()))

    return lowered(docs).mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
