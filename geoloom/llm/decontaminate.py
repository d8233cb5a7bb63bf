"""Benchmark decontamination: a BM25 index of test items with block-max WAND.

Items are cut into entries of at most ``SEGMENT`` words and inverted; an entry's BM25
weights are divided by its score against itself, so that one threshold holds for
all. Every document is cut into passages of ``2 * SEGMENT`` words, each beginning
``SEGMENT`` after the one before, so that every run of up to SEGMENT words lies
whole in one. Every passage is a query. Bounds of all blocks of entries are first
summed for many passages at once; passages in which some block's bound reaches the
threshold run block-max WAND (cursors, pivot, block bounds, skips) and retrieve all
entries at or above it. For what is retrieved the item's question and answer are
held against the document's word n-grams; both must overlap.

Defined results
  * Words are lower-cased runs of letters, digits and ``_``. An item's answer is its
    last sentence if it has several, else the last quarter of its words; the rest
    is the question. Overlap is the share of n-grams (n = 3, or all words of a
    shorter part) found in the document; a part without words overlaps fully.
  * A query's repeated words count once, as do an item's repeated rows. Every text of
    an item_id is an item of the index; of those a document holds, the best score is
    given. Each text with a null item_id is an item of its own, and counts in the
    words' frequencies only if no item has an id.
  * Null or empty texts of items are left out; null and empty texts match nothing; null
    doc_ids pass through and rows are taken one by one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import documents, lowered, read
from geoloom.llm.tokens import WORD, Lookup, Tokens, groups, ngrams, token_hashes, utf8

SEGMENT, THRESHOLD, OVERLAP, GRAM = 64, 0.7, 0.6, 3
K1, B = 1.2, 0.75
#: Entries in a block, and in one shard of the index (a shard's table of bounds has words * SHARD / BLOCK cells).
BLOCK, SHARD = 8, 2048
#: Items held by the driver and sent to the workers at a time; more take more passes.
MAX_ITEMS = 20_000


@dataclass
class Item:
    item_id: int | None
    words: np.ndarray
    question: np.ndarray
    answer: np.ndarray


def split_item(text: str) -> tuple[str, str] | None:
    """Question and answer, if there is more than one sentence."""
    cuts = list(re.finditer(r"[.!?]\s+(?=\S)", text.strip()))
    return (text.strip()[: cuts[-1].end()], text.strip()[cuts[-1].end() :]) if cuts else None


def make_item(item_id: int | None, text: str) -> Item:
    """Of a lower-cased text."""
    words = token_hashes(text)
    parts = split_item(text)
    question, answer = map(token_hashes, parts) if parts else (words[: len(words) - len(words) // 4], words[len(words) - len(words) // 4 :])
    return Item(item_id, words, question, answer)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of a part's n-grams; of all its words if it is shorter than n."""
    if not len(words):
        return np.zeros(0, np.uint64)
    t = Tokens.__new__(Tokens)
    t.hash, t.first = words, np.array([0, len(words)])
    n = min(n, len(words))
    h, valid = ngrams(t, n)
    return h[valid]


class Shard:
    """Inverted lists of some entries, by word number: entries ascending, normalised impacts, block bounds."""

    def __init__(self, entries: list[tuple[int, np.ndarray]], idf: dict[int, float], average: float) -> None:
        lists: dict[int, list[tuple[int, float]]] = {}
        self.item = np.array([i for i, _ in entries], np.int64)
        for e, (_, words) in enumerate(entries):
            tf = Counter(words.tolist())
            scale = K1 * (1 - B + B * len(words) / average)
            impact = {w: idf[w] * n * (K1 + 1) / (n + scale) for w, n in tf.items()}
            own = sum(impact.values())
            for w, x in impact.items():
                lists.setdefault(w, []).append((e, x / own))
        self.words = np.array(sorted(lists), np.uint64)
        self.lookup = Lookup(self.words)
        self.lists, self.impacts, self.blocks = [], [], []
        self.bounds = np.zeros((len(self.words), -(-len(entries) // BLOCK)), np.float32)
        for w, h in enumerate(self.words.tolist()):
            e = [p[0] for p in lists[h]]
            x = [p[1] for p in lists[h]]
            block: dict[int, float] = {}
            for a, b in zip(e, x):
                block[a // BLOCK] = max(block.get(a // BLOCK, 0.0), b)
            self.lists.append(e)
            self.impacts.append(x)
            self.blocks.append(block)
            for k, b in block.items():
                # Rounded up: a bound in single precision must not fall below the sum it bounds.
                self.bounds[w, k] = np.nextafter(np.float32(b), np.float32(2))
        self.most = [max(x) for x in self.impacts]

    def retrieve(self, query: list[int], threshold: float) -> list[tuple[int, float]]:
        """All entries whose score against the query's words is at least ``threshold``, by block-max WAND."""
        end = len(self.item)
        at = dict.fromkeys(query, 0)
        now = {w: self.lists[w][0] for w in query}
        slack = threshold - 1e-9
        found = []
        order = sorted(query, key=now.__getitem__)
        while order and now[order[0]] < end:
            # Pivot: the first word at which the sum of upper bounds can reach the threshold.
            total, pivot = 0.0, -1
            for i, w in enumerate(order):
                if now[w] >= end:
                    break
                total += self.most[w]
                if total >= slack:
                    pivot = i
                    break
            if pivot < 0:
                break
            entry = now[order[pivot]]
            while pivot + 1 < len(order) and now[order[pivot + 1]] == entry:
                pivot += 1
            block = entry // BLOCK
            if sum(self.blocks[w].get(block, 0.0) for w in order[: pivot + 1]) < slack:
                # Nothing in this block can do with these words: go behind it, or to the next word's entry.
                target = (block + 1) * BLOCK
                if pivot + 1 < len(order):
                    target = min(target, max(now[order[pivot + 1]], entry + 1))
                moved = order[: pivot + 1]
            elif now[order[0]] == entry:
                score = sum(self.impacts[w][at[w]] for w in order[: pivot + 1])
                if score >= slack:
                    found.append((entry, score))
                target, moved = entry + 1, order[: pivot + 1]
            else:
                target, moved = entry, [w for w in order[:pivot] if now[w] < entry]
            for w in moved:
                entries, i = self.lists[w], at[w]
                while i < len(entries) and entries[i] < target:
                    i += 1
                at[w], now[w] = i, entries[i] if i < len(entries) else end
            order.sort(key=now.__getitem__)
        return found


@dataclass
class Index:
    shards: list[Shard]
    items: dict[int, Item]

    @classmethod
    def build(cls, items: list[Item], df: dict[int, int], entries: int, average: float) -> Index:
        """``df``, ``entries`` and ``average`` are of all entries, also those of other indexes."""
        idf = {w: math.log(1 + (entries - n + 0.5) / (n + 0.5)) for w, n in df.items()}
        cut = sorted(((n, s) for n, i in enumerate(items) for s in segments(i.words)), key=lambda x: (len(x[1]), x[1].tolist()[:1], x[0]))
        return cls([Shard(cut[k : k + SHARD], idf, average) for k in range(0, len(cut), SHARD)], dict(enumerate(items)))


def segments(words: np.ndarray) -> list[np.ndarray]:
    return [words[i : i + SEGMENT] for i in range(0, len(words), SEGMENT)]


def passages(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, first and last word (exclusive) of the passages of rows that begin at ``first`` words."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(1, -(-(n - SEGMENT) // SEGMENT)), 0)
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    lo = first[row] + k * SEGMENT
    return row, lo, np.minimum(lo + 2 * SEGMENT, first[row + 1])


def candidates(shard: Shard, words: np.ndarray, lo: np.ndarray, hi: np.ndarray, threshold: float):
    """(passage, its distinct words) where some block's bound reaches the threshold."""
    at, known = shard.lookup(words)
    a, b = np.searchsorted(at, lo), np.searchsorted(at, hi)
    some = np.flatnonzero(b > a)
    if not len(some):
        return
    length = (b - a)[some]
    owner = np.repeat(np.arange(len(some)), length)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(a[some], length)
    # A passage's repeated words count once.
    pair = np.unique(owner.astype(np.int64) << 32 | known[inside])
    owner, word = pair >> 32, pair & 0xFFFFFFFF
    cut = np.searchsorted(owner, np.arange(len(some) + 1))
    most = np.array(shard.most, np.float64)
    enough = np.flatnonzero(np.add.reduceat(most[word], cut[:-1]) >= threshold - 1e-6)
    for part in range(0, len(enough), 4096):
        some_of = enough[part : part + 4096]
        sizes = cut[some_of + 1] - cut[some_of]
        begin = np.cumsum(sizes) - sizes
        own = word[np.arange(sizes.sum()) - np.repeat(begin, sizes) + np.repeat(cut[some_of], sizes)]
        bound = np.add.reduceat(shard.bounds[own], begin, axis=0).max(axis=1)
        for p in some_of[bound >= threshold - 1e-4].tolist():
            yield int(some[p]), word[cut[p] : cut[p + 1]].tolist()


def overlap(part: np.ndarray, seen: dict[int, np.ndarray], words: np.ndarray) -> float:
    """Share of a part's n-grams that the document has."""
    n = min(GRAM, len(part))
    if not n:
        return 1.0
    if n not in seen:
        seen[n] = grams(words, n) if len(words) >= n else np.zeros(0, np.uint64)
    return float(np.isin(grams(part, n), seen[n]).mean())


def matches(data: np.ndarray, offsets: np.ndarray, index: Index, threshold: float, least: float):
    """(row, item_id, score, question overlap, answer overlap) of the verified matches."""
    for lo, hi in groups(offsets):
        tokens = Tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], WORD)
        row, a, b = passages(tokens.first)
        best: dict[tuple[int, int], float] = {}
        for shard in index.shards:
            for p, query in candidates(shard, tokens.hash, a, b, threshold):
                for entry, score in shard.retrieve(query, threshold):
                    key = (int(row[p]), int(shard.item[entry]))
                    best[key] = max(best.get(key, 0.0), score)
        seen: dict[int, dict] = {}
        verified: dict[tuple, list[tuple[float, float, float]]] = {}
        for (r, i), score in sorted(best.items()):
            words = tokens.hash[tokens.first[r] : tokens.first[r + 1]]
            q, s = (overlap(x, seen.setdefault(r, {}), words) for x in (index.items[i].question, index.items[i].answer))
            if q >= least and s >= least:
                item = index.items[i].item_id
                verified.setdefault((r, i if item is None else -1, item), []).append((score, q, s))
        for (r, _, item), scores in verified.items():
            yield lo + r, item, *max(scores)


def indexes(benchmark: DataFrame) -> list[Index]:
    """One index of each MAX_ITEMS items, or more by the texts of the last item_id. Words' frequencies and the mean length are of all items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text")).filter("text is not null").distinct().orderBy(F.asc_nulls_last("item_id"), "text")
    df: Counter = Counter()
    entries = total = 0
    lots: list[list[Item]] = []
    owned = False
    for r in items.toLocalIterator():
        item = make_item(r["item_id"], r["text"])
        if not len(item.words):
            continue
        owned = owned or item.item_id is not None
        for s in segments(item.words):
            if item.item_id is None and owned:
                df.update(dict.fromkeys(s.tolist(), 0))
                continue
            df.update(set(s.tolist()))
            entries += 1
            total += len(s)
        if not lots or len(lots[-1]) >= MAX_ITEMS and (item.item_id is None or lots[-1][-1].item_id != item.item_id):
            lots.append([])
        lots[-1].append(item)
    return [Index.build(lot, df, entries, total / entries) for lot in lots]


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: float = OVERLAP) -> DataFrame:
    """doc_id, item_id, score, question, answer for every document and item of which it holds a copy."""
    schema = "doc_id long, item_id long, score double, question double, answer double"
    spark = docs.sparkSession
    texts = documents(docs, lower=True)
    out = spark.createDataFrame([], schema)
    for index in indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                if batch.num_rows and (found := list(matches(*utf8(batch.column("text")), shared.value, threshold, least))):
                    row, *rest = zip(*found)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), *(pa.array(x, t) for x, t in zip(rest, (pa.int64(), *[pa.float64()] * 3)))], ["doc_id", "item_id", "score", "question", "answer"])

        out = out.unionByName(texts.mapInArrow(run, schema))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: float = OVERLAP) -> DataFrame:
    """``docs``, with all their columns, without those that hold a copy of an item."""
    for index in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                if batch.num_rows:
                    keep = np.ones(batch.num_rows, bool)
                    # The last column is the lower-cased text.
                    for row, *_ in matches(*utf8(batch.column(batch.num_columns - 1)), shared.value, threshold, least):
                        keep[row] = False
                    yield batch.select(range(batch.num_columns - 1)).filter(pa.array(keep))

        docs = lowered(docs).mapInArrow(run, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
