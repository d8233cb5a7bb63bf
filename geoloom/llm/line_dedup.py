"""Line dedup by a sharded minimal perfect hash.

The distinct lines' 64-bit hashes are cut into shards by their remainder. Each
shard gets a minimal perfect hash (levels of bit arrays: a key takes the first
level at which no other key shares its bit; its rank among all bits set is its
slot) and, by slot, a 16-bit fingerprint and a saturated 8-bit count. Lines that
occur often enough have also the hash's place of first occurrence, in a short
array of their own. Documents hash their lines and look them up in these arrays,
which are read from the shared folder shard by shard: no line is joined. While all
shards fit in ``HELD_BYTES`` (checked), every task holds those it has met. Beyond
that the hashes (8 bytes each, with 8 of their text) go to the shards: tasks read
one shard after another, each once, and only lines that count as frequent come
back, by their text's hash.

Defined results
  * A line is what stands between newlines, without spaces and tabs at its ends.
    Lines of fewer than ``min_chars`` characters are never counted nor dropped.
  * A line that occurs ``min_count`` times or more in the corpus (repeats within a
    document count) stays at its first place only: the least doc_id, and there its
    first line. Rows that repeat a doc_id share that place and both keep it.
  * Texts and lines of any length are taken whole; an empty table gives an empty one.
    ``min_count`` may be any number, also beyond what the saturated counts can tell.
  * Null doc_ids come after all others. Null text stays null, with 0 lines; empty
    text stays empty. ``n_dropped`` counts the lines left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.llm.common import free_name, read, replace_column, shared_path, written
from geoloom.llm.tokens import U64, groups, mix, utf8
from geoloom.sources.files import files

MIN_COUNT, MIN_CHARS = 6, 10
NO_OWNER = 2**63 - 1
#: Bits per key and level of the perfect hash.
GAMMA = 2.0
#: Bytes of shards that every task may hold.
HELD_BYTES = 256 << 20
#: Distinct lines in a shard, about; tasks that share the probes of one shard.
SHARD_LINES, SALT = 1 << 21, 8


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys onto 0..n-1."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray) -> None:
        self.sizes, self.words = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum((sizes + 63) // 64)])
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))])

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return ((mix(keys, level + 1) >> U64(32)) * U64(size) >> U64(32)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, words, level = [], [], 0
        while len(keys):
            size = max(64, int(GAMMA * len(keys)))
            at = cls.place(keys, level, size)
            alone = np.bincount(at, minlength=size) == 1
            packed = np.packbits(np.concatenate([alone, np.zeros(-size % 64, bool)]), bitorder="little").view(U64)
            sizes.append(size)
            words.append(packed)
            keys, level = keys[~alone[at]], level + 1
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, U64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some keys that were never built in."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = self.place(keys[left], level, int(size))
            word = self.starts[level] + (at >> 6)
            bit = U64(1) << (at & 63).astype(U64)
            hit = (self.words[word] & bit) != 0
            below = np.bitwise_count(self.words[word[hit]] & (bit[hit] - U64(1)))
            out[left[hit]] = self.ranks[word[hit]] + below
            left = left[~hit]
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 77) >> U64(48)).astype(np.uint16)


class Shard:
    """The arrays of one shard."""

    def __init__(self, row: dict) -> None:
        self.hash = PerfectHash(np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["bits"], U64))
        self.fingerprints = np.frombuffer(row["fingerprints"], np.uint16)
        self.counts = np.frombuffer(row["counts"], np.uint8)
        self.owned = np.frombuffer(row["owned"], U64)
        self.owners = np.frombuffer(row["owners"], np.int64)

    @staticmethod
    def row(keys: np.ndarray, counts: np.ndarray, owners: np.ndarray, min_count: int) -> dict:
        ph = PerfectHash.build(keys)
        slot = ph.slots(keys)
        prints, small = np.zeros(len(keys), np.uint16), np.zeros(len(keys), np.uint8)
        prints[slot] = fingerprint(keys)
        small[slot] = np.minimum(counts, 255)
        often = np.flatnonzero(counts >= min_count)
        often = often[np.argsort(keys[often])]
        return {"sizes": ph.sizes.tobytes(), "bits": ph.words.tobytes(), "fingerprints": prints.tobytes(), "counts": small.tobytes(), "owned": keys[often].tobytes(), "owners": owners[often].tobytes()}

    def owner(self, keys: np.ndarray, min_count: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key's line occurs often enough, and where it belongs."""
        slot = self.hash.slots(keys)
        often = (slot >= 0) & (self.fingerprints[slot] == fingerprint(keys)) & (self.counts[slot] >= min(min_count, 255)) if len(self.counts) else np.zeros(len(keys), bool)
        owner = np.full(len(keys), NO_OWNER, np.int64)
        if not len(self.owned):
            return np.zeros(len(keys), bool), owner
        if often.any():
            at = np.searchsorted(self.owned, keys[often])
            at[at == len(self.owned)] = 0
            # Beyond 255 the count is saturated; the short array has the keys that really count.
            real = self.owned[at] == keys[often]
            owner[np.flatnonzero(often)[real]] = self.owners[at[real]]
            often[np.flatnonzero(often)[~real]] = False
        return often, owner


def _lines(data: np.ndarray, offsets: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, start, end (with its newline) and hash of every line; hash 0 where the line is too short."""
    newline = np.flatnonzero(data == 10)
    row = np.searchsorted(offsets, newline, "right") - 1
    full = np.flatnonzero(np.diff(offsets))
    # A row's last line ends with the row.
    ends = np.concatenate([newline, offsets[full + 1]])
    rows = np.concatenate([row, full])
    order = np.lexsort((ends, rows))
    ends, rows = ends[order], rows[order]
    starts = np.empty_like(ends)
    starts[1:] = ends[:-1] + 1
    first = np.concatenate([[True], rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, bool)
    starts[first] = offsets[rows[first]]
    import xxhash

    hashes = np.zeros(len(ends), U64)
    raw = data.tobytes()
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
        line = raw[a:b].strip(b" \t")
        if len(line) >= min_chars and (len(line) >= 4 * min_chars or len(line.decode("utf-8", "replace")) >= min_chars):
            hashes[i] = xxhash.xxh3_64_intdigest(line) or 1
    return rows, starts, ends, hashes


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    """doc_ids; null comes last."""
    return np.asarray(pc.fill_null(batch.column("doc_id").cast(pa.int64()), NO_OWNER))


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """line (hash), n, owner of the distinct lines; combined within each batch before the shuffle."""

    def run(batches):
        for batch in batches:
            ids = _ids(batch)
            data, offsets = utf8(batch.column("text"))
            for lo, hi in groups(offsets, 1 << 24):
                rows, _, _, h = _lines(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], min_chars)
                keep = h != 0
                keys, inverse, n = np.unique(h[keep], return_inverse=True, return_counts=True)
                owner = np.full(len(keys), NO_OWNER, np.int64)
                np.minimum.at(owner, inverse, ids[lo:hi][rows[keep]])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), pa.array(owner)], ["line", "n", "owner"])

    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "line long, n long, owner long")
    return pairs.groupBy("line").agg(F.sum("n").alias("n"), F.min("owner").alias("owner"))


_SHARD = "shard int, sizes binary, bits binary, fingerprints binary, counts binary, owned binary, owners binary"


def build_index(docs: DataFrame, min_count: int = MIN_COUNT, min_chars: int = MIN_CHARS, shards: int | None = None) -> tuple[str, int, int]:
    """Folder in the shared folder, number and bytes of the shards. Their number grows with that of distinct lines."""
    spark = docs.sparkSession
    lines = written(line_counts(docs, min_chars), "lines")
    shards = shards or max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), lines.count() // SHARD_LINES)

    def build(pdf):
        import pandas as pd

        keys = pdf["line"].to_numpy().view(U64)
        return pd.DataFrame([{"shard": int(pdf["shard"].iloc[0]), **Shard.row(keys, pdf["n"].to_numpy(), pdf["owner"].to_numpy(), min_count)}])

    path = shared_path(spark, "line-index")
    counted = lines.withColumn("shard", F.pmod("line", F.lit(shards)).cast("int"))
    counted.groupBy("shard").applyInPandas(build, _SHARD).write.partitionBy("shard").parquet(path)
    return path, shards, sum(n for _, n in files(path)) if shards else 0


def _load(path: str, shard: int) -> Shard | None:
    import pyarrow.fs as pafs

    fs, root = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    folder = f"{root}/shard={shard}"
    if fs.get_file_info(folder).type == pafs.FileType.NotFound:
        return None
    rows = pads.dataset(folder, filesystem=fs, format="parquet").to_table().to_pylist()
    return Shard(rows[0])


def dedup(docs: DataFrame, min_count: int = MIN_COUNT, min_chars: int = MIN_CHARS, drop_empty: bool = False, shards: int | None = None) -> DataFrame:
    """``docs`` with all its columns, the text without repeated lines, and _n_lines and _n_dropped behind them (with more underscores where ``docs`` has such columns).

    ``drop_empty`` leaves out documents that have lost all their lines with text, and the two counts.
    """
    path, n_shards, size = build_index(docs, min_count, min_chars, shards)
    counts = not drop_empty
    schema = T.StructType([*docs.schema.fields, *([T.StructField(free_name(docs, n), T.LongType()) for n in ("_n_lines", "_n_dropped")] if counts else [])])
    routed = size > HELD_BYTES

    def held_lookup():
        """Whether lines occur often enough, and where they belong, by the shards that the task has read."""
        known: dict[int, Shard | None] = {}

        def find(h: np.ndarray, rows: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            often, owner = np.zeros(len(h), bool), np.full(len(h), NO_OWNER, np.int64)
            at = np.flatnonzero(h)
            shard = (h[at].view(np.int64) % n_shards).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            for s, part in _runs(shard[order], at[order]):
                if s not in known:
                    known[s] = _load(path, s)
                if known[s] is not None:
                    often[part], owner[part] = known[s].owner(h[part], min_count)
            return often, owner

        return find

    def answered(h: np.ndarray, rows: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """The same by what came back with each row: its frequent lines and their owners."""
        often, owner = np.zeros(len(h), bool), np.full(len(h), NO_OWNER, np.int64)
        lines, owners = (batch.column(batch.num_columns - k) for k in (2, 1))
        row, line, own = np.asarray(pc.list_parent_indices(lines)).astype(np.int64), np.asarray(pc.list_flatten(lines)).view(U64), np.asarray(pc.list_flatten(owners))
        if not len(row):
            return often, owner
        key, wanted = (mix(x ^ mix(r.astype(U64), 5), 6) for x, r in ((line, row), (h, rows)))
        by = np.argsort(key)
        at = np.minimum(np.searchsorted(key[by], wanted), len(by) - 1)
        often = (line[by][at] == h) & (row[by][at] == rows)
        owner[often] = own[by][at[often]]
        return often, owner

    def rewrite(batch: pa.RecordBatch, find):
        whole, batch = batch, batch.select(range(len(docs_columns)))
        texts = batch.column("text").cast(pa.string())
        data, offsets = utf8(texts)
        rows, starts, ends, h = _lines(data, offsets, min_chars)
        ids = _ids(batch)
        often, owner = find(h, rows, whole)
        # The first of equal lines within its document.
        first = np.zeros(len(h), bool)
        if len(h):
            by = np.lexsort((np.arange(len(h)), h, rows))
            new = np.concatenate([[True], (rows[by][1:] != rows[by][:-1]) | (h[by][1:] != h[by][:-1])])
            first[by[new]] = True
        drop = often & ~((owner == ids[rows]) & first)
        n_lines, n_dropped = np.bincount(rows, minlength=len(ids)), np.bincount(rows[drop], minlength=len(ids))
        changed = np.flatnonzero(n_dropped)
        out = batch
        keep = None
        if len(changed):
            # Only changed rows are made anew.
            values = texts.to_pylist() if len(changed) * 4 > len(ids) else None
            new_text = {}
            raw = data.tobytes()
            where = np.searchsorted(rows, changed), np.searchsorted(rows, changed, "right")
            for r, a, b in zip(changed.tolist(), *(x.tolist() for x in where)):
                new_text[r] = b"\n".join(raw[starts[i] : ends[i]] for i in range(a, b) if not drop[i]).decode()
            if values is None:
                replacement = pa.array([new_text[r] for r in changed.tolist()], pa.string())
                mask = np.zeros(len(ids), bool)
                mask[changed] = True
                texts = pc.replace_with_mask(texts, pa.array(mask), replacement)
            else:
                texts = pa.array([new_text.get(i, v) for i, v in enumerate(values)], pa.string())
            out = replace_column(out, "text", texts)
            if "n_chars" in batch.schema.names:
                kind = batch.schema.field("n_chars").type
                lengths = pc.if_else(pa.array(np.isin(np.arange(len(ids)), changed)), pc.utf8_length(texts).cast(pa.int64()), batch.column("n_chars").cast(pa.int64()))
                out = replace_column(out, "n_chars", lengths.cast(kind))
            if drop_empty:
                gone = [r for r in changed.tolist() if not new_text[r].strip()]
                if gone:
                    keep = np.ones(len(ids), bool)
                    keep[gone] = False
        if counts:
            out = pa.RecordBatch.from_arrays([*out.columns, pa.array(n_lines.astype(np.int64)), pa.array(n_dropped.astype(np.int64))], schema.names)
        return out.filter(pa.array(keep)) if keep is not None else out

    docs_columns = docs.columns

    def run(batches):
        find = answered if routed else held_lookup()
        for batch in batches:
            if batch.num_rows:
                yield rewrite(batch, find)

    if not routed:
        return docs.mapInArrow(run, schema)
    answers = _answers(docs, path, n_shards, min_count, min_chars)
    key, lines, owners = (free_name(docs, n) for n in ("_key", "_lines", "_owners"))
    keyed = docs.withColumn(key, F.xxhash64(F.col("text").cast("string")))
    joined = keyed.join(answers.select(F.col("key").alias(key), F.col("lines").alias(lines), F.col("owners").alias(owners)), key, "left")
    return joined.select(*[joined[f"`{c}`"] for c in docs_columns], lines, owners).mapInArrow(run, schema)


def _answers(docs: DataFrame, path: str, n_shards: int, min_count: int, min_chars: int) -> DataFrame:
    """key (hash of a text), lines, owners: the frequent lines of every text that has some. Hashes go to the shards, a shard's to several tasks."""

    def probes(batches):
        for batch in batches:
            keys = np.asarray(batch.column("key"))
            data, offsets = utf8(batch.column("text"))
            for lo, hi in groups(offsets, 1 << 24):
                rows, _, _, h = _lines(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], min_chars)
                some = np.flatnonzero(h)
                h, k = h[some], keys[lo:hi][rows[some]]
                shard = (h.view(np.int64) % n_shards).astype(np.int64)
                by = np.lexsort((h, k, shard))
                h, k, shard = h[by], k[by], shard[by]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (k[1:] != k[:-1])]) if len(h) else np.zeros(0, bool)
                h, k, shard = h[new], k[new], shard[new]
                begin = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(h) else np.zeros(0, np.int64)
                parts = list(zip(begin.tolist(), [*begin[1:].tolist(), len(h)]))
                salt = int(k[0]) % SALT if len(k) else 0
                yield pa.RecordBatch.from_arrays([pa.array(shard[begin].astype(np.int32)), pa.array(np.full(len(begin), salt, np.int32)), *(pa.array([x[a:b].tobytes() for a, b in parts], pa.binary()) for x in (k, h))], ["shard", "salt", "keys", "lines"])

    def look(batches):
        at, shard = None, None
        for batch in batches:
            for s, keys, lines in zip(*(batch.column(c).to_pylist() for c in ("shard", "keys", "lines"))):
                if s != at:
                    at, shard = s, _load(path, s)
                if shard is None:
                    continue
                k, h = np.frombuffer(keys, np.int64), np.frombuffer(lines, U64)
                often, owner = shard.owner(h, min_count)
                yield pa.RecordBatch.from_arrays([pa.array(k[often]), pa.array(h[often].view(np.int64)), pa.array(owner[often])], ["key", "line", "owner"])

    text = F.col("text").cast("string")
    asked = docs.select(F.xxhash64(text).alias("key"), text.alias("text")).mapInArrow(probes, "shard int, salt int, keys binary, lines binary")
    found = asked.repartition("shard", "salt").sortWithinPartitions("shard").mapInArrow(look, "key long, line long, owner long").distinct()
    return found.groupBy("key").agg(F.collect_list(F.struct("line", "owner")).alias("x")).select("key", F.col("x.line").alias("lines"), F.col("x.owner").alias("owners"))


def _runs(keys: np.ndarray, values: np.ndarray):
    """(key, its values) of sorted keys."""
    if len(keys):
        cut = np.flatnonzero(np.diff(keys)) + 1
        for part, at in zip(np.split(values, cut), [0, *cut.tolist()]):
            yield int(keys[at]), part


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
l AS (SELECT r, doc_id, unnest(range(len(p))) AS i, unnest(p) AS line FROM (SELECT r, doc_id, string_split(text, chr(10)) AS p FROM d WHERE text <> '')),
t AS (SELECT *, trim(line, ' ' || chr(9)) AS k FROM l),
c AS (SELECT k, count(*) AS n, min(coalesce(doc_id, {NO_OWNER})) AS owner FROM t WHERE length(k) >= {MIN_CHARS} GROUP BY 1),
m AS (SELECT t.*, coalesce(c.n >= {MIN_COUNT} AND NOT (c.owner = coalesce(doc_id, {NO_OWNER}) AND row_number() OVER (PARTITION BY r, t.k ORDER BY i) = 1), false) AS gone FROM t LEFT JOIN c ON t.k = c.k),
g AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS kept FROM m GROUP BY 1)
SELECT doc_id, CASE WHEN g.r IS NULL THEN text ELSE coalesce(kept, '') END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped
FROM d LEFT JOIN g ON d.r = g.r
"""
