"""Language-model scoring by the likelihood of the subword lattice.

A document's probability is the sum over all its segmentations into pieces of an
existing vocabulary, each the product of its pieces' unigram probabilities; the
forward recursion takes that sum in log space. The vocabulary file is never
changed. The installed public files hold merge ranks in place of scores, which are
no probabilities, so the pieces' scores are estimated here: the tokenizer's own
segmentation of the whole corpus is counted piece by piece and smoothed by one
half. A file with log probabilities is used as it is with ``scores="file"``.

No piece holds white space after another character (this is checked), so no
segmentation crosses the start of a run of spaces and the sum over a document is
the product over its chunks. Chunks are found and hashed (64 bits) in numpy passes
over many texts at once; each distinct one is scored once among them, and the
recursion takes one step of all their lattices at a time.

Defined results
  * ``log_prob`` is the natural logarithm; ``bits_per_char`` is null for empty text.
  * Empty text has log probability 0, null text null. doc_id passes through, null
    or repeated. A character outside the vocabulary is spelled by its UTF-8 bytes.
  * Texts are scored whole at any length, in time linear in it; a run without spaces is
    one chunk, of which a block of characters is held at a time. Repeated rows each give
    a row; an empty table gives none. Extra columns of any name don't matter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import documents, read
from geoloom.llm.tokens import _BYTE_VALUE, U64, Lookup, groups, mix, powers, utf8

#: A newline, or a word with the spaces before it.
CHUNK = re.compile(r"\n| *[^ \n]+| +")
SPACE = "▁"
#: Bytes of text whose chunks are told apart at once, and characters whose lattices are summed at once.
GROUP, BLOCK = 1 << 21, 1 << 17
#: Scores of chunks that a worker remembers, by hash.
KNOWN = 1 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces of a sentencepiece model: text of usable pieces, and ids of single bytes."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        ids = range(m.vocab_size())
        self.bytes = {int(m.id_to_piece(i)[3:5], 16): i for i in ids if m.is_byte(i)}
        # Spaces within a text are plain here; the model writes them as U+2581.
        self.pieces = {m.id_to_piece(i).replace(SPACE, " "): i for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
        crossing = [p for p in self.pieces if re.search(r"[^ ] |\n.|.\n", p)]
        if crossing:
            raise ValueError(f"pieces that cross chunks: {crossing[:5]}")
        self.file_scores = {i: m.get_score(i) for i in [*self.pieces.values(), *self.bytes.values()]}

    def segment(self, chunk: str) -> list[int]:
        """The tokenizer's own ids of a chunk within a text."""
        # After a newline nothing is put before the chunk; the first two ids are the newline's.
        ids = self.model.encode("\n" + chunk)
        return ids[2:]

    def segment_all(self, chunks: list[str]) -> list[list[int]]:
        return [ids[2:] for ids in self.model.encode(["\n" + c for c in chunks], num_threads=1)]


class Chunks:
    """The chunks of some rows, each text with a space before it: bytes, ``start``, ``end``, ``hash``, and per row ``first`` (len rows+1). Empty rows have none."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        size = np.diff(offsets)
        before = np.concatenate([[0], np.cumsum(size > 0)])
        at = np.arange(len(data)) + np.repeat(before[1:], size)
        buf = np.full(len(data) + int(before[-1]), 32, np.uint8)
        buf[at] = data
        rows = offsets + before
        newline, space = buf == 10, buf == 32
        begins = newline | space
        begins[1:] &= newline[1:] | ~space[:-1]
        begins[1:] |= newline[:-1] & ~space[1:]
        begins[rows[:-1][size > 0]] = True
        self.bytes, self.start = buf, np.flatnonzero(begins)
        self.end = np.append(self.start[1:], len(buf)) if len(buf) else self.start
        self.first = np.searchsorted(self.start, rows)
        length = self.end - self.start
        if not len(length):
            self.hash = np.zeros(0, U64)
            return
        with np.errstate(over="ignore"):
            value = _BYTE_VALUE[buf] * powers(int(length.max()))[np.arange(len(buf)) - np.repeat(self.start, length)]
            self.hash = mix(np.add.reduceat(value, self.start) + length.astype(U64))

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One place of each distinct chunk, the number of each chunk's, and how often it occurs."""
        _, place, number, n = np.unique(self.hash, return_index=True, return_inverse=True, return_counts=True)
        return place, number, n

    def select(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of some chunks, one after another, and their lengths."""
        length = (self.end - self.start)[place]
        return self.bytes[np.arange(int(length.sum())) + np.repeat(self.start[place] - np.cumsum(length) + length, length)], length


class Lattice:
    """log P of chunks under unigram ``scores`` (id to log probability)."""

    def __init__(self, vocabulary: Vocabulary, scores: dict[int, float]) -> None:
        self.score = {p: scores[i] for p, i in vocabulary.pieces.items() if i in scores}
        self.byte = {b: scores[i] for b, i in vocabulary.bytes.items() if i in scores}
        self.longest = max(map(len, self.score), default=1)
        keys = np.array([self._key(p) for p in self.score], U64)
        order = np.argsort(keys)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one hash")
        self.lookup, self.values = Lookup(keys[order]), np.array(list(self.score.values()))[order]
        self._inverse = np.ones(1, U64)
        self._known, self._known_scores = np.zeros(0, U64), np.zeros(0)

    @staticmethod
    def _key(piece: str) -> int:
        codes = np.frombuffer(piece.encode("utf-32-le"), np.uint32)
        with np.errstate(over="ignore"):
            return int(mix(np.sum(mix(codes, 31) * powers(len(codes)), dtype=U64, keepdims=True), len(codes))[0])

    def _inverses(self, n: int) -> np.ndarray:
        """Inverses of ``powers(n)`` modulo 2**64."""
        if len(self._inverse) < n:
            grown = np.full(max(n, 4096), pow(int(powers(2)[1]), -1, 2**64), U64)
            grown[0] = 1
            self._inverse = np.cumprod(grown, dtype=U64)
        return self._inverse[:n]

    def spelled(self, char: str) -> float:
        return sum(self.byte.get(b, -math.inf) for b in char.encode("utf-8", "replace"))

    def forward(self, text: str) -> float:
        """The log of the summed probability of all segmentations, one text alone."""
        score, longest, exp, log = self.score, self.longest, math.exp, math.log
        alpha = [0.0]
        for end in range(1, len(text) + 1):
            arcs = []
            for start in range(max(0, end - longest), end):
                s = score.get(text[start:end])
                if s is not None:
                    arcs.append(alpha[start] + s)
            if text[end - 1] not in score:
                arcs.append(alpha[end - 1] + self.spelled(text[end - 1]))
            best = max(arcs)
            alpha.append(best + log(sum(exp(a - best) for a in arcs)) if best > -math.inf else best)
        return alpha[-1]

    def forward_all(self, data: np.ndarray, length: np.ndarray) -> np.ndarray:
        """``forward`` of many chunks, given as bytes and lengths in bytes."""
        out = np.zeros(len(length))
        if not len(length):
            return out
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        chars = np.add.reduceat((data & 0xC0) != 0x80, np.cumsum(length) - length, dtype=np.int64)
        order = np.argsort(-chars, kind="stable")
        upto = np.cumsum(chars)
        lo = 0
        # Chunks of about one length make a block; the longest stand alone.
        total = np.cumsum(chars[order])
        while lo < len(order):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + BLOCK, "right")))
            part = order[lo:hi]
            n = chars[part]
            if n[0] > BLOCK:
                # One chunk beyond a block, alone: its lattice is summed piece by piece.
                out[part] = self._long(codes[upto[part[0]] - n[0] : upto[part[0]]])
                lo = hi
                continue
            inside = np.arange(int(n.sum())) + np.repeat(upto[part] - n - np.cumsum(n) + n, n)
            out[part] = self._block(codes[inside], n)
            lo = hi
        return out

    def _arcs(self, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """[i, L - 1]: the score of the piece of L characters that ends at character i of its chunk; -inf if there is none."""
        total = len(codes)
        room = np.repeat(np.cumsum(n), n) - np.arange(total)
        arcs = np.full((total, self.longest), -np.inf)
        with np.errstate(over="ignore"):
            prefix = np.concatenate([np.zeros(1, U64), np.cumsum(mix(codes, 31) * powers(total), dtype=U64)])
            inverse = self._inverses(total)
            for length in range(1, self.longest + 1):
                at = np.flatnonzero(room >= length)
                if not len(at):
                    break
                place, number = self.lookup(mix((prefix[at + length] - prefix[at]) * inverse[at], length))
                arcs[at[place] + length - 1, length - 1] = self.values[number]
        alone = np.flatnonzero(arcs[:, 0] == -np.inf)
        if len(alone):
            kinds, which = np.unique(codes[alone], return_inverse=True)
            arcs[alone, 0] = np.array([self.spelled(chr(c)) for c in kinds.tolist()])[which]
        return arcs

    def _long(self, codes: np.ndarray) -> float:
        """log P of one chunk of any length, holding a block of its arcs at a time."""
        exp, log, none = math.exp, math.log, -math.inf
        alpha = [0.0]
        for lo in range(0, len(codes), BLOCK):
            before = min(lo, self.longest)
            part = codes[lo - before : lo + BLOCK]
            arcs = self._arcs(part, np.array([len(part)]))[before:]
            where, length = np.nonzero(arcs > none)
            cut = np.searchsorted(where, np.arange(len(arcs) + 1)).tolist()
            length, values = (length + 1).tolist(), arcs[where, length].tolist()
            alpha = alpha[-self.longest :]
            for e in range(len(arcs)):
                paths = [alpha[-n] + v for n, v in zip(length[cut[e] : cut[e + 1]], values[cut[e] : cut[e + 1]]) if n <= len(alpha)]
                best = max(paths, default=none)
                alpha.append(best + log(sum(exp(p - best) for p in paths)) if best > none else none)
        return alpha[-1]

    def _block(self, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log P of chunks whose lengths ``n`` descend: the recursion takes character e of all chunks at a time."""
        arcs, first, out = self._arcs(codes, n), np.cumsum(n) - n, np.zeros(len(n))
        # before[:, L - 1] is alpha of the place L characters before.
        before = np.full((len(n), self.longest), -np.inf)
        before[:, 0] = 0.0
        active = len(n)
        with np.errstate(divide="ignore", invalid="ignore"):
            for e in range(int(n[0])):
                while active and n[active - 1] <= e:
                    active -= 1
                paths = arcs[first[:active] + e] + before[:active]
                best = paths.max(1)
                alpha = np.where(best > -np.inf, best + np.log(np.exp(paths - best[:, None]).sum(1)), -np.inf)
                before[:active, 1:] = before[:active, :-1]
                before[:active, 0] = alpha
                out[:active] = alpha
        return out

    def _scores(self, c: Chunks, place: np.ndarray) -> np.ndarray:
        """log P of the chunks at ``place``, whose hashes ascend; those that are remembered aren't summed again."""
        h, out = c.hash[place], np.zeros(len(place))
        at = np.searchsorted(self._known, h)
        old = at < len(self._known)
        old[old] = self._known[at[old]] == h[old]
        out[old] = self._known_scores[at[old]]
        out[~old] = self.forward_all(*c.select(place[~old]))
        if len(self._known) < KNOWN and not old.all():
            keys = np.concatenate([self._known, h[~old]])
            order = np.argsort(keys, kind="stable")
            self._known, self._known_scores = keys[order], np.concatenate([self._known_scores, out[~old]])[order]
        return out

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log P of every row; 0 of an empty one."""
        out = np.zeros(len(offsets) - 1)
        for lo, hi in groups(offsets, GROUP):
            c = Chunks(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            place, number, _ = c.distinct()
            score = self._scores(c, place)[number]
            some = np.flatnonzero(np.diff(c.first))
            if len(some):
                out[lo + some] = np.add.reduceat(score, c.first[some])
        return out

    def document(self, text: str) -> float:
        data = np.frombuffer(text.encode(), np.uint8)
        return float(self.documents(data, np.array([0, len(data)]))[0])


def chunk_counts(docs: DataFrame) -> DataFrame:
    """How often each chunk occurs in the corpus; combined within groups of texts before the shuffle."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in groups(offsets, GROUP):
                c = Chunks(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                place, _, n = c.distinct()
                raw, length = c.select(place)
                ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.string(), len(place), [None, pa.py_buffer(ends), pa.py_buffer(raw)]), pa.array(n)], ["chunk", "n"])

    return docs.select("text").mapInArrow(run, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def piece_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """How often each piece is used by the tokenizer's own segmentation of the corpus."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(vocabulary)
        held = np.zeros(v.model.vocab_size(), np.int64)
        for batch in batches:
            pieces = v.segment_all(batch.column("chunk").to_pylist())
            times = np.repeat(np.asarray(batch.column("n")), [len(p) for p in pieces])
            np.add.at(held, np.fromiter((i for p in pieces for i in p), np.int64, len(times)), times)
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(held[used])], ["piece", "n"])

    return chunk_counts(docs).mapInArrow(run, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def unigram_scores(docs: DataFrame, vocabulary: str, smoothing: float = 0.5) -> dict[int, float]:
    """Log probability of every usable piece. What comes to the driver is bounded by the vocabulary."""
    v = Vocabulary(vocabulary)
    counts = {r["piece"]: r["n"] for r in piece_counts(docs, vocabulary).collect()}
    usable = [*v.pieces.values(), *v.bytes.values()]
    total = sum(counts.get(i, 0) for i in usable) + smoothing * len(usable)
    return {i: math.log((counts.get(i, 0) + smoothing) / total) for i in usable}


def score_documents(docs: DataFrame, vocabulary: str | None = None, scores: str = "corpus") -> DataFrame:
    """doc_id, n_chars, log_prob, bits_per_char of every document."""
    path = vocabulary or default_vocabulary()
    docs = documents(docs)
    table = Vocabulary(path).file_scores if scores == "file" else unigram_scores(docs, path)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        lattice = Lattice(Vocabulary(path), shared.value)
        for batch in batches:
            text = batch.column("text")
            logs = lattice.documents(*utf8(text))
            missing = np.asarray(pc.is_null(text))
            n = pc.utf8_length(text).cast(pa.int64())
            chars = np.asarray(pc.fill_null(n, 0))
            bits = -logs / np.maximum(chars, 1) / math.log(2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, pa.array(logs, mask=missing), pa.array(bits, mask=missing | (chars == 0))], ["doc_id", "n_chars", "log_prob", "bits_per_char"])

    return docs.mapInArrow(run, "doc_id long, n_chars long, log_prob double, bits_per_char double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"))
