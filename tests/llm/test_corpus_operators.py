"""Each corpus operator against SQL and plain Python, with the awkward cases."""

import math
import pickle
import random
import re
import tracemalloc

import brute
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import SF, of_spark, of_sql
from pyspark.sql import functions as F

from geoloom.llm import decontaminate, line_dedup, lm_score, mixing, ngram_join, secret_scan, suffix_dedup, tokens, toxicity, url_filter, winnow
from geoloom.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def pool(seed: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(60)]


def awkward(n: int = 40) -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, copies, near copies and repeated rows."""
    r, w = random.Random(5), pool(1)
    passage = " ".join(r.choices(w, k=30))
    shared = ["a line that is repeated", "   another   repeated line\t", "short"]
    texts = [" ".join(r.choices(w, k=r.randint(1, 80))) for _ in range(n)]
    texts = [t + "\n" + r.choice(shared) + "\n" + (passage if i % 5 == 0 else "") for i, t in enumerate(texts)]
    texts += [texts[3], texts[3] + " extra", texts[3].replace("\n", " \n"), "", None, "word", "!!!", " \n\t\n", "\n".join(shared * 4), " ".join(r.choices(w, k=4000)), "é ü 漢字 " * 30, texts[0].upper()]
    rows = [(i + 1, t, "en" if i % 3 else None, f"src{i % 3}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[2], rows[4], (None, texts[1], None, None, None), (None, None, None, None, None), (None, texts[1], None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - {"op4_suffix_dedup", "op6_winnow_fingerprints", "op8_ngram_join"}))
def test_against_sql(spark, name):
    # The smallest tables have no secrets.
    sf = SF.replace("0.001", "0.01") if name == "op3_secret_scan" else SF
    assert (got := of_spark(QUERIES[name](spark, sf))) == of_sql(ORACLE_SQL[name], sf) and got[1]


@pytest.mark.parametrize("name", ["op4_suffix_dedup", "op6_winnow_fingerprints", "op8_ngram_join"])
def test_against_sql_on_awkward_documents(spark, docs, tmp_path, name):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = of_spark(QUERIES[name](spark, str(tmp_path)))
    assert got == of_sql(ORACLE_SQL[name], tables={"documents": pd.DataFrame(awkward(), columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64", "n_chars": "Int64"})})


# --- Line dedup ------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_perfect_hash(keys):
    k = np.array(sorted(keys), np.uint64)
    h = line_dedup.PerfectHash.build(k)
    assert sorted(h.slots(k).tolist()) == list(range(len(k)))


@pytest.mark.parametrize("shards", [1, 7])
def test_line_dedup(docs, shards):
    got = line_dedup.dedup(docs.select("doc_id", "text"), 3, 10, shards=shards).collect()
    assert ordered(got) == ordered(brute.line_dedup(pairs(awkward()), 3, 10))


@pytest.mark.parametrize("shards", [1, 7])
def test_line_dedup_beyond_what_a_task_holds(docs, tmp_path, monkeypatch, shards):
    """Hashes go to the shards: each task reads a shard once."""
    real, log = line_dedup._load, tmp_path / "loads"

    def load(path, shard):
        import os

        with log.open("a") as f:
            f.write(f"{os.getpid()} {shard}\n")
        return real(path, shard)

    monkeypatch.setattr(line_dedup, "HELD_BYTES", 1)
    monkeypatch.setattr(line_dedup, "_load", load)
    clash = docs.select("doc_id", "text", *[F.lit(1).alias(c) for c in ("key", "_key", "_lines", "lines", "owners")])
    got = line_dedup.dedup(clash, 3, 10, shards=shards)
    assert got.columns[: len(clash.columns)] == clash.columns
    assert ordered((r["doc_id"], r["text"], r["_n_lines"], r["_n_dropped"]) for r in got.collect()) == ordered(brute.line_dedup(pairs(awkward()), 3, 10))


def test_line_dedup_counts_beyond_a_byte(spark):
    rows = [(i, "the very same line") for i in range(300)] + [(900, "a line of its own")]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), 290, 5).collect()
    assert ordered(got) == ordered(brute.line_dedup(rows, 290, 5))


# --- N-gram join ------------------------------------------------------------------


@pytest.mark.parametrize(("n", "t"), [(2, (1, 2)), (5, (7, 10)), (3, (1, 1))])
def test_ngram_join(docs, n, t):
    rows = ngram_join.near_duplicates(docs, n, t).collect()
    got = {r["doc_id"]: r["group_id"] for r in rows}
    assert got == brute.near_groups(pairs(awkward()), n, t) and got
    assert {r["doc_id"]: r["n_links"] for r in rows} == brute.near_links(pairs(awkward()), n, t, got)


@pytest.mark.parametrize("block", [2, 1024])
def test_ngram_join_gives_all_pairs_and_cuts_long_lists(docs, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "LIST_BLOCK", block)
    monkeypatch.setattr(ngram_join, "HELD_PAIRS", 3 if block == 2 else 1 << 20)
    monkeypatch.setattr(ngram_join, "SHORT", 4 if block == 2 else 64)
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 2 if block == 2 else 128)
    r, w = random.Random(6), pool(1)
    base = r.choices(w, k=40)
    rows = [(i, " ".join([*base[:i], "changed", *base[i + 1 :]])) for i in range(30)] + [(100 + i, " ".join(base)) for i in range(3)]
    df = docs.sparkSession.createDataFrame(rows, "doc_id long, text string")
    links, classes = ngram_join.near_pairs(df, 2, (1, 2))
    assert {(x["a"], x["b"]): (x["overlap"], x["size_a"], x["size_b"]) for x in links.collect()} == brute.near_pairs(rows, 2, (1, 2))
    assert {x["class_id"] for x in classes.filter("doc_id >= 100").collect()} == {100}


def clustered_rows() -> list[tuple]:
    """Two clusters that share a passage, with texts that no cluster holds, copies, and texts that share it too."""
    r, w = random.Random(8), pool(1)
    shared = r.choices(w, k=25)
    rows = []
    for c, count in enumerate((60, 40)):
        base = shared + r.choices(w, k=45)
        for i in range(count):
            text = [x if r.random() > 0.03 else f"changed{r.randrange(50)}" for x in base]
            rows.append((1000 * c + i, " ".join(text[: r.choice((70, 70, 50))])))
    rows += [(3000 + i, " ".join(shared + r.choices(w, k=12 + i))) for i in range(6)] + [(4000 + i, rows[3][1]) for i in range(3)]
    return rows


@pytest.mark.parametrize("block", [7, 1024])
def test_ngram_join_writes_no_pairs_of_a_cluster(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "CLUSTER_DOCS", block)
    if block == 7:
        monkeypatch.setattr(ngram_join, "LIST_BLOCK", 2)
        monkeypatch.setattr(ngram_join, "HELD_PAIRS", 3)
        monkeypatch.setattr(ngram_join, "SHORT", 4)
    rows, counts, whole = clustered_rows(), {}, ngram_join.written

    def counted(df, name):
        out = whole(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "written", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.near_duplicates(df, 2, (1, 2)).collect()
    groups = brute.near_groups(rows, 2, (1, 2))
    assert {r["doc_id"]: r["group_id"] for r in got} == groups
    assert {r["doc_id"]: r["n_links"] for r in got} == brute.near_links(rows, 2, (1, 2), groups)
    every = brute.near_pairs(rows, 2, (1, 2))
    assert len(every) > 1500 and counts["jaccard-pairs"] < 200 and counts["jaccard-candidates"] < len(every) / 2
    links, _ = ngram_join.near_pairs(df, 2, (1, 2))
    assert sorted((x["a"], x["b"], x["overlap"], x["size_a"], x["size_b"]) for x in links.collect()) == sorted((*k, *v) for k, v in every.items())


@pytest.mark.parametrize("dense", [0, 16, 10**9])
def test_overlaps_of_blocks(monkeypatch, dense):
    monkeypatch.setattr(ngram_join, "DENSE", dense)
    monkeypatch.setattr(ngram_join, "COLUMNS", 7)
    r = np.random.default_rng(3)
    sides = []
    for rows in (9, 13):
        sets_ = [[np.unique(r.integers(100 * f, 100 * f + r.choice([5, 60]), 20).astype(np.uint64)) for f in range(2)] for _ in range(rows)]
        sides.append((sets_, [(np.repeat(np.arange(rows), [len(x[f]) for x in sets_]), np.concatenate([x[f] for x in sets_])) for f in range(2)]))
    (a, of_a), (b, of_b) = sides
    want = [[sum(len(np.intersect1d(x[f], y[f])) for f in range(2)) for y in b] for x in a]
    assert ngram_join._overlaps(of_a, of_b, len(a), len(b)).tolist() == want


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6))
def test_sketches_bound_the_overlap(seed):
    r = np.random.default_rng(seed)
    grams = np.unique(r.integers(0, 2**63, 900).astype(np.uint64))
    sets = [np.sort(r.choice(grams, r.integers(1, 600), replace=False)) for _ in range(2)]
    order = ngram_join.Order(np.full(1 << ngram_join.BUCKET_BITS, 3))
    sketches = []
    for x in sets:
        numbers = order.number(x)
        f = order.fragments(numbers)
        sizes = np.bincount(f, minlength=ngram_join.FRAGMENTS).astype(np.uint32)
        odd = np.bincount(f.astype(np.int64) * ngram_join.SKETCH_BITS + (numbers & np.uint64(ngram_join.SKETCH_BITS - 1)).astype(np.int64), minlength=ngram_join.FRAGMENTS * ngram_join.SKETCH_BITS) & 1
        sketches.append(np.concatenate([sizes.view(np.uint8), np.packbits(odd.astype(bool))])[None])
    most = ngram_join.most_common(*sketches)[0]
    assert len(np.intersect1d(*sets)) <= most <= min(map(len, sets))


def test_texts_that_share_a_doc_id_count_as_the_least_set(spark):
    a, b, c = ("one two three four five six seven", "one two three four five six seven eight nine", "x y z")
    df = spark.createDataFrame([(1, c), (1, a + " " + b + " ten"), (1, "X, y z!"), (2, b), (3, a), (4, "x y z"), (3, "a b c d e f g h i j k l")], "doc_id long, text string")
    got = {r["doc_id"]: (r["group_id"], r["n_links"]) for r in ngram_join.near_duplicates(df, 3, (1, 2)).collect()}
    assert got == {1: (1, 0), 4: (1, 0), 2: (2, 1), 3: (2, 1)}


def test_keep_one_keeps_columns_and_rows_without_group(docs):
    clash = docs.withColumn("_gone", F.lit(1)).withColumn("label", F.lit("x"))
    kept = ngram_join.keep_one(clash)
    groups = brute.near_groups(pairs(awkward()), ngram_join.N, ngram_join.THRESHOLD)
    assert kept.columns == clash.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in awkward() if groups.get(r[0], r[0]) == r[0])


# --- Decontamination -----------------------------------------------------------


def items() -> list[tuple]:
    r, w = random.Random(9), pool(1)
    long_ = " ".join(r.choices(w, k=150))
    texts = ["What " + " ".join(r.choices(w, k=20)) + "? The " + " ".join(r.choices(w, k=8)) for _ in range(12)] + [long_, "one two", "", None, "!!"]
    return [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "nobody owns this item")]


def contaminated_docs() -> list[tuple]:
    r, w, it = random.Random(3), pool(2), items()
    out = awkward()
    for k, (i, t) in enumerate(it[:13]):
        around = [" ".join(r.choices(w, k=r.randint(0, 150))) for _ in range(2)]
        cut = t.split()
        out.append((500 + k, f"{around[0]} {t.upper()} {around[1]}", "en", "src0", 1))
        out.append((600 + k, f"{around[0]} {' '.join(cut[: len(cut) // 2])} {around[1]}", "en", "src0", 1))
        out.append((700 + k, f"{around[0]} {' '.join(c for j, c in enumerate(cut) if j % 9)} {around[1]}", "en", "src0", 1))
    return out


def test_decontamination(spark):
    docs = spark.createDataFrame(contaminated_docs(), SCHEMA)
    bench = spark.createDataFrame(items(), "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"], round(r["score"], 6)) for r in decontaminate.contaminated(docs, bench).collect()), key=str)
    d = decontaminate
    assert got == brute.bm25_matches(pairs(contaminated_docs()), items(), d.SEGMENT, d.THRESHOLD, d.OVERLAP, d.GRAM, d.K1, d.B)
    assert {500 + k for k in range(13)} <= {g[0] for g in got} and all(g[0] is not None and g[0] >= 500 for g in got)
    clean = d.decontaminate(docs.withColumn("row", F.lit(1)), bench)
    assert ordered(r[:2] for r in clean.collect()) == ordered(r[:2] for r in contaminated_docs() if r[0] not in {g[0] for g in got})


def test_every_text_of_an_item_is_indexed(spark, monkeypatch):
    r = random.Random(12)
    texts = [" ".join(r.choices(pool(k), k=20)) for k in range(4)]
    bench = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (1, texts[1]), (None, texts[2]), (None, texts[3])], "item_id long, text string")
    docs = spark.createDataFrame([(10 + k, f"before {t} after", "en", "s", 1) for k, t in enumerate(texts)] + [(20, texts[0] + " " + texts[1], "en", "s", 1), (21, "clean", "en", "s", 1)], SCHEMA)
    for items_ in (20_000, 1):
        monkeypatch.setattr(decontaminate, "MAX_ITEMS", items_)
        got = decontaminate.contaminated(docs, bench).collect()
        assert ordered((g["doc_id"], g["item_id"]) for g in got) == ordered([(10, 1), (11, 1), (12, None), (13, None), (20, 1)])
        assert [g["doc_id"] for g in decontaminate.decontaminate(docs, bench).collect()] == [21]
    assert {g["doc_id"] for g in decontaminate.contaminated(docs, bench.filter("item_id is null")).collect()} == {12, 13}


def test_many_items_take_several_indexes(spark, monkeypatch):
    docs = spark.createDataFrame(contaminated_docs(), SCHEMA)
    bench = spark.createDataFrame(items(), "item_id long, text string")
    want = ordered(decontaminate.contaminated(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "MAX_ITEMS", 4)
    assert ordered(decontaminate.contaminated(docs, bench).collect()) == want


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.floats(0.05, 0.9))
def test_wand_is_exhaustive(seed, threshold):
    r = np.random.default_rng(seed)
    entries = [(i, r.integers(0, 30, r.integers(1, 12)).astype(np.uint64)) for i in range(60)]
    shard = decontaminate.Shard(entries, dict.fromkeys(range(30), 1.3), 6.0)
    query = sorted(set(r.integers(0, len(shard.words), 8).tolist()))
    scores = np.zeros(60)
    for w in query:
        for e, x in zip(shard.lists[w], shard.impacts[w]):
            scores[e] += x
    assert sorted(e for e, _ in shard.retrieve(query, threshold)) == np.flatnonzero(scores >= threshold - 1e-9).tolist()


# --- Suffix dedup ------------------------------------------------------------------


@pytest.mark.parametrize("length", [6, 20])
def test_suffix_dedup(docs, length):
    got = suffix_dedup.repeated_spans(docs, length).collect()
    assert ordered(got) == ordered(brute.spans(pairs(awkward()), length)) and got


def test_suffix_dedup_in_pieces(docs, monkeypatch):
    want = brute.spans(pairs(awkward()), 6)
    monkeypatch.setattr(suffix_dedup, "PIECE_ROWS", 3)
    texts = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    rows = sorted(((r["doc_id"], r["text"]) for r in texts.collect()))
    assert brute.spans(rows, 6) == want
    a, d, lo, t = [], [], [], []
    for i, text in rows:
        ws = [x for x in brute.SPACES.split(text) if x]
        if len(ws) >= 6:
            a.append(0), d.append(i), lo.append(0), t.append(" ".join(ws).encode())
    got = suffix_dedup.shared_windows(np.array(a), np.array(d), np.array(lo), pa.array(t, pa.binary()), 6)
    found = {(x, i) for x, b, e in zip(*map(np.ndarray.tolist, got)) for i in range(b, e)}
    assert found == {(x, i) for x, b, e, _ in want for i in range(b, e - 5)}


def test_suffix_sort_is_a_sort():
    r = np.random.default_rng(0)
    words = r.integers(0, 3, 400).astype(np.uint64)
    s = suffix_dedup.SuffixSorter(words, 12, 1)
    suffix = np.arange(380)
    order = s.sort(suffix, np.zeros(380, np.int64))
    keys = [tuple(words[i : i + 12].tolist()) for i in suffix[order]]
    assert keys == sorted(keys)


def test_colliding_words_are_told_apart(monkeypatch):
    from geoloom.llm.tokens import NONSPACE, Tokens

    data = np.frombuffer(b"aa bb aa cc", np.uint8)
    t = Tokens(data, np.array([0, 11]), NONSPACE)
    t.hash[:] = 7
    got = suffix_dedup.exact_words(data, t)
    assert got[0] == got[2] and len(set(got.tolist())) == 3


# --- Winnowing ------------------------------------------------------------------


@pytest.mark.parametrize(("k", "window"), [(3, 4), (8, 1), (30, 71)])
def test_winnow(docs, k, window):
    got = [(r["doc_id"], r["pos"], r["fingerprint"]) for r in winnow.fingerprints(docs, k, window).collect()]
    want = [(r[0], p, f) for r in awkward() for p, f in brute.winnow(r[1], k, window, winnow.BASE, winnow.PRIME)]
    assert ordered(got) == ordered(want)


@settings(max_examples=40, deadline=None)
@given(st.text("ab", min_size=12, max_size=40), st.text("ab", max_size=20), st.text("ab", max_size=20))
def test_shared_text_shares_a_fingerprint(common, x, y):
    k, window = 5, 8
    one, two = ({f for _, f in brute.winnow(t, k, window, winnow.BASE, winnow.PRIME)} for t in (x + common, common + y))
    assert one & two


# --- Language model ------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return lm_score.Vocabulary(lm_score.default_vocabulary())


def test_lattice_sums_all_segmentations(vocabulary):
    rng = random.Random(1)
    scores = {i: -rng.uniform(1, 9) for i in [*vocabulary.pieces.values(), *vocabulary.bytes.values()]}
    lattice = lm_score.Lattice(vocabulary, scores)
    for text in (" the", " nation", "\n", " été", " a漢b", "  x", " \u0000q", " constitution"):
        want = brute.lattice(text, lattice.score, lattice.spelled)
        assert math.isclose(lattice.forward(text), want, rel_tol=1e-12)
        data = np.frombuffer(text.encode(), np.uint8)
        assert math.isclose(lattice.forward_all(data, np.array([len(data)]))[0], want, rel_tol=1e-12)


def test_chunks_lose_nothing(vocabulary):
    lattice = lm_score.Lattice(vocabulary, vocabulary.file_scores)
    for text in ("ab cd", " a  b \n\nc ", "x", "\n\n x", "é 漢字  \n ü", "\U0001f600 a" * 9, "a" * 3000, "   "):
        data = np.frombuffer(text.encode(), np.uint8)
        c = lm_score.Chunks(data, np.array([0, 0, len(data), len(data)]))
        assert [c.bytes[a:b].tobytes().decode() for a, b in zip(c.start, c.end)] == lm_score.CHUNK.findall(" " + text)
        assert c.first.tolist() == [0, 0, len(c.start), len(c.start)]
        assert "".join(lm_score.CHUNK.findall(" " + text)) == " " + text
        assert math.isclose(lattice.document(text), lattice.forward(" " + text), rel_tol=1e-12)


def test_lm_scores(docs, vocabulary):
    got = {r["doc_id"]: r for r in lm_score.score_documents(docs).collect() if r["doc_id"] is not None}
    counts: dict[int, int] = {}
    for r in awkward():
        for c in lm_score.CHUNK.findall(" " + r[1]) if r[1] else []:
            for p in vocabulary.segment(c):
                counts[p] = counts.get(p, 0) + 1
    usable = [*vocabulary.pieces.values(), *vocabulary.bytes.values()]
    total = sum(counts.get(i, 0) for i in usable) + 0.5 * len(usable)
    lattice = lm_score.Lattice(vocabulary, {i: math.log((counts.get(i, 0) + 0.5) / total) for i in usable})
    for r in awkward():
        if r[0] is not None:
            g = got[r[0]]
            assert (g["log_prob"] is None) == (r[1] is None) and g["n_chars"] == (None if r[1] is None else len(r[1]))
            if r[1]:
                assert math.isclose(g["log_prob"], lattice.forward(" " + r[1]), rel_tol=1e-9)
    assert got[next(r[0] for r in awkward() if r[1] == "")]["log_prob"] == 0


# --- Secrets ------------------------------------------------------------------


def test_ledger_scans_unseen_pairs_alone(spark, tmp_path):
    key = "AKIA" + "A" * 16
    v = "doc_id long, path string, text string"
    first = spark.createDataFrame([(1, "a", f"x {key} {key}"), (2, "b", f"x {key} {key}"), (3, "c", ""), (4, "d", None), (None, "e", "password=deadbeef00"), (1, "a", f"x {key} {key}")], v)
    ledger = str(tmp_path / "ledger")
    secret_scan.scan_increment(first, ledger)
    scanned = lambda: sum(len(r["rules"]) for r in spark.read.option("recursiveFileLookup", True).parquet(f"{ledger}/scanned").collect())
    n = scanned()
    assert n == 3 * len(secret_scan.RULES)
    got = secret_scan.findings(first, ledger).collect()
    assert sorted((r["path"], r["rule_id"], r["n"]) for r in got) == [("a", "aws-access-key", 2), ("a", "aws-access-key", 2), ("b", "aws-access-key", 2), ("e", "password-assignment", 1)]
    secret_scan.scan_increment(first, ledger)
    assert scanned() == n
    more = first.unionByName(spark.createDataFrame([(9, "z", "new text")], v))
    rules = (*secret_scan.RULES[1:], secret_scan.Rule("aws-access-key", 3, "AKIA[0-9A-Z]{15}", "AKIA"))
    secret_scan.scan_increment(more, ledger, rules)
    assert scanned() == n + 3 + len(rules)
    assert {r["rule_version"] for r in secret_scan.findings(more, ledger, rules).collect() if r["rule_id"] == "aws-access-key"} == {3}


def test_a_large_increment_finds_the_same_and_shuffles_no_text(spark, tmp_path, monkeypatch):
    key = "AKIA" + "A" * 16
    v = "doc_id long, path string, text string"
    old = [(1, "a", f"x {key} {key}"), (2, "b", f"x {key} {key}"), (3, "c", ""), (4, "d", None), (1, "a", f"x {key} {key}")]
    new = [*old, (None, "e", "password=deadbeef00"), (6, "f", f"password=deadbeef00 {key}"), (7, "g", f"password=deadbeef00 {key}")]
    newer = (*secret_scan.RULES[1:], secret_scan.Rule("aws-access-key", 3, "AKIA[0-9A-Z]{15}", "AKIA"))
    each_way, plans = [], []
    for few in (100_000, 0):
        monkeypatch.setattr(secret_scan, "FEW", few)
        ledger = str(tmp_path / f"ledger{few}")
        for rows, rules in ((old, secret_scan.RULES), (new, secret_scan.RULES), (new, newer)):
            df = spark.createDataFrame(rows, v)
            secret_scan.scan_increment(df, ledger, rules)
        tables = [spark.read.option("recursiveFileLookup", True).parquet(f"{ledger}/{x}") for x in ("findings", "scanned")]
        each_way.append([ordered(t.collect()) for t in tables] + [ordered(secret_scan.findings(df, ledger, newer).collect())])
        # The texts are read anew for the scan.
        todo = spark.createDataFrame([("0" * 64, 1, ["aws-access-key@3"])], "blob string, doc_id long, todo array<string>")
        plans.append(spark._jvm.PythonSQLUtils.explainString(secret_scan._scanned(df, todo, newer, few > 0)._jdf.queryExecution(), "formatted"))
    assert each_way[0] == each_way[1] and len(each_way[0][2]) == 8
    assert not [x for plan in plans for x in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan) if "text#" in x]


# --- URLs ---------------------------------------------------------------------------


def test_url_filter_against_every_rule(spark):
    urls = ["http://a.example.org/x/y", "https://USER@B.a.Example.org:80/x", "http://example.org", "http://example.org/x?q=1#f", "ftp://example.org./x/yz", None, "", "no scheme", "http:///x", "http://exampleXorg/", "http://example.org/x/y"] * 2
    rules = [(5, "example.org", "block"), (3, "example.org", "allow"), (2, "a.example.org", "review"), (9, "example.org/x", "block"), (1, "example.org/x/y", "allow"), (7, "org", "review"), (8, None, "block")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("key", F.lit(1))
    frame = spark.createDataFrame(rules, "rule_id long, pattern string, action string")
    keys = dict(pages.select("page_id", url_filter.url_key(F.col("url"))).collect())
    prefix = dict(frame.select("rule_id", url_filter.rule_prefix(F.col("pattern"))).collect())
    for r in url_filter.filter_urls(pages, frame).collect():
        key = keys[r["page_id"]]
        hits = sorted((-len(prefix[i]), i, a) for i, p, a in rules if p is not None and key is not None and key.startswith(prefix[i]))
        assert (r["rule_id"], r["action"]) == ((hits[0][1], hits[0][2]) if hits else (None, "invalid" if key is None else "allow"))
    assert url_filter.filter_urls(pages, frame.limit(0)).count() == len(urls)
    assert url_filter.filter_urls(pages.limit(0), frame).count() == 0


# --- Mixing -------------------------------------------------------------------------


@pytest.mark.parametrize(("weights", "fraction"), [({"src0": 8}, (4, 5)), ({"src1": 0, "src2": 3}, (1, 3)), ({}, (1, 1))])
def test_mixing(docs, weights, fraction):
    tiers = ((1, 4), (1, 2), (1, 1))
    sizes, limits = mixing.mix(docs, weights, 1, fraction, tiers)
    got = mixing.tiers_of(sizes, limits).collect()
    want = brute.mixed([(r[0], r[1], r[3]) for r in awkward()], weights, 1, fraction, tiers)
    assert ordered(got) == want
    clash = docs.withColumn("_source", F.lit(1)).withColumn("_tier", F.lit(2)).withColumn("_limits", F.lit(3)).withColumn("h", F.lit(4))
    kept = mixing.mixed_documents(clash, weights=weights, fraction=fraction)
    assert kept.columns == clash.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(w[0]) for w in want)


# --- Toxicity ------------------------------------------------------------------


def labelled() -> tuple[list[tuple], list[tuple]]:
    r, w = random.Random(4), pool(1)
    bad = [f"vile{c}" for c in "abcdefghij"]
    docs = [(i, " ".join(r.choices(w, k=30) + (r.choices(bad, k=3) if i % 4 == 0 else [])), "en", "s", 1) for i in range(400)]
    return [*docs, (None, "vilea vileb", None, None, None), (999, None, None, None, None), (998, "", None, None, None), docs[0]], [(i, 1, int(i % 4 == 0)) for i in range(200)] + [(0, 1, 1), (None, 1, 1), (300, None, None)]


def like_brute_toxicity(got, docs, labels):
    """Features, frequencies, neighbours, votes and calibration, all built anew in plain Python."""
    want = brute.toxicity(pairs(docs), [(r[0], r[2]) for r in labels], toxicity.NEIGHBOURS, toxicity.NEAR, toxicity.THRESHOLD)
    key = lambda r: (str(r[0]), r[2] is None, r[2] or 0.0, len(r[4]))
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[0] == w[0] and g[3:5] == w[3:5]
        for x, y in ((g[1], w[1]), (g[2], w[2])):
            assert x == y or math.isclose(x, y, abs_tol=1e-7)
        assert np.allclose(g[5], w[5], atol=1e-8)


def test_toxicity_on_awkward_documents(spark, docs):
    labels = [(i, 1, int(i % 3 == 0)) for i in range(1, 45)] + [(7, None, 1), (8, 1, None), (4000, 1, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    like_brute_toxicity(toxicity.score_documents(docs, lab).collect(), awkward(), labels)
    assert toxicity.score_documents(docs.limit(0), lab).count() == 0


def test_toxicity_finds_what_was_held_out_and_its_neighbours(spark):
    docs, labels = labelled()
    df, lab = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(df, lab).collect()
    assert len(got) == len(docs)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["toxic"] == (i % 4 == 0) for i in range(200, 400))
    assert by[None]["toxic"] and not by[999]["toxic"] and not by[998]["toxic"] and by[998]["vote"] is None
    like_brute_toxicity(got, docs, labels)
    clash = df.withColumn("score", F.lit(1)).withColumn("toxic", F.lit(True))
    kept = toxicity.reject_toxic(clash, lab)
    assert kept.columns == clash.columns
    assert ordered([r["doc_id"]] for r in kept.collect()) == ordered([r["doc_id"]] for r in got if not r["toxic"])


def test_toxicity_searches_every_document_by_all_its_words(spark):
    r = random.Random(8)
    topics = [[f"t{k}w{j}" for j in range(40)] for k in range(30)]
    docs = [(i, " ".join(["the", *r.choices(topics[i % 30], k=12)] + (["vile"] if i % 3 == 0 else [])), "en", "s", 1) for i in range(300)]
    # A word of two toxic examples alone, and one that isn't in the examples.
    docs += [(300, "seldom " + docs[1][1], "en", "s", 1), (301, "seldom " + docs[2][1], "en", "s", 1), (302, "the seldom", "en", "s", 1), (303, "unheard", "en", "s", 1)]
    df = spark.createDataFrame(docs, SCHEMA)
    lab = spark.createDataFrame([(i, 1, int(i % 3 == 0 or i == 301)) for i in range(302)][:150] + [(300, 1, 1), (301, 1, 1)], "doc_id long, quality int, toxic int")
    by = {r["doc_id"]: r for r in toxicity.score_documents(df, lab).collect()}
    assert all(len(by[i]["neighbours"]) == toxicity.NEIGHBOURS for i in range(303)) and by[303]["neighbours"] == []
    assert by[302]["neighbours"][:2] in ([300, 301], [301, 300])
    like_brute_toxicity(by.values(), docs, [(r[0], 1, r[2]) for r in lab.collect()])
    # Without a toxic word the nearest examples are those of the same topic.
    plain = [i for i in range(150, 300) if i % 3]
    assert sum(by[i]["neighbours"][0] % 30 == i % 30 for i in plain) > 0.9 * len(plain)
    assert not any(by[i]["toxic"] for i in plain) and all(by[i]["toxic"] for i in range(150, 300, 3))


def test_toxicity_without_labels(spark):
    docs, labels = labelled()
    df, lab = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert {(r["score"], r["toxic"]) for r in toxicity.score_documents(df, lab.limit(0)).collect()} == {(None, False)}
    assert toxicity.reject_toxic(df, lab.filter("toxic = 0")).count() == len(docs)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 9))
def test_index_search_is_exhaustive(seed, k):
    r = random.Random(seed)
    many = r.choice([12, 400])
    vectors = {i: {f: r.randint(1, 4) for f in r.sample(range(many), r.randint(1, 5))} for i in range(150)}
    idf = np.array([1 + r.random() for _ in range(many)])
    index = toxicity.Index.build(np.arange(150), np.zeros(150, np.int64), [vectors[i] for i in range(150)], idf)
    q = {f: r.randint(1, 3) for f in r.sample(range(many), 3)}
    got = [(int(index.ids[e]), s) for e, s in index.search(q, k)]
    assert got == brute.nearest(q, vectors, idf, k)


def test_index_holds_no_whole_columns_several_times():
    r = np.random.default_rng(5)
    n, each, terms = 6000, 150, 20000
    feature = np.concatenate([np.sort(r.choice(terms, each, replace=False, p=(p := 1 / np.arange(20.0, terms + 20)) / p.sum())) for _ in range(n)]).astype(np.int32)
    count, first = r.integers(1, 9, n * each).astype(np.int32), np.arange(0, n * each + 1, each)
    idf = 1 + np.log((1 + n) / (1 + np.bincount(feature, minlength=terms)))
    index = toxicity.Index(np.arange(n), np.arange(n) % 2, idf, first, feature, count)
    tracemalloc.start()
    weights = index.weights
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * weights.nbytes
    assert np.array_equal(weights, toxicity.unit(np.repeat(np.arange(n), each), feature, count, idf))
    lists = index.lists
    got = {(f, e): w for f in range(terms) for e, w in zip(lists.example[lists.start[f] : lists.start[f + 1]].tolist(), lists.weight[lists.start[f] : lists.start[f + 1]].tolist())}
    whole = lists.matrix.reshape(-1, lists.matrix.shape[2])
    for x, f, e in zip(weights.astype(np.float32).tolist(), feature.tolist(), np.repeat(index.place, each).tolist()):
        assert x == (whole[e, lists.rank[f]] if lists.rank[f] >= 0 else got.pop((f, e)))
    assert not got and lists.rank.max() > 0


def test_ngram_order_puts_repeated_ngrams_last_among_many():
    r = np.random.default_rng(7)
    top = np.iinfo(np.int64).max
    once, often = r.integers(0, top, 6_000_000).astype(np.uint64), r.integers(0, top, 1000).astype(np.uint64)
    low = np.concatenate([once, np.repeat(often, 12)]) & np.uint64((1 << ngram_join.BUCKET_BITS) - 1)
    order = ngram_join.Order(np.bincount(low.astype(np.int64), minlength=1 << ngram_join.BUCKET_BITS))
    assert (order.number(often) > np.quantile(order.number(once), 0.999)).mean() > 0.99


def test_ngram_order_is_that_of_all_counts(spark):
    texts = [" ".join(t) for t in ([f"w{i % 7}", f"w{i % 5}", f"w{i % 3}", f"u{i}"] * 3 for i in range(400))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t) for t in texts)])
    _, grams = ngram_join.sets(data, offsets, 3)
    low = (grams & np.uint64((1 << ngram_join.BUCKET_BITS) - 1)).astype(np.int64)
    want = ngram_join.Order(np.bincount(low, minlength=1 << ngram_join.BUCKET_BITS))
    got = ngram_join._order(ngram_join._statistics(df, 3))
    assert np.array_equal(got.rank, want.rank) and np.array_equal(got.fragment, want.fragment)


@pytest.mark.parametrize("local", [True, False])
def test_index_is_made_in_files_that_processes_map(tmp_path, local):
    r = np.random.default_rng(6)
    n, terms = 3000, 8000
    vectors = [{int(f): int(r.integers(1, 5)) for f in np.minimum(r.zipf(1.2, 60), terms) - 1} for _ in range(n)]
    idf, features = 1 + r.random(terms), np.arange(terms, dtype=np.uint64)
    held = toxicity.Index.build(np.arange(n) * 2, np.arange(n) % 3 == 0, vectors, idf)
    fs = pafs.LocalFileSystem() if local else pafs.SubTreeFileSystem(str(tmp_path), pafs.LocalFileSystem())
    root = f"{tmp_path}/index" if local else "index"
    rows = ((2 * i, int(i % 3 == 0), *(np.array(list(part), np.int32).tobytes() for part in (v, v.values()))) for i, v in enumerate(vectors))
    assert toxicity.make_index(fs, root, rows, features, idf) == (n, n // 3)
    tracemalloc.start()
    index = toxicity.Index.load(fs, root)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    size = sum(p.stat().st_size for p in (tmp_path / "index").iterdir())
    assert peak < size / 10 if local else peak > size / 2
    for q in ({0: 1, 5: 2, 700: 1}, {1: 1}, {7999: 3, 2: 1}):
        assert index.search(q, 9) == held.search(q, 9)


def test_features_are_found_without_a_search_for_each(monkeypatch):
    r = np.random.default_rng(9)
    hashes = np.unique(r.integers(0, np.iinfo(np.uint64).max, 50_000, np.uint64))
    # Also with none, one, and such as share their first bits.
    for known in (hashes[::2], hashes[:0], hashes[:1], hashes[-1:], np.sort(np.concatenate([hashes[::2], hashes[9] + np.arange(1, 2000, 3, np.uint64)]))):
        asked = r.permutation(np.concatenate([hashes, hashes[9] + np.arange(0, 2100, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)]))
        place, number = tokens.Buckets(known)(asked)
        assert np.array_equal(place, np.flatnonzero(np.isin(asked, known))) and np.array_equal(known[number], asked[place])
    searched = []
    search = np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *args, **kw: searched.append(np.size(v) if a is hashes else 0) or search(a, v, *args, **kw))
    assert len(tokens.Buckets(hashes)(hashes)[0]) == len(hashes) and sum(searched) < len(hashes) / 100


def test_documents_meet_few_blocks_that_they_do_not_need(monkeypatch):
    r = np.random.default_rng(11)
    topics, own = 8, 12
    # Of 8 topics in turn, which have no term in common.
    draw = lambda i: {int(x): 1 for x in r.choice(own, 3, replace=False) + own * (i % topics)}
    vectors = [draw(i) for i in range(topics * 320)]
    idf = 1 + r.random(topics * own)
    index = toxicity.Index.build(np.arange(len(vectors)), np.zeros(len(vectors), np.int64), vectors, idf)
    queries = [draw(i) for i in range(384)]
    multiplied, needed = [], []
    sums, promising = toxicity.Lists.common_sums, toxicity.Lists.promising
    monkeypatch.setattr(toxicity.Lists, "common_sums", lambda self, q, blocks: multiplied.append(len(q) * len(blocks)) or sums(self, q, blocks))
    monkeypatch.setattr(toxicity.Lists, "promising", lambda self, *args: (needed.append(len((out := promising(self, *args))[0])), out)[1])
    f, c = (np.array([x for v in queries for x in part(v)], np.int64) for part in (dict.keys, dict.values))
    got = {i: list(zip(near.tolist(), cosine.tolist())) for i, near, cosine in index.searched(np.repeat(np.arange(len(queries)), [len(v) for v in queries]), f, c, 9)}
    assert all(got[i] == brute.nearest(queries[i], dict(enumerate(vectors)), idf, 9) for i in range(0, len(queries), 16))
    assert sum(needed) <= sum(multiplied) < 0.6 * len(queries) * len(index.lists.matrix)


def test_sums_of_lists_take_no_memory_anew(monkeypatch):
    r = np.random.default_rng(12)
    n, terms = 2000, 1000
    vectors = [{int(x): 1 for x in r.choice(terms, 40, replace=False)} for _ in range(n)]
    index = toxicity.Index.build(np.arange(n), np.zeros(n, np.int64), vectors, np.ones(terms))
    lists = index.lists
    asked, weights = np.flatnonzero(lists.rank < 0), r.random(terms)
    postings = int((lists.start[asked + 1] - lists.start[asked]).sum())
    whole = lists.rare(asked, weights[asked])
    tracemalloc.start()
    lists.rare(asked, weights[asked])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert postings > 70_000 and peak < 8 * postings
    want = [sum(weights[f] for f in vectors[e] if lists.rank[f] < 0) / 40**0.5 for e in index.by_place]
    assert np.allclose(whole.ravel()[:n], want)
    # Lists by pieces, of which some are longer than a piece.
    monkeypatch.setattr(toxicity, "PIECE", 60)
    assert np.allclose(lists.rare(asked, weights[asked]), whole)


def test_toxicity_model_is_small_for_a_task(spark):
    docs, labels = labelled()
    df, lab = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), lab)
    assert len(model.index.ids) and len(model.features)
    assert len(pickle.dumps(model)) < 5000
    wordless = df.withColumn("text", F.lit("- -"))
    assert toxicity.score_documents(wordless, lab).filter("vote is null and score is not null").count() == len(docs)


def test_isotonic():
    steps, scores = toxicity.isotonic([(0.1, 0), (0.2, 1), (0.3, 0), (0.9, 1), (0.9, 1)])
    assert steps == sorted(steps) and scores == sorted(scores) and scores[-1] > 0.8


# --- Empty tables -------------------------------------------------------------------


def test_empty_tables(spark, docs, tmp_path):
    none = docs.limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    made = [lm_score.score_documents(none), decontaminate.contaminated(none, bench), decontaminate.contaminated(docs, bench), decontaminate.decontaminate(none, bench), suffix_dedup.repeated_spans(none), toxicity.score_documents(none, lab), toxicity.reject_toxic(none, lab), winnow.fingerprints(none), line_dedup.dedup(none), ngram_join.near_duplicates(none), ngram_join.keep_one(none), mixing.mixed_documents(none)]
    assert [d.count() for d in made] == [0] * len(made)
    versions = secret_scan.versions_of(none)
    secret_scan.scan_increment(versions, str(tmp_path / "l"))
    assert secret_scan.findings(versions, str(tmp_path / "l")).count() == 0


def test_columns_named_as_ours(docs):
    clash = docs.select("doc_id", "text", *[F.lit(1).alias(c) for c in ("_n_lines", "_n_dropped", "line", "shard", "row", "words", "_doc", "fragment", "part", "h")])
    assert line_dedup.dedup(clash, 3, 10).count() == len(awkward())
    assert suffix_dedup.repeated_spans(clash, 6).count() and ngram_join.near_duplicates(clash).count() and lm_score.score_documents(clash).count() == len(awkward())


# --- Faults of the past ------------------------------------------------------------


def test_rules_keep_the_case_of_paths(spark):
    pages = spark.createDataFrame([(1, "http://example.org/About/x"), (2, "http://example.org/about/x"), (3, "http://EXAMPLE.org/About")], "page_id long, url string")
    rules = spark.createDataFrame([(1, "Example.org/About", "block")], "rule_id long, pattern string, action string")
    assert dict(url_filter.filter_urls(pages, rules).select("page_id", "action").collect()) == {1: "block", 2: "allow", 3: "block"}


def test_upper_case_beyond_ascii_is_one_text_in_all_paths(spark):
    item = "ΠΟΙΑ ΕΙΝΑΙ Η ΠΡΩΤΕΥΟΥΣΑ ΤΗΣ ΧΩΡΑΣ ΑΥΤΗΣ ΣΗΜΕΡΑ; ΕΙΝΑΙ Η ΑΘΗΝΑ ΚΑΙ Ο ΠΕΙΡΑΙΑΣ"
    docs = spark.createDataFrame([(1, item, "el", "s", 1), (2, "İ " + item.title() + " ß", "el", "s", 1), (3, "ΑΛΛΟ ΚΕΙΜΕΝΟ", "el", "s", 1)], SCHEMA)
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    found = {r["doc_id"] for r in decontaminate.contaminated(docs, bench).collect()}
    assert {1} <= found and {r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()} == {1, 2, 3} - found
    labels = spark.createDataFrame([(1, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    toxic = {r["doc_id"] for r in toxicity.score_documents(docs, labels).filter("toxic").collect()}
    assert {r["doc_id"] for r in toxicity.reject_toxic(docs, labels).collect()} == {1, 2, 3} - toxic


@pytest.mark.parametrize("shards", [1, 40])
def test_saturated_counts_below_a_greater_least_count(spark, shards):
    rows = [(i, "the very same line") for i in range(270)] + [(900, "a line of its own")]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), 300, 5, shards=shards).collect()
    assert ordered(got) == ordered(brute.line_dedup(rows, 300, 5))


def test_weights_of_zero(docs):
    kept = mixing.mixed_documents(docs, weights={}, default_weight=0).collect()
    assert all(not (r["text"] or "").strip() for r in kept)
