"""The corpus operators again in plain Python, without an index, a hash or a bound."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

SPACES = re.compile(r"[ \t\n\r\x0b\x0c]+")


def words(text: str | None) -> list[str]:
    """Lower-cased runs of ASCII letters, digits, ``_`` and all that is not ASCII."""
    return re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (text or "").lower())


def line_dedup(docs: list[tuple], min_count: int, min_chars: int) -> list[tuple]:
    """(doc_id, text, n_lines, n_dropped) of rows (doc_id, text)."""
    n, owner = Counter(), {}
    key = lambda d: math.inf if d is None else d
    for d, text in docs:
        for line in (text or "").split("\n") if text else []:
            k = line.strip(" \t")
            if len(k) >= min_chars:
                n[k] += 1
                owner[k] = min(owner.get(k, math.inf), key(d))
    out = []
    for d, text in docs:
        if not text:
            out.append((d, text, 0, 0))
            continue
        seen, kept, lines = set(), [], text.split("\n")
        for line in lines:
            k = line.strip(" \t")
            if n[k] >= min_count and not (owner[k] == key(d) and k not in seen):
                continue
            seen.add(k)
            kept.append(line)
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def gram_set(text: str | None, n: int) -> frozenset:
    w = words(text)
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])


def near_groups(docs: list[tuple], n: int, t: tuple[int, int]) -> dict[int, int]:
    """doc_id to group, for documents that have a near duplicate."""
    sets = {d: s for d, text in docs if d is not None and (s := gram_set(text, n))}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b])) >= Fraction(*t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    sizes = Counter(root(d) for d in ids)
    return {d: root(d) for d in ids if sizes[root(d)] > 1}


def near_pairs(docs: list[tuple], n: int, t: tuple[int, int]) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(a, b) to overlap and sizes, of classes of equal sets."""
    least: dict[frozenset, int] = {}
    for d, text in docs:
        if d is not None and (s := gram_set(text, n)):
            least[s] = min(d, least.get(s, d))
    out = {}
    for x, a in least.items():
        for y, b in least.items():
            if a < b and Fraction(len(x & y), len(x | y)) >= Fraction(*t):
                out[a, b] = (len(x & y), len(x), len(y))
    return out


def near_links(docs: list[tuple], n: int, t: tuple[int, int], grouped: dict[int, int]) -> dict[int, int]:
    """doc_id to the number of other classes that its own is linked with."""
    ends = Counter(x for pair in near_pairs(docs, n, t) for x in pair)
    least: dict[frozenset, int] = {}
    own = {d: gram_set(text, n) for d, text in docs if d is not None}
    for d, s in own.items():
        least[s] = min(d, least.get(s, d))
    return {d: ends[least[own[d]]] for d in grouped}


def bm25_matches(docs: list[tuple], items: list[tuple], segment: int, threshold: float, least: float, gram: int, k1: float, b: float) -> list[tuple]:
    """(doc_id, item_id, score rounded) of rows (doc_id, text), each passage against each entry."""
    from geoloom.llm.decontaminate import split_item

    texts = {}
    for i, text in items:
        if i is not None and text is not None:
            texts[i] = min(text, texts.get(i, text))
    entries = [(i, w[k : k + segment]) for i, text in texts.items() for w in [words(text)] for k in range(0, len(w), segment)]
    df = Counter(w for _, e in entries for w in set(e))
    average = sum(len(e) for _, e in entries) / max(1, len(entries))
    idf = {w: math.log(1 + (len(entries) - n + 0.5) / (n + 0.5)) for w, n in df.items()}

    def impact(e):
        scale = k1 * (1 - b + b * len(e) / average)
        return {w: idf[w] * n * (k1 + 1) / (n + scale) for w, n in Counter(e).items()}

    scored = [(i, x, sum(x.values())) for i, e in entries for x in [impact(e)]]
    out = []
    for d, text in docs:
        w = words(text)
        starts = range(0, max(1, -(-(len(w) - segment) // segment)) * segment, segment) if w else []
        best: dict[int, float] = {}
        for p in starts:
            have = set(w[p : p + 2 * segment])
            for i, x, own in scored:
                s = sum(v for k, v in x.items() if k in have) / own
                if s >= threshold - 1e-9:
                    best[i] = max(best.get(i, 0.0), s)
        for i, s in best.items():
            whole = words(texts[i])
            parts = split_item(texts[i])
            q, a = map(words, parts) if parts else (whole[: len(whole) - len(whole) // 4], whole[len(whole) - len(whole) // 4 :])

            def overlap(part):
                n = min(gram, len(part))
                grams = [tuple(part[j : j + n]) for j in range(len(part) - n + 1)] if n else []
                own = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else set()
                return sum(g in own for g in grams) / len(grams) if grams else 1.0

            if overlap(q) >= least and overlap(a) >= least:
                out.append((d, i, round(s, 6)))
    return sorted(out, key=str)


def mixed(docs: list[tuple], weights: dict, default: int, fraction: tuple[int, int], tiers: tuple) -> list[tuple]:
    """(doc_id, source, n_tokens, tier) of rows (doc_id, text, source) that stay."""
    rows = [(d, s, len([w for w in SPACES.split(t or "") if w]), int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:15], 16)) for d, t, s in docs]
    supply = Counter()
    for _, s, n, _ in rows:
        supply[s] += n
    weight = {s: weights.get(s, default) if s is not None else default for s in supply}
    total = sum(supply.values())
    out = []
    for s in supply:
        at = defaultdict(int)
        for _, s2, n, h in rows:
            if s2 == s:
                at[h] += n
        budgets = [min(supply[s], weight[s] * (total * fraction[0] // fraction[1]) // sum(weight.values()) * n // d) for n, d in tiers]
        upto, tier_of = 0, {}
        for h in sorted(at):
            upto += at[h]
            good = [i + 1 for i, b in enumerate(budgets) if upto <= b]
            if good:
                tier_of[h] = good[0]
        out += [(d, s, n, tier_of[h]) for d, s2, n, h in rows if s2 == s and h in tier_of]
    return sorted(out, key=str)


def winnow(text: str | None, k: int, window: int, base: int, prime: int) -> list[tuple[int, int]]:
    s = [ord(c) for c in (text or "").lower() if c.isalnum()]
    h = []
    for i in range(len(s) - k + 1):
        x = 0
        for c in s[i : i + k]:
            x = (x * base + c) % prime
        h.append(x)
    out = set()
    for i in range(max(1, len(h) - window + 1) if h else 0):
        part = h[i : i + window]
        j = max(j for j, x in enumerate(part) if x == min(part))
        out.add((i + j, part[j]))
    return sorted(out)


def spans(docs: list[tuple], length: int) -> list[tuple]:
    """(doc_id, start, end, n) of the passages that two doc_ids share."""
    texts = [(d, [w for w in SPACES.split(t) if w]) for d, t in docs if d is not None and t is not None]
    owners = defaultdict(set)
    for d, w in texts:
        for i in range(len(w) - length + 1):
            owners[tuple(w[i : i + length])].add(d)
    found = defaultdict(set)
    for d, w in texts:
        found[d] |= {i for i in range(len(w) - length + 1) if len(owners[tuple(w[i : i + length])]) > 1}
    out = []
    for d, at in found.items():
        cur = None
        for i in sorted(at):
            if cur and i <= cur[1]:
                cur[1] = i + length
            else:
                cur = [i, i + length]
                out.append((d, cur))
    return sorted((d, a, b, b - a) for d, (a, b) in out)


def lattice(text: str, score: dict[str, float], spelled) -> float:
    """log of the sum over all segmentations, one by one."""

    def every(rest: str):
        if not rest:
            yield 0.0
        for n in range(1, len(rest) + 1):
            if rest[:n] in score:
                for x in every(rest[n:]):
                    yield score[rest[:n]] + x
        if rest and rest[0] not in score:
            for x in every(rest[1:]):
                yield spelled(rest[0]) + x

    return math.log(math.fsum(map(math.exp, every(text))))


def nearest(counts: dict, vectors: dict[int, dict], idf, k: int, own=None) -> list[tuple[int, float]]:
    """(doc_id, cosine) of the k nearest examples, by all dot products."""

    def unit(c):
        w = {f: (1 + math.log(n)) * float(idf[f]) for f, n in c.items()}
        length = math.sqrt(sum(x * x for x in w.values()))
        return {f: x / length for f, x in w.items()}

    q = unit(counts)
    found = []
    for d, c in vectors.items():
        if d != own and set(c) & set(q):
            u = unit(c)
            found.append((-round(sum(x * u.get(f, 0.0) for f, x in q.items()), 9), d))
    return [(d, -s) for s, d in sorted(found)[:k]]


def toxicity(docs: list[tuple], labels: list[tuple], k: int, near: float, threshold: float) -> list[tuple]:
    """(doc_id, score, vote, toxic, neighbours, similarities) of rows (doc_id, text) by labels (doc_id, toxic): no index, all dot products."""
    label: dict[int, int] = {}
    for d, y in labels:
        if d is not None and y is not None:
            label[d] = max(y, label.get(d, 0))
    texts: dict[int, list] = defaultdict(list)
    for d, t in docs:
        if d in label:
            texts[d] += [t] if t is not None else []
    if not texts:
        return [(d, None, None, False, [], []) for d, _ in docs]
    example = {d: Counter(words(min(t))) if t else Counter() for d, t in texts.items()}
    bad, size = sum(label[d] for d in example), len(example)
    n, a = Counter(), Counter()
    for d, c in example.items():
        n.update(c.keys())
        a.update(c.keys() if label[d] else [])
    df = Counter(w for _, t in docs for w in set(words(t)) if w in n)
    p = bad / size

    def factor(w):
        if not 0 < bad < size or a[w] <= n[w] * p:
            return 1.0
        g = a[w] * math.log(a[w] / (n[w] * p)) + ((n[w] - a[w]) * math.log((n[w] - a[w]) / (n[w] * (1 - p))) if n[w] > a[w] else 0.0)
        return max(1.0, g * g / math.log(max(3, len(n))))

    weight = {w: (1 + math.log((1 + len(docs)) / (1 + df[w]))) * factor(w) for w in n}
    indexed = {d: c for d, c in example.items() if c}

    def vote(c, own):
        found = nearest({w: x for w, x in c.items() if w in n}, indexed, weight, k, own)
        if not found:
            return None, [], []
        ws = [1 / (near + max(0.0, 1 - s)) for _, s in found]
        return sum(x * label[d] for x, (d, _) in zip(ws, found)) / sum(ws), [d for d, _ in found], [s for _, s in found]

    fitted = sorted((v, label[d]) for d, c in indexed.items() if (v := vote(c, d)[0]) is not None)
    points = sorted({v for v, _ in fitted})
    ys = [[y for v, y in fitted if v == x] for x in points]
    # Isotonic regression as the greatest of least means.
    mean = lambda i, j: Fraction(sum(sum(y) for y in ys[i : j + 1]), sum(len(y) for y in ys[i : j + 1]))
    level = [max(min(mean(i, j) for j in range(m, len(ys))) for i in range(m + 1)) for m in range(len(ys))]
    share = (bad + 0.5) / (size + 1)
    without = (bad - sum(label[d] for d in indexed) + share) / (size - len(indexed) + 1)

    def score(v):
        if v is None or not points:
            return without
        pool = level[max([m for m, x in enumerate(points) if x <= v + 1e-12], default=0)]
        inside = [y for m, l in enumerate(level) if l == pool for y in ys[m]]
        return (sum(inside) + 0.5) / (len(inside) + 1)

    out = []
    for d, t in docs:
        v, ids, sims = vote(Counter(words(t)), d)
        out.append((d, score(v), v, score(v) >= threshold, ids, sims))
    return out
