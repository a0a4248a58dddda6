"""Plain, slow versions of the corpus operators, to test against."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), seed=42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    """The smallest node that each node reaches, by looking at all pairs."""
    nodes, at = sorted(set(nodes)), {}
    for n in nodes:
        if n in at:
            continue
        at[n], wave = n, [n]
        while wave:
            x = wave.pop()
            for y in nodes:
                if y not in at and linked(x, y):
                    at[y] = n
                    wave.append(y)
    return at


def near_duplicates(docs):
    """``docs``: (id, text). A Counter of (id, fingerprint, component)."""
    prints = [(i, fingerprint(t)) for i, t in docs]
    of = components([f for _, f in prints], lambda a, b: (a ^ b).bit_count() <= 3)
    least = defaultdict(list)
    for i, f in prints:
        if i is not None:
            least[of[f]].append(i)
    return Counter((i, f"{f:016x}", min(least[of[f]], default=None)) for i, f in prints)


def repeats(texts, length):
    """For each text (bytes): n_removed, n_spans, digest of what stays."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def words_ascii(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(docs, items, size=13):
    """Per document: (id, n_words, n_hit, sorted item ids, contaminated)."""
    windows = defaultdict(set)
    for i, text in items:
        w = words_ascii(text)
        for s in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[s : s + size])].add(str(i))
    lens = {len(w) for w in windows}
    out = []
    for i, text in docs:
        w, hit, found = words_ascii(text), set(), set()
        for n in lens:
            for s in range(len(w) - n + 1):
                got = windows.get(tuple(w[s : s + n]))
                if got:
                    hit.update(range(s, s + n))
                    found |= got
        out.append((i, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def jump(key, n):
    """Jump consistent hashing as published, on unsigned 64-bit integers."""
    key, b, j = key % (1 << 64), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """``sizes``: (source, size) in order. Targets by sharing the excess again until none is above its cut."""
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(sizes)}
    cut = {s: most * n for s, n in sizes}
    full, goal = set(), share * sum(n for _, n in sizes)
    while True:
        rest = goal - sum(cut[s] for s in full)
        free = [s for s, _ in sizes if s not in full]
        level = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > cut[s]}
        if not over:
            return {s: cut[s] if s in full else level * weight[s] for s, _ in sizes}
        full |= over


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def spark_hash(*values):
    """Spark's xxhash64 of longs (int), ints (given as numpy int32) and strings; null leaves the seed as it is."""
    seed = 42
    for v in values:
        if v is None:
            continue
        data = v.encode() if isinstance(v, str) else int(v).to_bytes(8 if type(v) is int else 4, "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed=seed)
    return signed(seed)


def mix(docs, most=2.0, share=1.5, seed=20):
    """``docs``: (id, text, source). A list of (id, source, size, taken): the sampling replayed row by row."""
    sizes = Counter()
    rows = []
    for i, text, source in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] += n
        one = np.int32(seed)
        h = spark_hash(i, text, one)
        kind = n if n < 8 else (n.bit_length() - 4) * 8 + (n >> (n.bit_length() - 4))
        rows.append((source, kind, h % 256, n, h, spark_hash(one, text, np.int32(0)), i is not None, i or 0, i))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = targets([(s, sizes[s]) for s in order], share=share, most=most)
    out = []
    for source in order:
        rate = want[source] / sizes[source] if sizes[source] else 0.0
        offset = spark_hash(np.int32(seed), source) % (1 << 20) / (1 << 20)
        for k, r in enumerate(sorted((r[1:] for r in rows if r[0] == source))):
            copies = math.floor((k + 1) * rate + offset) - math.floor(k * rate + offset)
            out.append((r[-1], source, r[2], copies * r[2]))
    return out


def fold(events):
    """``events``: (seq, kind, target, role, text) of one conversation. Its final messages, one event after another."""
    none_first = lambda x: (x is not None, x if x is not None else 0)
    done = []
    for _, kind, target, role, text in sorted(events, key=lambda e: (none_first(e[0]), none_first(e[2]), e[3] or "", e[4] or "", (e[1] is not None, e[1] or ""))):
        role, text = role or "", text or ""
        there = target is not None and 0 <= target < len(done)
        if kind == "message" or kind == "delta" and not done:
            done.append((role, text))
        elif kind == "delta":
            done[-1] = (done[-1][0], done[-1][1] + text)
        elif kind in ("edit", "regenerate") and there:
            done[target] = (done[target][0], text)
            if kind == "regenerate":
                del done[target + 1 :]
    return done


def phrases(texts, length):
    """For each text: n_words, n_removed, the kept words joined by spaces."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def whitened(vectors, k=16):
    """``vectors``: rows of longs. n, S, the components' signed projections by row, shares, all in plain numpy."""
    fit = np.array(sorted(set(map(tuple, vectors))), dtype=np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    c = fit - sums / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)[:k]
    w = (np.array(vectors) - sums / n) @ axes[:, order] / np.sqrt(values[order])
    deviation = [sum((n * int(x) - int(s)) ** 2 for x, s in zip(v, sums)) for v in vectors]
    return n, deviation, w, values[order] / values.sum()


def audit(rows):
    """``rows``: (part, set of letters that fail, good, toxic). One tuple for each part, order and step, by replaying every order."""
    from itertools import permutations

    out = []
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        made, sums = [], Counter()
        for order in permutations("ABCDE"):
            alive = own
            for step, f in enumerate(order, 1):
                removed = [r for r in alive if f in r[1]]
                alive = [r for r in alive if f not in r[1]]
                failing = sum(f in r[1] for r in own)
                alone = sum(r[1] == {f} for r in own)
                sums[f] += len(removed)
                made.append((part, "".join(order), step, len(alive), len(removed), failing - len(removed), alone, sum(r[2] for r in removed), sum(r[3] for r in removed), f))
        out += [(*m[:-1], sums[m[-1]]) for m in made]
    return Counter(out)
