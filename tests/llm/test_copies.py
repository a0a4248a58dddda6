"""The stage of near copies: long SimHash fingerprints of five-word shingles, one row of each group stays."""

import math
import random
import time
from collections import Counter

import corpus_pipeline
import numpy as np
import pandas as pd
import pytest

from trackloom.llm import simhash


def grams(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def jaccard(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def cosine(a, b):
    return 1.0 if a == b else len(a & b) / math.sqrt(max(1, len(a) * len(b)))


def changed(rng, words, n):
    own = list(words)
    for i in rng.sample(range(len(own)), n):
        own[i] = f"other{rng.randrange(10**9)}"
    return own


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def check(docs, kept):
    """Every pair far above the threshold has lost its larger id, and nothing is lost that is like no other text."""
    sets = {i: grams(t) for i, t in docs}
    assert set(kept) <= set(sets) and max(Counter(kept).values()) == 1
    for a, x in sets.items():
        others = [b for b in sets if b != a]
        if any(b < a and jaccard(x, sets[b]) >= 0.8 for b in others):
            assert a not in kept, a
        if a not in kept:
            assert max(cosine(x, sets[b]) for b in others) > 0.7, a


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies(spark, seed):
    """Copies of each similarity, chains of copies of copies, and short texts."""
    rng = random.Random(seed)
    docs = []
    for _ in range(14):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randint(40, 300))]
        for _ in range(rng.randint(1, 6)):
            docs.append((len(docs), " ".join(words)))
            words = changed(rng, words, rng.randint(0, max(1, len(words) // 50)))
    docs += [(1000 + i, t) for i, t in enumerate([None, "", " \n", "one", "one two", "one two", "a b c d e", "be " * 200, "be " * 300, "long " * 3 + " ".join(f"x{i}" for i in range(30_000))])]
    rng.shuffle(docs)
    kept = [r.doc_id for r in simhash.keep_one(frame(spark, docs)).collect()]
    check(docs, kept)
    assert {1000, 1003, 1004, 1006, 1007, 1009} <= set(kept) and not {1001, 1002, 1005, 1008} & set(kept)


def test_repeated_phrase(spark):
    """A phrase that repeats is one shingle, so texts that share only that are not alike."""
    rng = random.Random(3)
    docs = [(i, " ".join(f"v{rng.randrange(900)}" for _ in range(60)) + " be" * 400) for i in range(6)]
    assert simhash.keep_one(frame(spark, docs)).count() == 6


def test_pipeline_stage(spark, sf_dir):
    """300 words with 3 or 6 of them changed: similarities from 0.8 to 0.95, far more than 3 bits of SimHash."""
    rng = random.Random(5)
    docs = []
    for i in range(20):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        docs += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(changed(rng, words, 3))), (3 * i + 2, " ".join(changed(rng, words, 6)))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t), 5, "x") for i, t in docs], "doc_id long, text string, lang string, source string, n_chars int, key int, w0 string")
    got = corpus_pipeline.dedup_stage(spark, df, sf_dir)
    assert got.schema.names == list(corpus_pipeline.COLUMNS)
    assert sorted(r.doc_id for r in got.collect()) == list(range(0, 60, 3))


def test_rows_are_told_apart(spark):
    """Another text under an id stays; rows that repeat are cut to one; ids that are null come last."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    docs = [(3, a), (5, c), (5, b), (7, a + " end"), (7, b), (7, b), (8, b.upper()), (None, a), (None, "x y z"), (None, "x y z")]
    got = simhash.keep_one(spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, node int, _a int"))
    assert got.columns == ["doc_id", "text", "node", "_a"]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(3, a), (5, b), (5, c), (None, "x y z")], key=str)


def test_nothing(spark):
    assert simhash.keep_one(frame(spark, [])).count() == 0


def close_groups(w, distance):
    n = w.shape[1]
    at = list(range(n))
    for i in range(n):
        for j in range(i):
            if np.bitwise_count(w[:, i] ^ w[:, j]).sum() <= distance and at[i] != at[j]:
                at = [at[j] if x == at[i] else x for x in at]
    return {frozenset(i for i in range(n) if at[i] == g) for g in set(at)}


@pytest.mark.parametrize("n,keys", [(60, 20), (200, 2), (150, 1)])
def test_links_of_blocks(n, keys):
    """In blocks of any size, links connect just what is close; 60 of 256 bits apart from a centre are chains at times."""
    rng = np.random.default_rng(n)
    w = rng.integers(0, 1 << 63, (4, 3), np.uint64)[:, rng.integers(0, 3, n)]
    for i in range(n):
        for bit in rng.choice(256, 30, replace=False):
            w[bit // 64, i] ^= np.uint64(1 << int(bit % 64))
    key = np.sort(rng.integers(0, keys, n))
    u, v = simhash._links_of(key, w, 52)
    assert (key[u] == key[v]).all() and len(u) < n
    for k in set(key.tolist()):
        own = np.flatnonzero(key == k)
        at = {int(i): int(i) for i in own}
        for a, b in zip(u.tolist(), v.tolist()):
            if a in at:
                one, other = at[a], at[b]
                at = {i: other if g == one else g for i, g in at.items()}
        got = {frozenset(i for i in at if at[i] == g) for g in set(at.values())}
        assert got == {frozenset(int(own[i]) for i in g) for g in close_groups(w[:, own], 52)}


def test_block_plan():
    assert simhash.block_plan(0) == simhash.block_plan(4_000_000) == (16, 62) and simhash.block_plan(1 << 30)[0] == 24
    assert simhash.most_apart() == 52


def group_frame(spark, rng, n, spread, others):
    """Distinct fingerprints in one block: a dense group around one centre, chains that lead away from it, and unrelated ones."""
    centre = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    rows = [centre]
    for _ in range(n):
        w = centre.copy()
        for bit in rng.choice(256, rng.integers(1, spread), replace=False):
            w[bit // 64] ^= np.uint64(1 << int(bit % 64))
        rows.append(w)
    chain = centre.copy()
    for k in range(12):
        for bit in range(20 * k, 20 * k + 20):
            chain[bit // 64] ^= np.uint64(1 << int(bit % 64))
        rows.append(chain.copy())
    rows += [rng.integers(0, 1 << 63, 4, dtype=np.uint64) for _ in range(others)]
    # rows are told apart by their first two words
    rows = np.array(rows).view(np.int64)
    rows = rows[np.unique(rows[:, :2], axis=0, return_index=True)[1]]
    frame = pd.DataFrame(rows, columns=["w0", "w1", "w2", "w3"])
    frame.insert(0, "key", 7)
    return rows.view(np.uint64).T, spark.createDataFrame(frame)


def grouped(spark, df, distance, large):
    left, links = simhash.thinned(df, distance, large)
    rest = left.repartition("key").sortWithinPartitions("key").mapInArrow(simhash._wide_links(distance), simhash._LINK)
    pairs = [tuple(r) for x in [rest, *links] for r in x.collect()]
    root = {}

    def top(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b, c, d in pairs:
        if top((a, b)) != top((c, d)):
            root[top((a, b))] = top((c, d))
    out = {}
    for r in df.select("w0", "w1").collect():
        out.setdefault(top((r.w0, r.w1)), set()).add((r.w0, r.w1))
    return {frozenset(x) for x in out.values()}, left.count()


@pytest.mark.parametrize("seed,n,spread,others", [(1, 150, 20, 40), (2, 80, 60, 20), (3, 0, 2, 120)])
def test_large_blocks_lose_no_link(spark, seed, n, spread, others):
    """The same groups on both sides of the switch, whatever is thought large."""
    w, df = group_frame(spark, np.random.default_rng(seed), n, spread, others)
    signed = w.view(np.int64)
    want = {frozenset((int(signed[0, i]), int(signed[1, i])) for i in g) for g in close_groups(w, 52)}
    for large in (10_000, 60, 5):
        assert grouped(spark, df, 52, large)[0] == want


def test_a_block_of_100_000(spark):
    """A dense group of more than 100,000 distinct fingerprints leaves its block before that meets in one task."""
    rng = np.random.default_rng(5)
    w, df = group_frame(spark, rng, 180_000, 12, 30)
    assert w.shape[1] > 100_000
    at = time.time()
    got, left = grouped(spark, df.repartition(8).cache(), 52, 4096)
    assert time.time() - at < 120 and left < 4096
    assert max(map(len, got)) >= w.shape[1] - 50
