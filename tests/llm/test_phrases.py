"""Repeated passages of words against a plain version."""

import hashlib
import random

import brute
import pytest

from trackloom.llm import phrases
from trackloom.llm.queries import op11_phrases


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 3)))
    passages = [[word() for _ in range(14)] for _ in range(5)]
    docs = []
    for _ in range(60):
        parts = [word() for _ in range(rng.randint(0, 10))]
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, 8)
            parts += p[a : rng.randint(a, 14)] + [word() for _ in range(rng.randint(0, 4))]
        docs.append(rng.choice([" ", "\t ", "\n", "  "]).join(parts))
    return [*docs, None, "", docs[0], docs[1], "aa " * 40, "ab b " * 30, "short", " \n\t"]


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.mark.parametrize(
    "seed,options", [(1, {}), (2, {"wide": 0, "block_bytes": 200}), (3, {"shard": 3, "block_bytes": 500}), (4, {"wide": 1, "shard": 1}), (5, {"block_bytes": 1})]
)
def test_against_brute_force(spark, seed, options):
    texts = made(seed)
    ids = [i if i != 5 else None for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in zip(ids, texts)], "doc_id long, text string, a string, n_words string")
    got = {}
    for r in phrases.remove_phrases(df, length=6, size=3, texts=True, **options).collect():
        got[r.doc_id] = r.n_words, r.n_removed, r.clean_text
        assert r.kept_sha256 == digest(r.clean_text)
        assert sum(s.end - s.start for s in r.spans or []) == r.n_removed
    assert got == dict(zip(ids, brute.phrases(texts, 6)))


def test_a_length_without_divisors(spark):
    texts = made(7)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in phrases.remove_phrases(df, length=7, size=4).collect()}
    assert got == {i: w[:2] for i, w in enumerate(brute.phrases(texts, 7))}


def test_rows_that_repeat_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c"), (2, "a b c")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in phrases.remove_phrases(df, length=6, size=3).collect())
    assert got == [(1, 7, 7), (1, 7, 7), (2, 3, 0), (2, 3, 0)]
    assert phrases.remove_phrases(df.limit(0)).count() == 0


def test_hot_passage_among_many_contexts(spark):
    """One passage in every text, whose windows differ at the edges; and a text of 60,000 words that holds it often."""
    rng = random.Random(3)
    hot = [f"h{i}" for i in range(40)]
    texts = [" ".join([f"w{rng.randrange(30)}" for _ in range(rng.randint(0, 40))] + hot + [f"v{rng.randrange(30)}" for _ in range(30)]) for _ in range(200)]
    texts.append(" ".join(w for i in range(600) for w in [*hot, *(f"u{i}-{k}" for k in range(60))]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in phrases.remove_phrases(df, block_bytes=20_000, shard=50).collect()}
    assert got == {i: (n, k, digest(t)) for i, (n, k, t) in enumerate(brute.phrases(texts, 35))}


def test_automata_find_windows_only():
    words = [b"w%d" % i for i in range(200)]
    text = phrases.Spelling(words, 35)
    machine, known = phrases.automaton({int(text.window[s]): text.spelled(s) for s in (0, 17, 18, 165)})
    assert sorted(phrases.occurrences(machine, known, text).tolist()) == [0, 17, 18, 165]
    assert len(phrases.occurrences(machine, known, phrases.Spelling(words[::-1], 35))) == 0


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = {r.doc_id: (n, k, digest(t)) for r, (n, k, t) in zip(docs, brute.phrases([r.text for r in docs], 35))}
    assert any(w[1] for w in want.values())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op11_phrases(spark, sf_dir).collect()} == want
