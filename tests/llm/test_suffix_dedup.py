import random

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trackloom.llm import suffix_dedup
from trackloom.llm.deep_shallow import common_prefix, sort_strings, with_prefixes
from trackloom.llm.queries import op7_suffix_dedup


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", max_size=60).map(str.encode), max_size=30), st.integers(0, 40))
def test_sorting(strings, shallow):
    assert [strings[i] for i in sort_strings(strings, shallow)] == sorted(strings)
    order, lcp = with_prefixes(strings)
    assert sorted(order) == list(range(len(strings)))
    assert lcp[1:] == [common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:])]


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 5)))
    passages = [" ".join(word() for _ in range(12)) for _ in range(4)]
    docs = []
    for _ in range(30):
        parts = [" ".join(word() for _ in range(rng.randint(0, 12)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 10)
            parts += [p[a:], " ".join(word() for _ in range(rng.randint(0, 6)))]
        docs.append("".join(parts))
    return [*docs, None, "", docs[0], docs[1], "aaaa" * 30, "ab" * 100, "short"]


@pytest.mark.parametrize("seed,many,group", [(1, 512, 1 << 15), (2, 1, 1 << 15), (3, 1, 1), (4, 3, 2), (5, 1, 5)])
def test_against_brute_force(spark, seed, many, group):
    texts = made(seed)
    df = spark.createDataFrame([(i if i != 5 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, doc string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, length=20, size=8, many=many, group=group).collect()}
    data = [(t or "").encode() for t in texts]
    want = {i if i != 5 else None: (len(t), *r) for i, (t, r) in enumerate(zip(data, brute.repeats(data, 20)))}
    assert got == want


def test_rows_that_repeat_whole(spark):
    df = spark.createDataFrame([(1, "abcdefghij" * 5), (1, "abcdefghij" * 5), (2, "z" * 19)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(df, length=20, size=8).collect())
    assert got == [(1, 50, 1), (1, 50, 1), (2, 0, 0)]


def test_empty(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    data = [(r.text or "").encode() for r in docs]
    want = {r.doc_id: (len(t), *b) for r, t, b in zip(docs, data, brute.repeats(data, 200))}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op7_suffix_dedup(spark, sf_dir).collect()} == want
