"""Tiled covariance and whitening against plain numpy."""

import math
import random

import brute
import numpy as np
import pytest

from trackloom.llm import whitening
from trackloom.llm.queries import op12_whitening


def check(rows, vectors, ids):
    """``rows``: result rows; ``vectors``: the whole-number vectors of those that take part, with their ids."""
    n, deviation, w, shares = brute.whitened(vectors)
    k = w.shape[1]
    got = {}
    for r in rows:
        assert r.n == n and r.identity_error <= 1e-9
        got.setdefault(r.vec_id, {})[r.component] = r
    signs = np.sign([got[ids[0]][c].whitened * w[0, c - 1] for c in range(1, k + 1)])
    for i, one in enumerate(ids):
        assert sorted(got[one]) == list(range(1, k + 1))
        for c, r in got[one].items():
            assert r.deviation == deviation[i]
            assert math.isclose(r.whitened * signs[c - 1], w[i, c - 1], rel_tol=1e-7, abs_tol=1e-7)
            assert math.isclose(r.explained, shares[c - 1], rel_tol=1e-9)


@pytest.mark.parametrize("d,tile,block_rows", [(5, 2, 7), (20, 8, 1000), (33, 32, 64), (3, 32, 1)])
def test_against_numpy(spark, d, tile, block_rows):
    rng = np.random.default_rng(d)
    x = rng.normal(size=(150, d)) @ rng.normal(size=(d, d))
    x[10:60] = x[0]  # one vector has a third of the rows
    df = spark.createDataFrame([(i, [float(np.float32(c)) for c in row], "k", 1) for i, row in enumerate(x)], "vec_id long, embedding array<float>, n string, x int")
    rows = whitening.whiten(df, tile=tile, block_rows=block_rows).collect()
    vectors = [tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in row) for row in x]
    check(rows, vectors, list(range(150)))


def test_what_takes_no_part(spark):
    rng = random.Random(4)
    good = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(40)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, math.nan, 2.0]), (103, [math.inf, 0.0, 0.0]), (104, []), (105, [1.0, 2.0]), (106, [1e30, 0.0, 0.0]), (None, [0.5, 0.5, 0.5])]
    rows = whitening.whiten(spark.createDataFrame(good + bad, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id for r in rows} == {None, *range(40)}
    own = [*good, bad[-1]]
    check(rows, [tuple(math.floor(64 * c) + 1_000_000 for c in v) for _, v in own], [i for i, _ in own])


def test_degenerate(spark):
    """Equal vectors have no spread at all; two distinct ones have one direction of it."""
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], "vec_id long, embedding array<double>")
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in whitening.whiten(same).collect()} == {(1, 0, None, None, 0.0)}
    two = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 2.0])], "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.component): r for r in whitening.whiten(two).collect()}
    assert abs(abs(got[0, 1].whitened) - 1) < 1e-9 and got[0, 2].whitened is None and got[0, 1].explained == 1.0
    for empty in (same.limit(0), same.selectExpr("vec_id", "cast(null as array<double>) as embedding")):
        assert whitening.whiten(empty).count() == 0


def test_large_deviations_are_exact_or_an_error(spark):
    far = [(0, [1e9, 0.0]), (1, [-1e9, 0.0])]
    df = spark.createDataFrame(far, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="leaves the range of a long"):
        whitening.whiten(df).collect()
    near = spark.createDataFrame([(0, [1e7, 0.0]), (1, [-1e7, 0.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(near).collect()} == {(2 * 64 * 10**7 + 0) ** 2}


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    vectors = [tuple(math.floor(64 * float(c)) + 1_000_000 for c in r.embedding) for r in rows]
    check(op12_whitening(spark, sf_dir).collect(), vectors, [r.vec_id for r in rows])
