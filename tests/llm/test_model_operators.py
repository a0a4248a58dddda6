"""Top-k search, language ID, the registered queries and the pipeline."""

import math
import os
import random
import subprocess
import sys
from collections import Counter

import brute
import numpy as np
import pytest
from test_copies import check
from pyspark.sql import functions as F

from trackloom.llm import language_id, simhash, topk


def brute_topk(rows, k):
    ok = [(n, i, [math.floor(256 * np.float64(np.float32(x))) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, v in ok:
        if i % 5 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, j, w in ok if m != n)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return Counter(out)


@pytest.mark.parametrize("n,chunk,block", [(3, 8192, 1024), (400, 8192, 1024), (400, 50, 8)])
def test_topk(spark, monkeypatch, n, chunk, block):
    monkeypatch.setattr(topk, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", block)
    monkeypatch.setattr(topk, "GROUP_QUERIES", 8)
    rng = random.Random(n)
    centres = [[rng.gauss(0, 3) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in centres[i * i % 5]]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(9)]  # ties
    rows += [(n + 20, None), (n + 21, [1.0, None]), (n + 22, [float("nan")] * 6), (n + 23, [float("inf")] * 6), (None, rows[1][1]), (n + 24, [2.0]), (n + 25, [])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, rank int, score int")
    got = topk.top_k(df, F.col("vec_id") % 5 == 0)
    assert Counter(tuple(r) for r in got.collect()) == brute_topk(rows, 5)


def test_topk_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, F.col("vec_id") % 5 == 0).count() == 0


def test_topk_bounds(spark):
    """Far clusters don't meet, and results stay whole."""
    rng = random.Random(9)
    centres = [[rng.gauss(0, 40) for _ in range(8)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in centres[i % 6]]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    seen = []
    plain = topk.Plan.__init__

    def spy(self, pivots, cells, k):
        plain(self, pivots, cells, k)
        seen.append(self.kept_share(cells))

    topk.Plan.__init__ = spy
    try:
        topk.GROUP_QUERIES, old = 8, topk.GROUP_QUERIES
        got = Counter(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0).collect())
    finally:
        topk.Plan.__init__, topk.GROUP_QUERIES = plain, old
    assert got == brute_topk(rows, 5) and seen[0] < 0.5, seen


def test_topk_of_large_components(spark):
    kind = "vec_id long, embedding array<double>"
    rows = [(5 * i, [2.0e6 * (i + 1), -3.0]) for i in range(4)]
    got = topk.top_k(spark.createDataFrame(rows, kind), F.col("vec_id") % 5 == 0)
    assert max(r.score for r in got.collect()) == (4 * 512_000_000) * (3 * 512_000_000) + 768 * 768
    outlier = spark.createDataFrame([(5, [1.0, 2.0]), (6, [3.0, 1.0]), (7, [1e300, 0.0]), (8, [0.0, -20.0])], kind)
    assert [(r.query_id, r.vec_id) for r in topk.top_k(outlier, F.col("vec_id") % 5 == 0, most=10.0).collect()] == [(5, 6)]
    for huge in (4e9, 1e300):
        with pytest.raises(ValueError):
            topk.top_k(spark.createDataFrame([(5, [huge]), (6, [huge])], kind), F.col("vec_id") % 5 == 0)


def predictions(spark, folder):
    from trackloom.llm.queries import op9_language_id

    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text")
    return op9_language_id(spark, folder).join(docs, "doc_id").collect()


def test_held_out_accuracy(spark):
    import zlib

    rows = predictions(spark, "/root/testdata/sf0.01")
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    asked = [r for r in rows if r.held_out and r.lang and any(map(str.isalpha, r.text or ""))]
    assert len(asked) > 100 and sum(r.lang == r.lang_pred for r in asked) / len(asked) >= 0.97


def test_language_cases(spark):
    learn = spark.createDataFrame([("the cat and the dog went out in the rain " * 3, "en"), ("der hund und die katze gingen in den regen " * 3, "de"), (None, "xx"), ("lost", None), (" ", "yy")], "text string, lang string")
    model = language_id.learn_dictionaries(learn)
    assert sorted(model) == ["de", "en"]
    rows = [(1, "the dog and the cat", "x"), (2, None, "x"), (3, "", "x"), (4, "123 -- 5", "x"), (5, "die katze und der hund " * 3000, "x"), (None, "the cat and the dog went out", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(df, model, keep=("doc_id",)).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4, 5, None)] == ["en", "und", "und", "und", "de", "en"]
    assert {r.lang_pred for r in language_id.identify(df.select("doc_id", "text"), {}, keep=("doc_id",)).collect()} == {"und"}
    assert language_id.identify(df.limit(0), model, keep=("doc_id",)).count() == 0
    assert language_id.learn_dictionaries(learn.limit(0)) == {}


def test_language_scores(spark):
    """Predictions and scores from the compression library, one text at a time; more languages than are learned; ties."""
    import zstandard as zstd

    learn = spark.createDataFrame([(f"{w} text number {i} " * 9, lang) for lang, w in (("aa", "alpha"), ("bb", "beta"), ("cc", "gamma")) for i in range(20 if lang != "cc" else 3)], "text string, lang string")
    assert sorted(language_id.learn_dictionaries(learn, languages=2)) == ["aa", "bb"]
    model = language_id.learn_dictionaries(learn)
    model["twin"] = model["cc"]
    texts = ["alpha text", "Beta text " * 400, "gamma text number 2 gamma text number 1", "unlike all of them", "ALPHA beta"]
    rows = language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model, keep=("doc_id",)).collect()
    params = zstd.ZstdCompressionParameters(window_log=18, chain_log=14, hash_log=15, search_log=3, min_match=4, target_length=8, strategy=zstd.STRATEGY_LAZY, write_content_size=0, write_dict_id=0)
    for r in rows:
        data = texts[r.doc_id].lower().encode()
        sizes = []
        for lang in sorted(model):
            coder = zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(model[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=params)
            sizes.append((sum(len(coder.compress(data[i : i + 1024])) for i in range(0, len(data), 1024)), lang))
        best, second = sorted(sizes)[:2]
        assert (r.lang_pred, r.score) == (best[1], (second[0] - best[0]) / second[0])
    tied = next(r for r in rows if r.doc_id == 2)
    assert (tied.lang_pred, tied.score) == ("cc", 0.0)
    with pytest.raises(ValueError):
        language_id.identify(spark.createDataFrame([], "doc_id int, text string, score int"), model, keep=("score",))


def test_simhash_query(spark, sf_dir):
    from trackloom.llm.queries import op1_simhash

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in op1_simhash(spark, sf_dir).collect()) == brute.near_duplicates(docs)


def test_pipeline_stages(spark, sf_dir):
    """Every stage against a plain version on its own input."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    names = [n for n, _ in p.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    seen = [{r.doc_id: r for r in docs.collect()}]
    for name, stage in p.STAGES[:3]:
        docs = p.materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns == list(p.COLUMNS)
        rows = docs.collect()
        seen.append({r.doc_id: r for r in rows})
        assert len(seen[-1]) == len(rows) and all(seen[0][i] == r for i, r in seen[-1].items())
    before, found, deduped, clean = seen
    assert all(any(map(str.isalpha, r.text or "")) for r in found.values()) and len(found) > 0.9 * sum(r.lang is not None for r in before.values() if any(map(str.isalpha, r.text or "")))
    check([(i, r.text) for i, r in found.items()], list(deduped))
    assert set(clean) == {i for i, *_, bad in brute.contamination([(i, r.text) for i, r in deduped.items()], bench) if not bad}
    mixed = p.materialize(p.STAGES[3][1](spark, docs, sf_dir), "mixing")
    copies = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == list(p.COLUMNS) and set(copies) <= set(clean) and max(copies.values()) <= 2
    for i, _, size, taken in brute.mix([(i, r.text, r.source) for i, r in clean.items()]):
        assert copies[i] * size == taken
    sharded = p.STAGES[4][1](spark, mixed, sf_dir).collect()
    assert Counter(r.doc_id for r in sharded) == copies
    slots = {}
    for r in sharded:
        assert r.shard == brute.jump(brute.spark_hash(r.doc_id), 24)
        assert r.size == len((clean[r.doc_id].text or "").encode()) + 8
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert p.run(spark, sf_dir).count() == len(sharded)


def test_pipeline_nulls(spark, tmp_path):
    import corpus_pipeline as p

    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (2, "the same words in english again and again", "en", "s", 41), (2, "the same words in english again and again", "en", "s", 41), (3, "eine andere zeile mit deutschen worten darin", "de", "t", 44)]
    for name, data in (("full", rows), ("empty", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"size": F.lit("own"), "_keep": F.lit(1), "shard": F.lit("s")}).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = {r.doc_id for r in p.run(spark, folder).collect()}
        assert got <= {2, 3} and (name == "full") == bool(got)


def test_sql_of_corpus_queries(spark, sf_dir):
    import duckdb

    from trackloom.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf_dir)
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
        assert Counter(map(str, want)) == Counter(str(tuple(r)) for r in df.collect()), name


def test_rest_stands_without_this_package(tmp_path):
    """The entry module works when the corpus files are gone."""
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(f"{root}/trackloom", tmp_path / "trackloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n[:2] == 'op' for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert done.stdout.split()[-1:] == ["False"], done.stderr


def test_signed():
    assert simhash._signed((1 << 64) - 1) == -1
