import random
from collections import Counter

import brute
import pytest

from trackloom.llm import simhash
from trackloom.llm.components import connected_components

SCHEMA = "doc_id long, text string, fp string, component_id int"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in docs], SCHEMA)


def result(df):
    return Counter((r.doc_id, r.fingerprint, r.component_id) for r in df.collect())


def made_docs(seed=1):
    rng = random.Random(seed)
    vocab = [f"Word{i}é" for i in range(50)]
    docs, n = [], 0
    for _ in range(12):
        words = [rng.choice(vocab) for _ in range(rng.randint(60, 200))]
        for copy in range(rng.randint(1, 4)):
            own = list(words)
            if copy % 2:
                own[rng.randrange(len(own))] = "changed"
            docs.append((n, " ".join(own)))
            n += 1
    return docs + [(100, None), (101, ""), (102, " \t\n"), (103, "One"), (104, "ONE"), (105, "two words"), (None, docs[0][1]), (3, docs[3][1]), (106, "ÄA äa"), (107, "a b c " * 3000)]


@pytest.mark.parametrize("text", [None, "", "a", "A b", "a b c", "a b c a b c", "x " * 70_000, "Ünï cÖde z w"])
def test_fingerprint(text):
    assert int.from_bytes(simhash.simhash(text.encode() if text is not None else None), "big") == brute.fingerprint(text)


@pytest.mark.parametrize("block_rows", [2, 256])
def test_near_duplicates(spark, block_rows):
    docs = made_docs()
    assert result(simhash.near_duplicates(frame(spark, docs), block_rows=block_rows)) == brute.near_duplicates(docs)


def test_empty(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.keep_one(frame(spark, [])).count() == 0


@pytest.mark.parametrize("block_rows", [2, 8])
def test_links_of_dense_groups(spark, block_rows):
    """Hundreds of fingerprints within few bits of each other fill blocks, which are cut again."""
    rng = random.Random(block_rows)
    centre = rng.getrandbits(64)
    prints = {centre}
    for _ in range(250):
        x = rng.choice(sorted(prints)) if rng.random() < 0.3 else centre
        for _ in range(rng.randint(1, 3)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    prints |= {rng.getrandbits(64) for _ in range(50)}
    signed = {x: x - (1 << 64) if x >> 63 else x for x in prints}
    df = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    links = [(r.u, r.v) for r in simhash.close_links(df, block_rows=block_rows).collect()]
    joined = {frozenset(x) for x in links}
    mine = brute.components(signed.values(), lambda a, b: frozenset((a, b)) in joined)
    back = {v: k for k, v in signed.items()}
    want = brute.components(signed.values(), lambda a, b: (back[a] ^ back[b]).bit_count() <= 3)
    assert mine == want


def test_components(spark):
    rng = random.Random(3)
    for edges in ([], [(1, 1)], [(i, i + 1) for i in range(60)], [(rng.randrange(80), rng.randrange(80)) for _ in range(60)], [(0, i) for i in range(40)]):
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
        pairs = {frozenset(e) for e in edges if e[0] != e[1]}
        assert got == brute.components({n for p in pairs for n in p}, lambda a, b: frozenset((a, b)) in pairs)


def test_work_tables_go(spark):
    from trackloom.llm import common
    from trackloom.sources.tables import drop_work_tables, owned_by

    there = lambda df: spark.sparkContext._jvm.java.io.File(df.inputFiles()[0].removeprefix("file://")).exists()
    with owned_by("a"):
        one, read = common.materialize(spark.range(4), "one"), common.materialize(spark.range(4), "read")
    with owned_by("b"):
        other = common.materialize(spark.range(4), "other")
    last = read.withColumn("x", read["id"] + 1)
    assert one.count() == 4
    paths = one.inputFiles(), other.inputFiles()
    drop_work_tables(spark, "a", still_read=last)
    assert not spark.sparkContext._jvm.java.io.File(paths[0][0].removeprefix("file://")).exists()
    assert there(other) and there(read) and last.count() == 4
    drop_work_tables(spark, "a")
    drop_work_tables(spark)
    assert not spark.sparkContext._jvm.java.io.File(paths[1][0].removeprefix("file://")).exists()
