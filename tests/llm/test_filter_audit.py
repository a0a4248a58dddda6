"""The filter audit against a replay of every order."""

import random
import re
from collections import Counter

import brute
import duckdb

from trackloom.llm import filter_audit, queries


def fails(rows):
    """``rows``: (id, text, part). The letters that each row fails, in plain Python."""
    out = []
    for i, text, _ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = set()
        if len(w) < 200:
            own.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            own.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t):
            own.add("C")
        if re.search(r"[#$%&*|]", t):
            own.add("D")
        if any((j is not None and (i is None or j < i)) and (u or "") == t for j, u, _ in rows):
            own.add("E")
        out.append(own)
    return out


def made():
    rng = random.Random(8)
    rows = []
    for i in range(120):
        w = [rng.choice(["ab", "cd", "é", "Xy", f"w{k}"]) if rng.random() < 0.5 * (i % 3) else f"w{i}-{k}" for k in range(rng.choice([3, 199, 200, 260]))]
        rows.append((i, " ".join(w) + rng.choice(["", "", " #", " |", "\n"]), rng.choice(["aa", "bb", None, ""])))
    rows += [(200, None, "aa"), (201, "", "bb"), (202, " \t", None), (203, rows[0][1], "bb"), (203, rows[0][1], "aa"), (None, rows[0][1], "aa"), (None, "own", "cc"), rows[1]]
    return rows


def test_against_every_order(spark):
    rows = made()
    labels = [(0, 1, 0), (1, 0, 1), (1, None, None), (2, 1, 1), (2, 1, 1), (203, 1, None), (999, 1, 1), (None, 1, 1)] + [(i, i % 2, i % 5 == 0) for i in range(10, 100)]
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, n int, part string")
    tags = spark.createDataFrame([(a, b, None if c is None else int(c), "x") for a, b, c in labels], "doc_id long, quality int, toxic int, n_good string")
    out = filter_audit.audit(filter_audit.labelled(filter_audit.failures(df), tags)).collect()
    want = brute.audit([(r[2] or "", f, int(r[0] in good), int(r[0] in toxic)) for r, f in zip(rows, fails(rows))])
    assert Counter(tuple(r) for r in out if r.part is not None) == want
    whole = brute.audit([("all", f, int(r[0] in good), int(r[0] in toxic)) for r, f in zip(rows, fails(rows))])
    assert Counter(("all", *tuple(r)[1:]) for r in out if r.part is None) == whole


def test_other_filters_and_null_flags(spark):
    flags = spark.createDataFrame([("p", True, None, 1, 0, 0), ("p", False, True, 1, 1, 0), (None, True, True, 3, 0, 1)], "part string, X boolean, Y boolean, n int, n_good int, n_toxic int")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails) for r in filter_audit.audit(flags, "XY").where("part = 'p'").collect()}
    assert got == {("p", "XY", 1): (1, 1, 0, 1), ("p", "XY", 2): (0, 1, 0, 1), ("p", "YX", 1): (1, 1, 0, 1), ("p", "YX", 2): (0, 1, 0, 1)}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    tags = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.labelled(filter_audit.failures(df), tags)).where("part IS NOT NULL").count() == 0


def test_query(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.op13_filter_audit(spark, sf_dir)
    found = con.execute(queries.OP13_SQL)
    names = [x[0] for x in found.description]
    assert Counter(map(tuple, df.select(*names).collect())) == Counter(found.fetchall())
