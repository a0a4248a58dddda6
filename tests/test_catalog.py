"""Every catalogued query against its SQL, and the entry module."""

import math
import os
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

from trackloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalog.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, sf_dir, con, name):
    df = catalog.queries()[name](spark, sf_dir)
    rows = df.collect()
    if name in SQL:
        found = con.execute(SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        want = Counter(tuple(plain(r[names.index(c)]) for c in df.columns) for r in found.fetchall())
        assert Counter(tuple(map(plain, r)) for r in rows) == want
    else:
        assert rows


def test_import_without_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["plate", "n_visits", "visit_us"]
