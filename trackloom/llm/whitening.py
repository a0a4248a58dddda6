"""Whitening of embeddings: a covariance matrix computed tile by tile, then projection on its components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import checked_keep, materialize, ship_package
from trackloom.llm.topk import matrix

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Dimensions of a tile's side, and rows of a row-block.
TILE, BLOCK_ROWS = 32, 8192
#: Entries of a vector are within this; ``prepared`` says what happens to others.
MOST = 1 << 40


def prepared(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, offset: int = OFFSET, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col, x``: floor(scale * entry) + offset of each vector that takes part, as longs.

    Vectors that are null or hold a null or a non-finite entry take no part; nor do empty ones, ones whose
    x leaves MOST, and ones of another length than the most common (of equally common ones, the longer).
    """
    checked_keep(keep, (id_col.lower(), "x"))
    v = F.col(vector_col)
    ok = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")) | (F.abs(c.cast("double") * scale) + abs(offset) >= MOST))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long") + offset)
    rows = df.where(F.coalesce(ok, F.lit(False))).select(F.col(id_col), x.alias("x"), *keep)
    width = F.size("x")
    common = rows.groupBy(width.alias("_w")).agg(F.count(F.lit(1)).alias("_n")).agg(F.max_by("_w", F.struct("_n", "_w")).alias("_w"))
    return rows.join(F.broadcast(common), width == F.col("_w")).drop("_w")


@dataclass(frozen=True)
class Fit:
    """Size n of the fit list, sums S by dimension, the components (as rows), their eigenvalues and their shares of the trace."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    shares: np.ndarray


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and sums by dimension of each batch."""
    for b in batches:
        if b.num_rows:
            x = matrix(b.column(0), _width(b.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([x.sum(axis=0).tolist()], pa.list_(pa.int64()))], names=["n", "s"])


def _width(column: pa.Array) -> int:
    return int(np.diff(column.offsets.to_numpy()[:2])[0])


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - S/n: whole parts as integers, so offsets cost no digits."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole) - rest


def _column_blocks(n: int, sums: tuple[int, ...], tile: int, rows: int):
    """Column blocks of each row-block, one for each tile that it takes part in: ``i, j, block, side, kind, data``.

    Entries are sent as whole numbers about the whole part of the mean, in the narrowest integers that hold the block.
    """
    edges = list(range(0, len(sums), tile))
    whole = np.array([s // n for s in sums], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                c = matrix(part.column(1), len(sums)) - whole
                block = part.column(0)[0].as_py()
                out = []
                for k, e in enumerate(edges):
                    own = c[:, e : e + tile]
                    kind = next(t for t in ("i1", "i2", "i4", "i8") if -(1 << 8 * int(t[1]) - 1) <= own.min() and own.max() < 1 << 8 * int(t[1]) - 1)
                    data = np.ascontiguousarray(own.astype(kind)).tobytes()
                    out += [(min(k, o), max(k, o), block, int(k > o), kind, data) for o in range(len(edges))]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)], names=["i", "j", "block", "side", "kind", "data"])

    return run


def _products(n: int, sums: tuple[int, ...], tile: int):
    """The product of a tile's two column blocks of one row-block, centred before they are multiplied, as one row of sums."""
    rest = np.array([(s % n) / n for s in sums])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(key[0]), int(key[1])
        blocks = {side: np.frombuffer(data, kind) for side, kind, data in zip(pdf["side"], pdf["kind"], pdf["data"])}
        a, b = (blocks.get(side, blocks[0]).reshape(-1, len(rest[k * tile : (k + 1) * tile])) - rest[k * tile : (k + 1) * tile] for side, k in ((0, i), (1, j)))
        return pd.DataFrame({"i": [i], "j": [j], "p": [(a.T @ b).ravel()]})

    return run


def tile_sums(rows: DataFrame, n: int, sums: tuple[int, ...], tile: int = TILE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``i, j, at, s``: entries of the centred cross products of column blocks i <= j, summed over all rows of ``x``.

    A pair of column blocks is a tile. Each row-block sends its column blocks to the tiles they belong to,
    by (tile, row-block), so a task multiplies bounded blocks only; products are summed by tile.
    """
    numbered = rows.select(F.monotonically_increasing_id().alias("block"), "x")
    blocks = numbered.mapInArrow(_column_blocks(n, sums, tile, block_rows), "i int, j int, block long, side int, kind string, data binary")
    made = blocks.groupBy("i", "j", "block").applyInPandas(_products(n, sums, tile), "i int, j int, p array<double>")
    return made.select("i", "j", F.posexplode("p").alias("at", "p")).groupBy("i", "j", "at").agg(F.sum("p").alias("s"))


def fit(vectors: DataFrame, components: int = COMPONENTS, tile: int = TILE, block_rows: int = BLOCK_ROWS) -> tuple[Fit | None, DataFrame]:
    """Components of the distinct vectors of ``vectors`` (column x), and these vectors; None if there are none.

    The driver receives one row of sums and the d * (d + 1) / 2 entries of the covariance matrix, both
    bounded by the dimension d, and no vector. Eigenvectors are those of the whole matrix in double precision.
    """
    listed = materialize(vectors.select("x").distinct(), "whitening-fit")
    parts = listed.mapInArrow(_sums, "n long, s array<long>")
    per_dim = parts.select("n", F.posexplode("s").alias("at", "s")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("at").collect()
    if not per_dim:
        return None, listed
    n, sums = per_dim[0]["n"], tuple(r["s"] for r in per_dim)
    d = len(sums)
    v = np.zeros((d, d))
    for r in tile_sums(listed, n, sums, tile, block_rows).collect():
        wide = min(tile, d - r["j"] * tile)
        a, b = r["i"] * tile + r["at"] // wide, r["j"] * tile + r["at"] % wide
        v[a, b] = v[b, a] = r["s"] / n
    values, axes = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    trace = float(np.trace(v))
    kept = values[order]
    shares = kept / trace if trace > 0 else np.full(len(order), np.nan)
    # eigenvalues that are zero but for rounding have no whitened values
    floor = d * np.finfo(float).eps * max(float(values[-1]), 0.0)
    return Fit(n, sums, np.ascontiguousarray(axes[:, order].T), np.where(kept > floor, kept, np.nan), shares), listed


def project(x: np.ndarray, f: Fit) -> np.ndarray:
    return centred(x, f.n, f.sums) @ (f.axes / np.sqrt(f.values)[:, None]).T


def _moments(f: Fit):
    """Count, means and centred cross products of the whitened rows of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                w = project(matrix(b.column(0), len(f.sums)), f)
                m = w.mean(axis=0)
                c = (w - m).T @ (w - m)
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([m.tolist()]), pa.array([c.ravel().tolist()])], names=["n", "m", "c"])

    return run


def identity_error(listed: DataFrame, f: Fit) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity, over components that have values.

    Batches give centred products, to which the spread of batch means is added; both are summed by entry.
    """
    k = len(f.values)
    parts = materialize(listed.mapInArrow(_moments(f), "n long, m array<double>, c array<double>"), "whitening-moments")
    means = parts.select("n", F.posexplode("m").alias("at", "m")).groupBy("at").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("m")).orderBy("at").collect()
    mean = [r["m"] for r in means]
    shift = F.array(*[F.get("m", F.lit(i)) - F.lit(m) for i, m in enumerate(mean)])
    entries = parts.select("n", "c", shift.alias("u")).select("n", "u", F.posexplode("c").alias("at", "c"))
    cross = F.col("c") + F.col("n") * F.get("u", F.floor(F.col("at") / k).cast("int")) * F.get("u", F.col("at") % k)
    cov = entries.groupBy("at").agg((F.sum(cross) / F.sum("n")).alias("v")).collect()
    known = ~np.isnan(f.values)
    off = [abs(r["v"] - (r["at"] // k == r["at"] % k)) for r in cov if known[r["at"] // k] and known[r["at"] % k]]
    return max(off, default=0.0)


def _whitened(f: Fit):
    k, none = len(f.values), np.isnan(f.values)

    def deviations(x: np.ndarray) -> np.ndarray:
        d = [int(v) for v in np.abs(x).max(axis=0)]
        if sum((f.n * v + abs(s)) ** 2 for v, s in zip(d, f.sums)) < 1 << 62:
            off = f.n * x - np.array(f.sums, np.int64)
            return (off * off).sum(axis=1)
        whole = np.array([s // f.n for s in f.sums], np.int64)
        rest = [s % f.n for s in f.sums]
        if sum((f.n * (int(v) + 1)) ** 2 for v in np.abs(x - whole).max(axis=0)) < 1 << 62:
            off = f.n * (x - whole) - np.array(rest, np.int64)
            return (off * off).sum(axis=1)
        exact = [sum((f.n * int(v) - s) ** 2 for v, s in zip(row, f.sums)) for row in x]
        if max(exact) >= 1 << 63:
            raise OverflowError("a squared deviation, times n squared, leaves the range of a long")
        return np.array(exact, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("x"), len(f.sums))
            w = project(x, f)
            dev = deviations(x)
            keys = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), k)))
            gone = np.tile(none, b.num_rows)
            made = [
                keys,
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)),
                pa.array(np.repeat(dev, k)),
                pa.array(w.ravel(), mask=gone),
                pa.array(np.tile(f.shares, b.num_rows), mask=np.isnan(np.tile(f.shares, b.num_rows))),
            ]
            yield pa.RecordBatch.from_arrays(made, names=["_id", "component", "deviation", "whitened", "explained"])

    return run


def whiten(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET, tile: int = TILE, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``id_col, component, n, deviation, whitened, explained, identity_error`` of each vector that takes part and each component.

    Vectors are scaled to whole numbers (``prepared`` says which take part) and the components are those of
    the covariance of the distinct ones, numbered from 1 by falling eigenvalue: repeated vectors count once
    in the fit, and each has its rows in the result. Components with an eigenvalue that is zero but for
    rounding (fewer vectors than dimensions, constant dimensions) have a null ``whitened`` and don't count in
    ``identity_error``; if all vectors are equal, ``explained`` is null as well. ``deviation`` is exact; where it leaves the
    range of a long (n squared times the squared distance from the mean) the job ends in an error. Ids may be
    null or repeat; other columns are dropped; a table without vectors gives an empty result.
    """
    ship_package(df.sparkSession)
    rows = materialize(prepared(df, id_col, vector_col, scale, offset), "whitening-rows")
    f, listed = fit(rows, components, tile, block_rows)
    kind = rows.schema[id_col].dataType.simpleString()
    columns = f"_id {kind}, component int, deviation long, whitened double, explained double"
    if f is None:
        empty = df.sparkSession.createDataFrame([], columns)
        return empty.select(F.col("_id").alias(id_col), "component", F.lit(0).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(0.0).alias("identity_error"))
    error = identity_error(listed, f)
    out = rows.mapInArrow(_whitened(f), columns)
    return out.select(F.col("_id").alias(id_col), "component", F.lit(f.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))
