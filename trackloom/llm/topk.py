"""Exact top-k search by inner product as a Voronoi-partitioned kNN join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import materialize, ship_package

K = 5
#: Queries a group holds on average, the most pivots, queries and data rows of one local solution.
GROUP_QUERIES, MOST_PIVOTS, BLOCK_QUERIES, CHUNK_ROWS = 256, 128, 4096, 32768


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null for vectors that take no part."""
    ok = vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(ok, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros; integers of any size stay exact."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    return out


def unpacked(column: pa.Array | pa.ChunkedArray, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _assign(pivots: np.ndarray, width: int, kind: str):
    """Pack each vector in the narrowest integers; add its nearest pivot, the distance to it and its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = matrix(batch.column("v"), width)
            x = whole.astype(np.float64)
            far = np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(1)))
            cell = far.argmin(1)
            exact = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
            packed = pa.array([row.tobytes() for row in whole.astype(kind)], pa.binary())
            made = [packed, pa.array(cell.astype(np.int32)), pa.array(exact), pa.array(np.sqrt((x**2).sum(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("vec_id", "is_query", "rid")] + made, names=["vec_id", "is_query", "rid", "x", "cell", "far", "norm"])

    return run


def group_bounds(pivots: np.ndarray, cells: dict[int, dict], k: int) -> np.ndarray:
    """For each query group a score that the k-th best of all its queries reaches, from summaries alone.

    A query q of group i and a vector x of cell j are at most R_i + |p_i - p_j| + r_j apart, so their
    product is at least (min|q|^2 + min|x|^2 - apart^2) / 2. Cells in falling order of that are counted
    until they hold k vectors besides the query itself.
    """
    floor = np.full(len(pivots), -np.inf)
    for i, own in cells.items():
        if not own["n_queries"]:
            continue
        low = []
        for j, c in cells.items():
            apart = own["q_far"] + np.linalg.norm(pivots[i] - pivots[j]) + c["far"]
            low.append(((own["q_low"] ** 2 + c["low"] ** 2 - apart**2) / 2, c["n"]))
        seen = 0
        for bound, n in sorted(low, reverse=True):
            seen += n
            if seen >= k + 1:
                floor[i] = bound
                break
    return floor


class Plan:
    """Which groups of queries meet which cells of data, from summaries alone.

    A vector x of cell j has a product with a query of group i of at most p_i.x + |x| R_i, and so of at
    most p_i.p_j + |p_i| r_j + R_i max|x|. Where that is below the group's floor, the two don't meet.
    Groups that meet the same cells share blocks of queries, and cells that the same groups meet share
    chunks of data, so that what bounds can't tell apart is copied no more often than its blocks ask for.
    """

    def __init__(self, pivots: np.ndarray, cells: dict[int, dict], k: int):
        n = len(pivots)
        self.pivots = pivots
        self.floor = group_bounds(pivots, cells, k)
        self.radius = np.array([cells[i]["q_far"] if i in cells else 0.0 for i in range(n)])
        queries = np.array([cells[i]["n_queries"] if i in cells else 0 for i in range(n)])
        rows = np.array([cells[i]["n"] if i in cells else 0 for i in range(n)])
        far = np.array([cells[i]["far"] if i in cells else 0.0 for i in range(n)])
        high = np.array([cells[i]["high"] if i in cells else 0.0 for i in range(n)])
        most = pivots @ pivots.T + np.sqrt((pivots**2).sum(1))[:, None] * far + self.radius[:, None] * high
        self.meets = (most + 1e-9 * (np.abs(most) + 1) >= self.floor[:, None]) & (queries > 0)[:, None] & (rows > 0)
        _, self.team = np.unique(self.meets, axis=0, return_inverse=True)
        _, self.pool = np.unique(self.meets, axis=1, return_inverse=True)
        self.team, self.pool = self.team.ravel(), self.pool.ravel()
        self.blocks = np.array([-(-queries[self.team == t].sum() // BLOCK_QUERIES) for t in range(self.team.max() + 1)])
        self.chunks = np.array([-(-rows[self.pool == p].sum() // CHUNK_ROWS) for p in range(self.pool.max() + 1)])
        self.joined = np.zeros((len(self.blocks), len(self.chunks)), bool)
        np.logical_or.at(self.joined, (self.team[:, None], self.pool[None, :]), self.meets)
        self.first_block = np.concatenate([[0], np.cumsum(self.blocks)])
        self.first_chunk = np.concatenate([[0], np.cumsum(self.chunks)])

    def kept_share(self, cells: dict[int, dict]) -> float:
        """The share of all (query, vector) products that cells leave to be computed."""
        pairs = [(cells[i]["n_queries"] * cells[j]["n"], self.meets[i, j]) for i in cells for j in cells]
        return sum(n for n, kept in pairs if kept) / max(1, sum(n for n, _ in pairs))

    def reach(self, x: np.ndarray) -> np.ndarray:
        """Whether each vector may be among the best of each team's queries."""
        most = x @ self.pivots.T + np.sqrt((x**2).sum(1))[:, None] * self.radius
        group = most + 1e-9 * (np.abs(most) + 1) >= self.floor
        return np.stack([group[:, self.team == t].any(axis=1) for t in range(len(self.blocks))], axis=1)


def _hash(rid: np.ndarray) -> np.ndarray:
    x = rid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(32))) & np.uint64((1 << 31) - 1)).astype(np.int64)


def _copies(plan: Plan, width: int, kind: str, queries: bool):
    """Rows of queries for each chunk that they meet, or rows of data for each block of queries that they may reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, rid = batch.column("cell").to_numpy(), batch.column("rid").to_numpy()
            own, spread = (plan.team[cell], plan.blocks) if queries else (plan.pool[cell], plan.chunks)
            firsts, other_first, other_n = (plan.first_block, plan.first_chunk, plan.chunks) if queries else (plan.first_chunk, plan.first_block, plan.blocks)
            mine = firsts[own] + _hash(rid) % np.maximum(1, spread[own])
            wanted = plan.joined[own] if queries else plan.joined.T[own] & plan.reach(unpacked(batch.column("x"), width, kind).astype(np.float64))
            row, other = np.nonzero(wanted & (other_n > 0))
            times = other_n[other]
            rows = np.repeat(row, times)
            theirs = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(other_first[other], times)
            block, chunk = (mine[rows], theirs) if queries else (theirs, mine[rows])
            for at in range(0, len(rows), 20_000):
                some = batch.take(pa.array(rows[at : at + 20_000]))
                keys = [pa.array(k[at : at + 20_000].astype(np.int32)) for k in (block, chunk)]
                yield pa.RecordBatch.from_arrays([*keys, some.column("rid"), some.column("vec_id"), some.column("x")], names=["block", "chunk", "rid", "vec_id", "x"])

    return run


def _solve(k: int, width: int, kind: str):
    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        q, x = unpacked(queries["x"], width, kind).astype(np.int64), unpacked(data["x"], width, kind).astype(np.int64)
        names, rids = data["vec_id"].to_numpy(), data["rid"].to_numpy()
        order = np.lexsort((rids, names))
        x, names, rids = x[order], names[order], rids[order]
        exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * width < 2**53
        across = x.T.astype(float) if exact else x.T
        out: list[tuple] = []
        for row, (rid, name) in enumerate(zip(queries["rid"].to_numpy(), queries["vec_id"].to_numpy())):
            if row % 128 == 0:
                part = q[row : row + 128]
                scores = (part.astype(float) @ across).astype(np.int64) if exact else part @ across
            s = scores[row % 128]
            others = np.flatnonzero(rids != rid)
            s, own = s[others], others
            if len(s) > k:
                close = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                close = close[np.argsort(-s[close], kind="stable")][:k]
            else:
                close = np.argsort(-s, kind="stable")
            out += [(rid, name, names[own[i]], s[i], rids[own[i]]) for i in close]
        columns = list(zip(*out)) or [[]] * 5
        return pa.table([pa.array([int(v) for v in c], pa.int64()) for c in columns], names=["qid", "query_id", "vec_id", "score", "rid"])

    return run


def top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = 256, most: float | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best inner products of each query row with all other rows.

    Pivots are a bounded sample by hash. Queries and data are grouped by their nearest pivot; one
    summary row per group gives each query group a floor under its k-th best score, and with it the
    cells and in these the vectors that may reach it; only those are sent, in the narrowest integers
    that hold them. Queries fall into blocks and data into chunks, so a local solution is bounded
    whatever the skew; best lists of chunks are merged. On vectors without clusters bounds keep all:
    each vector is then copied once for every BLOCK_QUERIES queries and each query once for every
    CHUNK_ROWS vectors. Ties go to the smaller id, then to the row stored first.

    Vectors that are null or hold null or non-finite components, and rows without an id, take no
    part; shorter vectors count as filled up with zeros; rows that repeat are rows of their own; fewer
    than k others give fewer ranks; an empty table gives an empty result; other columns are dropped.
    Vectors so large that a score might not fit 64 bits are refused (an error); with ``most``, vectors that
    hold a component beyond it take no part instead.
    """
    spark = df.sparkSession
    ship_package(spark)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), quantized(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    if most is not None:
        rows = rows.where(F.forall("v", lambda x: F.abs(x) <= most * scale))
    rows = rows.where("v is not null and vec_id is not null").withColumn("rid", F.monotonically_increasing_id())
    rows = materialize(rows, "vectors")
    totals = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("q"), F.max(F.size("v")).alias("width"), F.max(F.array_max("v")).alias("most"), F.min(F.array_min("v")).alias("least")
    ).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not totals["q"]:
        return empty
    width = max(1, totals["width"])
    largest = max(totals["most"] or 0, -(totals["least"] or 0), 0)
    if width * largest**2 >= 1 << 63:
        raise ValueError(f"components up to {largest} in {width} dimensions: a score might not fit 64 bits")
    kind = next(f"<i{n}" for n in (2, 4, 8) if largest < 1 << (8 * n - 1))
    n_pivots = max(4, min(MOST_PIVOTS, -(-totals["q"] // GROUP_QUERIES)))
    picked = rows.orderBy(F.xxhash64("vec_id", "v"), "rid").select("v").limit(n_pivots).collect()
    pivots = np.array([list(r["v"]) + [0] * (width - len(r["v"])) for r in picked], np.float64)
    schema = "vec_id long, is_query boolean, rid long, x binary, cell int, far double, norm double"
    placed = materialize(rows.mapInArrow(_assign(pivots, width, kind), schema), "vectors-placed")
    asked = F.when(F.col("is_query"), F.col("far"))
    summary = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("far").alias("far"),
        F.min("norm").alias("low"),
        F.max("norm").alias("high"),
        F.count_if("is_query").alias("n_queries"),
        F.coalesce(F.max(asked), F.lit(0.0)).alias("q_far"),
        F.coalesce(F.min(F.when(F.col("is_query"), F.col("norm"))), F.lit(0.0)).alias("q_low"),
    )
    cells = {r["cell"]: r.asDict() for r in summary.collect()}  # a row a pivot
    plan = Plan(pivots, cells, k)
    copied = "block int, chunk int, rid long, vec_id long, x binary"
    data = placed.mapInArrow(_copies(plan, width, kind, False), copied)
    queries = placed.where("is_query").mapInArrow(_copies(plan, width, kind, True), copied)
    best = (
        queries.groupBy("block", "chunk")
        .cogroup(data.groupBy("block", "chunk"))
        .applyInArrow(_solve(k, width, kind), "qid long, query_id long, vec_id long, score long, rid long")
    )
    order = Window.partitionBy("qid", "query_id").orderBy(F.desc("score"), "vec_id", "rid")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
