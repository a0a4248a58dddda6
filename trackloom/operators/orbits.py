"""Rows that a sequence of steps visits, found in parallel: next rows by chunks, then pointer doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.sources.tables import ship_package, stored

#: Rows of a chunk, rows whose distances are taken at a time, and rows that all look at, one after the other, before that.
CHUNK, SLAB, STEPS = 2048, 256, 64


def _by_chunk(df: DataFrame, step, schema: str, *order: str) -> DataFrame:
    """``step`` over each task's rows, sorted by plate, chunk and ``order``: many chunks in a batch, so that short ones cost no call each."""
    return df.repartition("plate", "chunk").sortWithinPartitions("plate", "chunk", *order).mapInArrow(step, schema)


def _begins(rows: pa.Table) -> np.ndarray:
    """Where each chunk of sorted rows begins."""
    fresh = np.arange(rows.num_rows) == 0
    for c in ("plate", "chunk"):
        code = pc.dictionary_encode(pa.concat_arrays(rows[c].chunks), null_encoding="encode").indices.to_numpy()
        fresh[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(fresh)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of whole chunks and where these begin; the last chunk of a batch waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([*held, batch])
            begins = _begins(rows)
            if len(begins) > 1:
                yield rows.slice(0, begins[-1]), begins[:-1]
            held = rows.slice(begins[-1]).to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        yield rows, _begins(rows)


def _ends(begins: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` rows the begin and the end of its chunk."""
    size = np.diff(np.append(begins, n))
    return np.repeat(begins, size), np.repeat(begins + size, size)


def _numbers(rows: pa.Table, *columns: str) -> list[np.ndarray]:
    return [rows[c].to_numpy() for c in columns]


def _first_far(x: np.ndarray, y: np.ndarray, at: np.ndarray, first: np.ndarray, end: np.ndarray, radius: float) -> np.ndarray:
    """For each of the positions ``at`` the first position from ``first`` up to ``end`` that lies farther than ``radius`` from it; -1 if none does."""
    out = np.full(len(at), -1, np.int64)
    todo = np.flatnonzero(first < end)
    for k in range(STEPS):
        if not len(todo):
            return out
        to, own = first[todo] + k, at[todo]
        far = (x[to] - x[own]) ** 2 + (y[to] - y[own]) ** 2 > radius * radius
        out[todo[far]] = to[far]
        todo = todo[~far & (to + 1 < end[todo])]
    for a in range(0, len(todo), SLAB):
        for e in np.unique(end[todo[a : a + SLAB]]):  # rows of one chunk
            s = todo[a : a + SLAB][end[todo[a : a + SLAB]] == e]
            to = np.arange(first[s].min() + STEPS, e)
            far = ((x[to][None, :] - x[at[s], None]) ** 2 + (y[to][None, :] - y[at[s], None]) ** 2 > radius * radius) & (to[None, :] >= first[s, None])
            hit = far.argmax(axis=1)
            out[s] = np.where(far[np.arange(len(s)), hit], to[hit], -1)
    return out


def _within(radius: float):
    """Own rows of a chunk look at all later ones, of which the next chunk's are there as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begins in _whole(batches):
            x, y, ord_, own = _numbers(rows, "x", "y", "ord", "own")
            at = np.flatnonzero(own)
            found = _first_far(x, y, at, at + 1, _ends(begins, len(x))[1][at], radius)
            out = rows.select(["plate", "ord", "x", "y"]).take(pa.array(at))
            yield from out.append_column("next", pa.array(np.where(found < 0, -1, ord_[found]))).to_batches()

    return run


def _in_chunk(radius: float):
    """Rows that look at another chunk come after its rows, which are all that is held from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*held, batch])
            begins = _begins(rows)
            x, y, ord_, looks = _numbers(rows, "x", "y", "ord", "looks")
            begin = _ends(begins, len(x))[0]
            end = begin + np.repeat(np.add.reduceat((~looks).astype(np.int64), begins), np.diff(np.append(begins, len(x))))
            at = np.flatnonzero(looks)
            found = _first_far(x, y, at, begin[at], end[at], radius)
            out = rows.select(["plate", "ord", "x", "y", "chunk"]).take(pa.array(at))
            yield from out.append_column("next", pa.array(np.where(found < 0, -1, ord_[found]))).to_batches()
            held = rows.slice(begins[-1], end[-1] - begins[-1]).to_batches()

    return run


def _chunk_of(column: str, chunk: int):
    return F.floor((F.col(column) - 1) / chunk).cast("long")


def next_far(obs: DataFrame, radius: float, chunk: int = CHUNK) -> DataFrame:
    """``plate, ord, next``: for each row the first later row of its plate that is farther than ``radius`` from it, or null.

    ``ord`` counts a plate's rows from 1. Rows look through their own chunk and the one after it; those that found
    nothing go on to the next chunk whose bounding box has a corner that far, chunk by chunk, until there is none. So a
    task holds two chunks, however long a plate is.
    """
    ship_package(obs.sparkSession)
    rows = obs.select("plate", "ord", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).withColumn("chunk", _chunk_of("ord", chunk))
    rows = stored(rows, "orbit-rows")
    kind = rows.schema["plate"].dataType.simpleString()
    base = f"plate {kind}, ord long, x double, y double"
    sides = rows.withColumns({"_c": F.explode(F.array(F.col("chunk"), F.col("chunk") - 1))}).withColumn("own", F.col("_c") == F.col("chunk")).where("_c >= 0")
    sides = sides.select("plate", F.col("_c").alias("chunk"), "ord", "x", "y", "own")
    seen = stored(_by_chunk(sides, _within(radius), f"{base}, next long", "ord"), "orbit-next")
    found = [seen.where("next >= 0").select("plate", "ord", "next")]
    boxes = stored(rows.groupBy("plate", "chunk").agg(*[f(c).alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))]), "orbit-boxes")
    todo = seen.where("next < 0").select("plate", "ord", "x", "y", (_chunk_of("ord", chunk) + 2).alias("chunk"))
    while True:
        dx, dy = (F.greatest(F.abs(F.col(f"t.{c}") - F.col(f"b.{c}0")), F.abs(F.col(f"t.{c}") - F.col(f"b.{c}1"))) for c in "xy")
        on = (F.col("t.plate") == F.col("b.plate")) & (F.col("b.chunk") >= F.col("t.chunk")) & (dx * dx + dy * dy > radius * radius)
        near = todo.alias("t").join(boxes.alias("b"), on).groupBy("t.plate", "t.ord", "t.x", "t.y").agg(F.min("b.chunk").alias("chunk"))
        near = stored(near, "orbit-candidates")
        if near.isEmpty():
            break
        both = rows.withColumn("looks", F.lit(False)).unionByName(near.withColumn("looks", F.lit(True)))
        met = stored(_by_chunk(both, _in_chunk(radius), f"{base}, chunk long, next long", "looks", "ord"), "orbit-met")
        found.append(met.where("next >= 0").select("plate", "ord", "next"))
        todo = met.where("next < 0").select("plate", "ord", "x", "y", (F.col("chunk") + 1).alias("chunk"))
    known = found[0]
    for more in found[1:]:
        known = known.unionByName(more)
    return rows.select("plate", "ord").join(known, ["plate", "ord"], "left")


def _inside(rows: pa.Table, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of sorted rows, their next ones (-1 for none), and the positions of those in their own chunk (-1 if it has left that)."""
    at, to = rows["ord"].to_numpy(), rows["next"].fill_null(-1).to_numpy()
    begin, end = _ends(begins, len(at))
    place = begin + to - at[begin]
    return at, to, np.where((to >= at[begin]) & (place < end), place, -1)


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row beyond the chunk that following next rows leads to, for each row of a chunk."""
    for rows, begins in _whole(batches):
        _, to, place = _inside(rows, begins)
        last = np.where(place < 0, np.arange(len(place)), place)
        while (last[last] != last).any():  # twice as far each time
            last = last[last]
        yield from rows.select(["plate", "ord"]).append_column("exit", pa.array(to[last])).to_batches()


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which rows of a chunk are visited from its entry, which stands behind the row that it names."""
    for both, begins in _whole(batches):
        number, entry = _numbers(both, "ord", "entry")
        named = entry[1:] & ~entry[:-1] & (number[1:] == number[:-1])
        named[begins[1:] - 1] = False
        rows = both.filter(pa.array(~entry))
        if not rows.num_rows:
            continue
        place = _inside(rows, _begins(rows))[2]
        kept = np.zeros(rows.num_rows, bool)
        now = (np.cumsum(~entry) - 1)[1:][named]
        while len(now):
            kept[now] = True
            now = place[now]
            now = now[now >= 0]
        yield from rows.select(["plate", "ord"]).append_column("kept", pa.array(kept)).to_batches()


def orbit(pointers: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``plate, ord, kept``: the rows that following ``next`` from each plate's first row (ord 1) visits.

    ``next`` is later than its row, or null at the end. Within a chunk of rows each row's way out of it is
    followed at once. From chunk to chunk, visited entries are doubled: if all entries of the first 2 ** k hops are
    known, so is the pointer over 2 ** k hops, and both together give twice as many; as many rounds as the
    logarithm of the chunks of the longest plate. Last, each chunk follows its own pointers from its entry.
    """
    ship_package(pointers.sparkSession)
    rows = stored(pointers.select("plate", "ord", "next").withColumn("chunk", _chunk_of("ord", chunk)), "orbit-pointers")
    kind = rows.schema["plate"].dataType.simpleString()
    exits = stored(_by_chunk(rows, _exits, f"plate {kind}, ord long, exit long", "ord").where("exit >= 0"), "orbit-exits")
    first = rows.where("ord = 1").select("plate", F.col("ord").alias("entry"))
    entries = first.unionByName(exits.select("plate", F.col("exit").alias("entry"))).distinct()
    hop = stored(exits.join(entries.withColumnRenamed("entry", "ord"), ["plate", "ord"], "left_semi"), "orbit-hops")
    reached = stored(first, "orbit-reached")
    longest = rows.agg(F.max("chunk")).first()[0] or 0
    for _ in range(int(longest).bit_length()):
        step = reached.join(hop, (reached["plate"] == hop["plate"]) & (reached["entry"] == hop["ord"])).select(hop["plate"], hop["exit"].alias("entry"))
        reached = stored(reached.unionByName(step).distinct(), "orbit-reached")
        a, b = hop.alias("a"), hop.alias("b")
        hop = stored(a.join(b, (F.col("a.plate") == F.col("b.plate")) & (F.col("a.exit") == F.col("b.ord"))).select("a.plate", "a.ord", "b.exit"), "orbit-hops")
    entered = reached.select("plate", F.col("entry").alias("ord"), F.lit(None).cast("long").alias("next"), _chunk_of("entry", chunk).alias("chunk"), F.lit(True).alias("entry"))
    both = rows.withColumn("entry", F.lit(False)).unionByName(entered)
    return _by_chunk(both, _marks, f"plate {kind}, ord long, kept boolean", "ord", "entry")


def kept_orbit(obs: DataFrame, radius: float, chunk: int = CHUNK) -> DataFrame:
    """``plate, ord, kept``: rows farther than ``radius`` from the last kept row of their plate, as ``kinematics.kept_rows`` finds them.

    Which row is kept after a kept one depends on that one alone, so the rows kept are those that the first
    leads to; plates of any length spread over tasks, where the other form reads a plate in one.
    """
    return orbit(next_far(obs, radius, chunk), chunk)
