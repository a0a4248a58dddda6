"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import checked_keep, materialize, utf8_crc32

#: The generator's multiplier in the published algorithm, as its upper and lower 32 bits.
MULTIPLIER_HI, MULTIPLIER_LO = divmod(2862933555777941757, 1 << 32)
LOW32, LOW16 = (1 << 32) - 1, (1 << 16) - 1
#: A key moves about ln(n) times among n shards; this many moves is out of reach for n < 2**31.
MOST_MOVES = 256
#: Slots are numbered in this many parts of a shard at a time, so no task holds a whole shard.
CHUNKS = 1024


def _next_state(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The 64-bit linear congruential step on two 32-bit halves; no product overflows a long."""
    l1, l0 = F.shiftright(lo, 16), lo.bitwiseAND(LOW16)
    h1, h0 = F.shiftright(hi, 16), hi.bitwiseAND(LOW16)
    upper = l1 * F.lit(MULTIPLIER_LO)
    low = l0 * F.lit(MULTIPLIER_LO) + F.shiftleft(upper.bitwiseAND(LOW16), 16) + F.lit(1)
    high = (
        F.shiftright(low, 32)
        + F.shiftright(upper, 16)
        + (lo * F.lit(MULTIPLIER_HI)).bitwiseAND(LOW32)
        + F.shiftleft((h1 * F.lit(MULTIPLIER_LO)).bitwiseAND(LOW16), 16)
        + h0 * F.lit(MULTIPLIER_LO)
    )
    return high.bitwiseAND(LOW32), low.bitwiseAND(LOW32)


def jump_shards(key: Column, n_shards: int) -> Column:
    """``struct(shard, grown)`` of a 64-bit key: its shard among n and among n + 1.

    The jumps of a key form one rising sequence; the shard among n is its last value below n, so one
    walk gives both. The walk stops changing once it has passed n.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    start = F.struct(
        F.lit(0).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("grown"),
        F.lit(0).cast("long").alias("at"),
        F.shiftright(key, 32).bitwiseAND(LOW32).alias("hi"),
        key.bitwiseAND(LOW32).alias("lo"),
    )

    def step(state: Column, _: Column) -> Column:
        hi, lo = _next_state(state["hi"], state["lo"])
        rand = F.shiftright(hi, 1).cast("double") + 1.0
        # a walk that has passed n stays where it is
        at = F.when(state["at"] > n_shards, state["at"]).otherwise(
            F.least(F.floor((state["at"] + 1).cast("double") * (2147483648.0 / rand)), F.lit(1 << 40)).cast("long")
        )
        return F.struct(
            F.when(at < n_shards, at).otherwise(state["shard"]).alias("shard"),
            F.when(at < n_shards + 1, at).otherwise(state["grown"]).alias("grown"),
            at.alias("at"),
            hi.alias("hi"),
            lo.alias("lo"),
        )

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(min(n_shards + 1, MOST_MOVES))),
        start,
        step,
        lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")),
    )


def with_shard(df: DataFrame, key_col: str, n_shards: int, shard_col: str = "shard") -> DataFrame:
    """Add the shard of each row; a map over the rows, for ``write.partitionBy(shard_col)``."""
    return df.withColumn(shard_col, jump_shards(F.xxhash64(F.col(key_col)), n_shards)["shard"])


def shard_documents(df: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Assign every row a shard by its id and a gapless slot within the shard.

    Law ``key``: the id and the shard count alone decide the shard, so one more shard takes rows
    only into itself (``grown_shard``). Slots start at 0 in each shard. Rows are numbered in
    CHUNKS hash parts of a shard: part totals are summed up (a table of n_shards * CHUNKS rows),
    and each part is numbered on its own, so neither a large shard nor copies of a text under
    ids of their own meet in one task; only rows equal in id and text do. A null id is a key like any other; a null text has size 8 and CRC 0; rows that
    repeat get slots of their own; an empty table gives an empty result. ``keep`` names further
    columns of ``df`` to carry along, which can't be named as columns of the result are (an error);
    other columns are dropped. Texts are read once, for their sizes and sums, into a work table.
    """
    checked_keep(keep, ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"))
    id_, text = F.col(id_col), F.col(text_col)
    rows = df.select(
        id_.alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        utf8_crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shards(F.xxhash64(id_), n_shards).alias("_at"),
        (F.struct(*[F.col(c) for c in keep]) if keep else F.lit(0)).alias("_keep"),
    )
    part = "_part"
    rows = rows.withColumn(part, F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(CHUNKS)).cast("int"))
    rows = rows.withColumns({"shard": F.col("_at.shard"), "grown_shard": F.col("_at.grown")}).drop("_at")
    rows = materialize(rows, "shard-rows")
    totals = rows.groupBy("shard", part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("shard", part).orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("_i", F.row_number().over(within) - 1)
    return numbered.join(offsets, ["shard", part]).select(
        "doc_id",
        "size",
        "text_crc32",
        "law",
        "shard",
        (F.col("_before") + F.col("_i")).cast("long").alias("slot"),
        "grown_shard",
        *[F.col("_keep")[c].alias(c) for c in keep],
    )
