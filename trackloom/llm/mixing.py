"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import checked_keep, materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2.0
CHUNKS = 256
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """Targets of sources by water-filling: ``(_source, source_size)`` to these and ``target``.

    Sources in code point order, null last, take the weights in turn. A target is its weight times
    one common level, cut at ``most`` times the source's size; sharing the excess again until no
    target is above its cut ends at that level. Sources in order of cut / weight fill up one after
    another, so running sums find the level without a loop. One row per source is in play.
    """
    whole = Window.partitionBy()
    order = Window.orderBy(F.col("_source").isNull(), F.col("_source"))
    filling = Window.orderBy("_ratio", "_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sizes.withColumn("_rank", F.row_number().over(order) - 1).withColumn(
        "_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    )
    ranked = ranked.withColumns(
        {
            "_cut": F.col("source_size") * F.lit(float(most)),
            "_goal": F.sum("source_size").over(whole) * F.lit(float(share)),
            "_all": F.sum("_weight").over(whole),
        }
    ).withColumn("_ratio", F.col("_cut") / F.col("_weight"))
    # the level if exactly the sources before this one are full
    level = F.try_divide(F.col("_goal") - (F.col("_cuts") - F.col("_cut")), F.col("_all") - (F.col("_weights") - F.col("_weight")))
    filled = ranked.withColumns({"_cuts": F.sum("_cut").over(filling), "_weights": F.sum("_weight").over(filling)}).withColumn("_level", level)
    first = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_rank", "_level"))).over(whole)
    found = filled.withColumn("_water", first["_level"])
    target = F.when(F.col("_water").isNull(), F.col("_cut")).otherwise(F.least(F.col("_cut"), F.col("_water") * F.col("_weight")))
    return found.select("_source", "source_size", target.alias("target"))


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 20,
    keep: tuple[str, ...] = (),
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST_COPIES,
) -> DataFrame:
    """Give each row the number of copies that the mix takes of it.

    A row of a source is expected target / source_size times. Rows of a source stand in order of
    size class, then hash part, then size and hashes of id and text; the prefix sum of their expected
    copies plus one offset per source (a hash of the seed and the source) crosses a whole number once
    for each copy, so a row has at most the rate's next whole number of copies. As sizes are in order,
    the words taken stay within about one document of a size class of the target. Counts per (source,
    class, part) give every part's first rank, and each part is ranked on its own, so a source with a
    third of all rows is spread over many tasks (rows equal in id and text share one). The result is the same on each run; only rows that
    are equal in id, text and ``keep`` may swap places.

    Words are counted once, into a work table. A null or empty text has size 0 and takes part; a
    source of size 0 has target 0 and no copies; null sources form one source; texts of any length
    are counted whole; an empty table gives an empty result. ``keep`` names further columns to carry,
    which can't be named as columns of the result are (an error); others are dropped.
    """
    checked_keep(keep, ("doc_id", "size", "source_size", "target", "copies", "taken"))
    text, held = F.col(text_col), F.struct(*[F.col(c) for c in keep]) if keep else F.lit(0)
    base = df.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("_source"),
        word_count(text).alias("size"),
        F.xxhash64(F.col(id_col), text, F.lit(seed)).alias("_hash"),
        F.xxhash64(F.lit(seed), text, held).alias("_more"),
        held.alias("_keep"),
        F.monotonically_increasing_id().alias("_row"),
    )
    base = materialize(base, "mix-rows")
    rows = base.drop("_keep")
    # classes of sizes: the bit length and the next three bits; sizes below 8 are their own class
    rows = rows.withColumn("_class", F.expr("cast(if(size < 8, size, (length(bin(size)) - 4) * 8 + shiftright(size, length(bin(size)) - 4)) as int)"))
    rows = rows.withColumn("_part", F.pmod(F.col("_hash"), F.lit(CHUNKS)).cast("int"))
    counts = rows.groupBy("_source", "_class", "_part").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_words"))
    counts = materialize(counts, "mix-counts")
    targets = source_targets(counts.groupBy("_source").agg(F.sum("_words").alias("source_size")), weights, share, most)
    earlier = Window.partitionBy("_source").orderBy("_class", "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_source", "_class", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    s, t = starts.alias("s"), targets.alias("t")
    plan = s.join(t, F.col("s._source").eqNullSafe(F.col("t._source"))).select(
        "s._source", "s._class", "s._part", "_first", "source_size", "target"
    )
    within = Window.partitionBy("_source", "_class", "_part").orderBy("size", "_hash", "_more", "doc_id")
    r, p = rows.withColumn("_i", F.row_number().over(within) - 1).alias("r"), plan.alias("p")
    ranked = r.join(
        p,
        F.col("r._source").eqNullSafe(F.col("p._source")) & (F.col("r._class") == F.col("p._class")) & (F.col("r._part") == F.col("p._part")),
    ).withColumns(
        {
            "_rate": F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0)),
            "_offset": F.pmod(F.xxhash64(F.lit(seed), F.col("r._source")), F.lit(1 << 20)) / float(1 << 20),
            "_rank": (F.col("_first") + F.col("_i")).cast("double"),
        }
    )
    crossed = F.floor((F.col("_rank") + 1) * F.col("_rate") + F.col("_offset")) - F.floor(F.col("_rank") * F.col("_rate") + F.col("_offset"))
    mixed = ranked.select(
        "doc_id", "size", "source_size", "target", crossed.cast("int").alias("copies"), (crossed * F.col("size")).cast("long").alias("taken"), "_row"
    )
    if not keep:
        return mixed.drop("_row")
    return mixed.join(base.select("_row", "_keep"), "_row").select(*mixed.columns[:-1], *[F.col("_keep")[c].alias(c) for c in keep])
