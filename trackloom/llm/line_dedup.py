"""Removal of boilerplate lines that spread over many sites, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import materialize, row_key

#: A line on this many distinct sites is boilerplate.
SITES = 10
#: Sketch size (log2 of registers) and the band, as a share of SITES, in which sketches aren't trusted.
SKETCH_BITS, BAND = 11, 0.25


def line_key(line: Column) -> Column:
    """128 bits of a line without its outer blanks; null where nothing is left."""
    bare = F.trim(line)
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(1), bare).alias("b")))


def boilerplate_keys(lines: DataFrame, min_sites: int = SITES, bits: int = SKETCH_BITS, band: float = BAND) -> DataFrame:
    """Keys of the lines on ``min_sites`` sites or more, from ``(key, site)`` rows.

    HyperLogLog sketches of sites are built per key within each task that reads lines and merged in
    the final aggregation, so the most frequent line sends one sketch per task. Keys whose estimate
    falls in the band around the threshold get an exact distinct count instead; the band is many
    standard errors wide, and beyond it the sketch decides. The distinct count, too, begins within tasks.
    """
    sketched = lines.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(bits))).alias("_sites"))
    sketched = materialize(sketched.where(F.col("_sites") >= min_sites * (1 - band)), "lines-sketched")
    sure = sketched.where(F.col("_sites") > min_sites * (1 + band)).select("key")
    near = sketched.where(F.col("_sites") <= min_sites * (1 + band)).select("key")
    pairs = lines.groupBy("key", "site").agg(F.count(F.lit(1)).alias("_rows"))
    exact = pairs.join(near, "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_sites).select("key")
    return sure.unionByName(exact)


def dedup_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = SITES
) -> DataFrame:
    """Remove from every text the lines that stand on ``min_sites`` distinct sites or more.

    Lines end at line feeds and are compared without outer blanks (spaces alone, so a line that ends in
    a carriage return is another line); blank lines always stay. Texts of any length are taken whole. A null
    site counts as one site of its own (it is named by the empty text). Returns ``doc_id, clean_text,
    n_lines, n_removed`` for each row; a null text stays null with no lines, repeated rows stay
    repeated, an empty table gives an empty result, other columns are dropped. Rows keep their text
    while the positions of bad lines, found on hashes alone, come to them by document.
    """
    base = df.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site")
    ).withColumn("_doc", row_key(F.col("doc_id"), F.col("_text")))
    lines = base.select("_doc", "site", F.posexplode(F.split("_text", "\n")).alias("_pos", "_line")).select(
        "_doc", "site", "_pos", line_key(F.col("_line")).alias("key")
    )
    lines = materialize(lines.where(F.col("key").isNotNull()), "lines")
    bad = boilerplate_keys(lines.select("key", "site"), min_sites)
    hits = lines.join(bad, "key", "left_semi").groupBy("_doc").agg(F.collect_set("_pos").alias("_bad"))
    parts = F.split("_text", "\n")
    # positions that stay, by a hash set; the outer arrays of one hold what is to be computed once for all lines
    stay = lambda p: F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("_bad"))
    kept = F.get(F.transform(F.array(parts), lambda p: F.transform(stay(p), lambda i: F.get(p, i))), F.lit(0))
    text = F.when(F.col("_bad").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n"))
    return base.join(hits, "_doc", "left").select(
        "doc_id",
        text.alias("clean_text"),
        F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_bad"), F.lit(0)).cast("long").alias("n_removed"),
    )
