"""Benchmark decontamination as a prefix-filtered containment join, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import ascii_lower, checked_keep, materialize, row_key

WINDOW_WORDS = 13
SHINGLE_WORDS = 3
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word in a text that isn't lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Item windows up to this many rows go to every executor; beyond it, the join shuffles instead, after a
#: sieve of so many bits (a table of a 64th of them in rows, which is what goes to executors then).
BROADCAST_ROWS, SIEVE_BITS = 200_000, 1 << 26
#: Documents with candidates up to this many are named to every executor.
BROADCAST_KEYS = 1_000_000


def words_of(text: Column) -> Column:
    """Lower-cased runs of digits, ASCII letters and all characters beyond ASCII; null has none."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), SEPARATORS), "")


def shingle_at(words: Column, pos: Column, size: int) -> Column:
    """Hash of the ``size`` words from ``pos`` (from 0); null where fewer are left."""
    parts = [F.get(words, pos + i) for i in range(size)]
    return F.when(pos + size <= F.size(words), F.xxhash64(*parts))


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window_words: int = WINDOW_WORDS) -> DataFrame:
    """``item_id, words, n``: each distinct window of an item; an item with fewer words is one window."""
    base = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("_all")).where(F.size("_all") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("_all") - window_words, F.lit(0)))
    return (
        base.select("item_id", "_all", F.explode(starts).alias("_s"))
        .select("item_id", F.slice("_all", F.col("_s") + 1, F.lit(window_words)).alias("words"))
        .distinct()
        .withColumn("n", F.size("words"))
    )


def sieved(tokens: DataFrame, shingles: DataFrame, bits: int = SIEVE_BITS) -> DataFrame:
    """Rows of ``tokens`` whose ``_shingle`` may be one of ``shingles``: all that are, and few others.

    The sieve has one bit for each remainder of a hash, 64 in a row, so it is bounded whatever the benchmark.
    """
    slot = F.pmod(F.col("_shingle"), F.lit(bits))
    word, bit = F.shiftright(slot, 6), slot.bitwiseAND(63).cast("int")
    table = shingles.select(word.alias("_word"), bit.alias("_bit")).distinct()
    table = table.groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    return tokens.withColumn("_word", word).join(F.broadcast(table), "_word").where(F.getbit("_bits", bit) == 1).select(tokens.columns)


def find_occurrences(docs: DataFrame, items: DataFrame, window_words: int = WINDOW_WORDS) -> DataFrame:
    """``_doc, start, n, item_ids`` of each item window in each document's ``_words``; ``_doc`` is a row's own number.

    Exact containment needs every shingle of a window, so its prefix is one shingle. Shingles of
    windows are ordered by how often the whole corpus has them, and a window is looked up by its
    rarest alone. A candidate must lie where the window fits the document (positional and length
    bounds), and is verified word for word over the window. Windows that items share are looked up
    once. Where windows are too many to go to every executor, shingles of documents pass a bounded
    sieve first; what passes is shuffled without text, and words come back to candidates by document.
    """
    windows = items.groupBy("words", "n").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    windows = materialize(windows.withColumn("_w", F.xxhash64("words")), "item-windows")
    small = windows.count() * window_words <= BROADCAST_ROWS
    sizes = sorted({min(r["n"], SHINGLE_WORDS) for r in windows.select("n").distinct().collect()})
    found = None
    for size in sizes:
        own = windows.where(F.least("n", F.lit(SHINGLE_WORDS)) == size)
        places = own.select("words", "n", "item_ids", "_w", F.explode(F.sequence(F.lit(0), F.col("n") - size)).alias("_at"))
        places = places.withColumn("_shingle", shingle_at(F.col("words"), F.col("_at"), size))
        spread = docs.select("_doc", "_words", F.posexplode("_words").alias("_pos", "_word"))
        tokens = spread.withColumn("_shingle", shingle_at(F.col("_words"), F.col("_pos"), size)).where("_shingle is not null")
        shingles = places.select("_shingle").distinct()
        if small:
            counts = tokens.select("_shingle").join(F.broadcast(shingles), "_shingle", "left_semi").groupBy("_shingle").agg(F.count(F.lit(1)).alias("_df"))
        else:
            counts = sieved(tokens.select("_shingle"), shingles).groupBy("_shingle").agg(F.count(F.lit(1)).alias("_df"))
        rarity = materialize(counts, "shingle-counts")
        ranked = Window.partitionBy("_w", "words").orderBy("_df", "_at")
        # a shingle that no document has makes its window impossible
        prefixes = (
            places.join(rarity, "_shingle", "left")
            .withColumn("_df", F.coalesce("_df", F.lit(0)))
            .withColumn("_order", F.row_number().over(ranked))
            .where("_order = 1 and _df > 0")
            .select("_shingle", "_at", "n", "item_ids", F.col("words").alias("_window"))
        )
        start = F.col("_pos") - F.col("_at")
        same = F.slice("_words", start + 1, F.col("n")) == F.col("_window")
        if small:
            fits = (start >= 0) & (start + F.col("n") <= F.size("_words"))
            d, p = tokens.alias("d"), F.broadcast(prefixes).alias("p")
            hits = d.join(p, (F.col("d._shingle") == F.col("p._shingle")) & fits & same).select("_doc", start.alias("start"), "n", "item_ids")
        else:
            prefixes = materialize(prefixes, "item-prefixes")
            bare = sieved(tokens.select("_doc", "_pos", "_shingle", F.size("_words").alias("_len")), prefixes.select("_shingle"))
            room = (start >= 0) & (start + F.col("n") <= F.col("_len"))
            candidates = bare.join(prefixes, "_shingle").where(room).select("_doc", "_pos", "_at", "n", "item_ids", "_window")
            candidates = materialize(candidates, "window-candidates")
            ids = candidates.select("_doc").distinct()
            # words of few documents come back to candidates, without the rest being shuffled
            near = docs.join(F.broadcast(ids), "_doc", "left_semi") if ids.count() <= BROADCAST_KEYS else docs
            hits = candidates.join(near, "_doc").where(same).select("_doc", start.alias("start"), "n", "item_ids")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = docs.sparkSession.sql("SELECT 0L AS _doc, 0 AS start, 0 AS n, array('') AS item_ids").where("false")
    return found


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window_words: int = WINDOW_WORDS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Which words of each document lie in windows of benchmark items, and whether that is too many.

    Returns ``doc_id, n_words, n_hit, n_items, item_ids, contaminated`` for each row: contaminated
    if a word is hit and hit words are a twentieth of all or more. Null texts have no words and are
    clean; items without words (or null) match nothing; windows of items without an id hit words, but
    are no item in ``n_items`` and ``item_ids``; repeated rows each get the same figures; texts of any
    length are taken whole; an empty benchmark leaves all documents clean; an empty table gives an
    empty result. ``keep`` names columns of ``docs`` to carry along, which can't be named as columns
    of the result are (an error); others are dropped. Texts are cut into words once, into a work table
    without them; with ``keep``, what was found comes back to the rows by hashes of id and text.
    """
    checked_keep(keep, ("doc_id", "n_words", "n_hit", "n_items", "item_ids", "contaminated"))
    text = F.col(text_col)
    key = row_key(F.col(id_col), text)
    base = docs.select(F.monotonically_increasing_id().alias("_doc"), F.col(id_col).alias("doc_id"), words_of(text).alias("_words"), (key if keep else F.lit(0)).alias("_key"))
    base = materialize(base.withColumn("n_words", F.size("_words").cast("long")), "document-words")
    found = find_occurrences(base.select("_doc", "_words"), item_windows(benchmark, item_id_col, item_text_col, window_words), window_words)
    cover = F.aggregate(
        F.array_sort("_spans"),
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("hit")),
        lambda s, x: F.struct(
            F.greatest(s["end"], x["end"]).alias("end"), (s["hit"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["end"], x["start"]))).alias("hit")
        ),
        lambda s: s["hit"],
    )
    per_doc = (
        found.groupBy("_doc")
        .agg(
            F.collect_set(F.struct(F.col("start").cast("long").alias("start"), (F.col("start") + F.col("n")).cast("long").alias("end"))).alias("_spans"),
            F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("_items"),
        )
        .select("_doc", cover.alias("_hit"), F.array_sort(F.transform("_items", lambda x: x.cast("string"))).alias("_items"))
    )
    per_doc = materialize(per_doc, "doc-hits")
    n_hit = F.coalesce("_hit", F.lit(0)).cast("long")
    items = F.coalesce("_items", F.array().cast("array<string>"))
    rows, on = base.drop("_words"), "_doc"
    if keep:
        held = F.struct(*[F.col(c) for c in keep]).alias("_keep")
        n_words = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("n_words")
        rows, on = docs.select(F.col(id_col).alias("doc_id"), n_words, key.alias("_key"), held), "_key"
        per_doc = per_doc.join(base.select("_doc", "_key"), "_doc").drop("_doc").dropDuplicates(["_key"])
    return rows.join(per_doc, on, "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        items.alias("item_ids"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
        *[F.col("_keep")[c].alias(c) for c in keep],
    )
