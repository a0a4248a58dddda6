"""Audit of how filters interact: counts for all orders of five filters from one cube over their failure flags."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import ASCII_UPPER, materialize

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 200, 50, 3
SYMBOLS = r"[#$%&*|]"
SEPARATORS = r"[\x20\x09-\x0D]+"
MEASURES = ("n", "n_good", "n_toxic")


def failures(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", least_words: int = LEAST_WORDS, least_distinct: int = LEAST_DISTINCT, most_upper: int = MOST_UPPER
) -> DataFrame:
    """``doc_id, part, A, B, C, D, E``: which filters each row fails.

    A: fewer than ``least_words`` words. B: less than ``least_distinct`` percent of the words are distinct.
    C: more than ``most_upper`` percent of the code points are A to Z. D: a symbol of SYMBOLS occurs.
    E: the text is that of a row with a smaller id, in the whole table. Null texts are empty (and so are
    each other's copies), null parts the empty string; an id that is null comes after all others, and rows
    of equal id and text aren't copies of each other. Texts are read whole, once; the smallest id of
    each text is a partial aggregate by 128 bits of its hash, so a text with very many copies comes
    together as one row a task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, SEPARATORS), lambda w: w != "")
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.xxhash64(text).alias("_a"),
        F.xxhash64(F.lit(1), text).alias("_b"),
        F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("kinds")))[0].alias("_w"),
        (F.char_length(text) - F.char_length(F.translate(text, ASCII_UPPER, ""))).cast("long").alias("_upper"),
        F.char_length(text).cast("long").alias("_chars"),
        text.rlike(SYMBOLS).alias("D"),
    )
    rows = materialize(rows.select("doc_id", "part", "_a", "_b", "_w.words", "_w.kinds", "_upper", "_chars", "D"), "audit-rows")
    firsts = rows.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_rows"), F.min("doc_id").alias("_first")).where("_rows > 1")
    firsts = materialize(firsts, "audit-copies")  # so that the join below may split a text with very many copies
    later = (F.col("doc_id") > F.col("_first")) | (F.col("doc_id").isNull() & F.col("_first").isNotNull())
    return rows.join(firsts, ["_a", "_b"], "left").select(
        "doc_id",
        "part",
        (F.col("words") < least_words).alias("A"),
        (100 * F.col("kinds").cast("long") < least_distinct * F.col("words").cast("long")).alias("B"),
        (100 * F.col("_upper") > most_upper * F.col("_chars")).alias("C"),
        "D",
        F.coalesce(later, F.lit(False)).alias("E"),
    )


def survivors(flags: DataFrame, filters: str = FILTERS, by: str = "part") -> DataFrame:
    """``by, mask, n, n_good, n_toxic``: rows that pass all filters of each subset (bit i: the i-th filter), by part and in all.

    One CUBE over the flags and the part: a grouping set that keeps the flags of a subset and has them
    all false counts the subset's survivors; where the part is rolled up, ``by`` is null. Subsets
    without survivors have rows of zeros. Rows are counted by (part, flags) first, so the cube expands
    a table of at most 2 ** filters rows a part, whatever the input.
    """
    flag = {c: f"_f{i}" for i, c in enumerate(filters)}
    cells = flags.groupBy(F.col(by).alias("_part"), *[F.col(c).alias(f) for c, f in flag.items()]).agg(*[F.sum(F.col(m).cast("long")).alias(f"_{m}") for m in MEASURES])
    chosen = [F.grouping(f) == 0 for f in flag.values()]
    mask = sum((F.when(on, F.lit(1 << i)).otherwise(0) for i, on in enumerate(chosen)), F.lit(0))
    cube = cells.cube("_part", *flag.values()).agg(mask.alias("mask"), F.grouping("_part").alias("_all"), *[F.sum(f"_{m}").alias(m) for m in MEASURES])
    passed = cube.where(" AND ".join(f"NOT coalesce({f}, false)" for f in flag.values())).select(F.col("_part").alias(by), "_all", "mask", *MEASURES)
    every = passed.where("mask = 0").select(F.col(by).alias("_by"), F.col("_all").alias("_a"), F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("_m"))
    same = F.col("_by").eqNullSafe(F.col(by)) & (F.col("_a") == F.col("_all")) & (F.col("_m") == F.col("mask"))
    return every.join(passed, same, "left").select(F.col("_by").alias(by), F.col("_m").alias("mask"), *[F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in MEASURES])


def audit(flags: DataFrame, filters: str = FILTERS, by: str = "part") -> DataFrame:
    """What each filter removes at each step of every order of the filters, by part and in all (``by`` is null).

    ``flags`` has a boolean column for each filter, ``by``, and n, n_good, n_toxic (1 or 0 a row, or
    counts). Returns ``by, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley``. A step goes from one subset of filters to the next larger one, so its
    figures are differences of two rows of ``survivors``. Flags that are null count as passed. An empty
    table gives no rows.
    """
    last = len(filters)
    whole = (1 << last) - 1
    steps = []
    for order in permutations(range(last)):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append(("".join(filters[i] for i in order), step, f, before, before | 1 << f, 1 << f, whole ^ 1 << f))
            before |= 1 << f
    spark = flags.sparkSession
    # as many rows as orders have steps, whatever the input
    plan = spark.createDataFrame(steps, "filter_order string, step int, _filter int, _before int, _after int, _alone int, _others int")
    clean = flags.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in filters})
    alive = materialize(survivors(clean, filters, by), "audit-survivors")

    def of(subset: str, prefix: str) -> DataFrame:
        return alive.select(F.col(by).alias(f"{prefix}_by"), F.col("mask").alias(subset), *[F.col(m).alias(f"{prefix}_{m}") for m in MEASURES])

    def joined(left: DataFrame, subset: str, prefix: str) -> DataFrame:
        right = of(subset, prefix)
        on = [left[subset] == right[subset], F.col("b_by").eqNullSafe(F.col(f"{prefix}_by"))]
        return left.join(right, on[:1] if prefix == "b" else on).drop(right[subset])

    found = joined(plan, "_before", "b")
    found = joined(found, "_after", "a")
    found = joined(found, "_alone", "s")
    found = joined(found, "_others", "o")
    ends = alive.where(F.col("mask").isin(0, whole)).groupBy(F.col(by).alias("_of")).agg(F.max("n").alias("_total"), F.min("n").alias("_least"))
    found = found.join(ends, F.col("b_by").eqNullSafe(F.col("_of")))
    found = found.withColumn("removed", F.col("b_n") - F.col("a_n"))
    shapley = found.groupBy(F.col("b_by").alias("_sh"), F.col("_filter").alias("_shf")).agg(F.sum("removed").alias("shapley"))
    found = found.join(shapley, F.col("b_by").eqNullSafe(F.col("_sh")) & (F.col("_filter") == F.col("_shf")))
    return found.select(
        F.col("b_by").alias(by),
        "filter_order",
        "step",
        F.col("a_n").alias("kept"),
        "removed",
        (F.col("_total") - F.col("s_n") - F.col("removed")).alias("redundant"),
        (F.col("o_n") - F.col("_least")).alias("unique_fails"),
        (F.col("b_n_good") - F.col("a_n_good")).alias("good_lost"),
        (F.col("b_n_toxic") - F.col("a_n_toxic")).alias("toxic_lost"),
        "shapley",
    )


def labelled(flags: DataFrame, labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """``flags`` with n = 1 and whether any label of the row's id says good (n_good) or toxic (n_toxic), as 0 or 1.

    Labels may repeat or miss an id, and be null; a row without an id has none.
    """
    says = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    own = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(says(quality_col).alias("n_good"), says(toxic_col).alias("n_toxic"))
    rows = flags.join(own, flags[id_col] == F.col("_id"), "left").drop("_id")
    return rows.withColumns({"n": F.lit(1), "n_good": F.coalesce("n_good", F.lit(0)), "n_toxic": F.coalesce("n_toxic", F.lit(0))})
