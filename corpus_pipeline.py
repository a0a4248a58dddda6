"""A corpus pipeline: language ID, near-dedup, decontamination, mixing and sharding of ``documents``.

All stages take nulls in any column, texts of any length, repeated rows, empty tables (of documents
and of ``benchmark``) and further columns, which they drop. Rows that repeat are rows of their own but
for the near-dedup, which keeps one. Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each one's rows to the
shared folder and reads them again as the next one's documents. Stages but the last return the
columns of documents; the last returns the shard and slot of every row of the mix.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import decontaminate, language_id, mixing, sharding, simhash
from trackloom.llm.common import materialize, read_table, ship_package
from trackloom.sources.tables import drop_work_tables, owned_by

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Owners of the work tables that stages make, that the last one makes, and of the stages' outputs within ``run``.
WITHIN, RESULT, OUTPUTS = "pipeline-within", "pipeline-result", "pipeline-outputs"


def stage(owner: str) -> Callable[[Stage], Stage]:
    """Work tables that a stage makes belong to ``owner``. As a stage's result has to be written before the next stage
    is called, those of the stage before are deleted then, but for any that ``docs`` itself still reads. The last stage's
    stay until the caller drops them, as its result is read from them."""

    def owned(function: Stage) -> Stage:
        @wraps(function)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            drop_work_tables(spark, WITHIN, still_read=docs)
            with owned_by(owner):
                return function(spark, docs, sf_dir)

        return run_stage

    return owned


@stage(WITHIN)
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is found and not by a tie.

    Texts that are null or have no letter have no language and go; so does every text if no document
    has both a text and a language to learn from.
    """
    ship_package(spark)
    learned = language_id.learn_dictionaries(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.identify(docs, learned, keep=COLUMNS)
    return found.where(language_id.accepted(F.col("lang_pred"), F.col("score"))).select(*COLUMNS)


@stage(WITHIN)
def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies: SimHash of five-word shingles at a similarity of 0.8.

    A null, empty or blank text is one more text; documents without an id go before others of their
    group. See ``simhash.keep_one``, also for how few pairs its blocks miss.
    """
    ship_package(spark)
    return simhash.keep_one(docs).select(*COLUMNS)


@stage(WITHIN)
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more lies in benchmark windows. Without words there is nothing to drop."""
    found = decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), keep=COLUMNS[1:])
    return found.where(~F.col("contaminated")).select(*COLUMNS)


@stage(WITHIN)
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that sources reach their targets.

    Documents without words have size 0 and are taken as often as others of their source; a source
    of size 0 is dropped; a null source is a source. Rows equal in id and text count each on its own.
    """
    mixed = mixing.mix_sources(docs, keep=COLUMNS[1:])
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*COLUMNS)


@stage(RESULT)
def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row. Rows without an id share a shard."""
    return sharding.shard_documents(docs, 24)


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Compressed sizes and components of near copies can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each stage's output is written before the next begins; what it was made from goes then."""
    docs = read_table(spark, sf_dir, "documents")
    for name, one in STAGES[:-1]:
        with owned_by(OUTPUTS):
            docs = materialize(one(spark, docs, sf_dir), f"pipeline-{name}")
        drop_work_tables(spark, OUTPUTS, still_read=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
