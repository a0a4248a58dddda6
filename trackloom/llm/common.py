"""Helpers that the corpus operators share: work tables, row keys, safe column names, text measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.sources.tables import ship_package, stored

__all__ = ["ascii_lower", "checked_keep", "fresh", "materialize", "read_table", "row_key", "ship_package", "utf8_crc32"]

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back (``stored``), which cuts the lineage.

    Results are read from these tables when the caller runs them, so the caller says when they can go:
    ``drop_work_tables``, of all or of one owner.
    """
    return stored(df, label)


def row_key(*columns: Column) -> Column:
    """128 bits that tell rows apart by these columns; a null is told from any value and from a null elsewhere."""
    known = [c.isNull() for c in columns]
    return F.struct(F.xxhash64(*known, *columns).alias("a"), F.xxhash64(F.lit(1), *reversed(columns), *known).alias("b"))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, made from ``base``."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def checked_keep(keep: tuple[str, ...], made: tuple[str, ...]) -> None:
    """Refuse to carry a column along whose name the result gives to a column of its own."""
    if clash := {c.lower() for c in keep} & set(made):
        raise ValueError(f"the result has columns of its own named {sorted(clash)}: rename these before keeping them")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. A text of ASCII bytes alone takes the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())
    )


def utf8_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as the empty text."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
