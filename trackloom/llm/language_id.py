"""Language identification by compression with per-language zstandard dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import checked_keep, materialize, ship_package

UNKNOWN = "und"
#: Bounds of what is learned: samples of a language, characters of each, languages.
SAMPLES, SAMPLE_CHARS, LANGUAGES = 96, 1024, 256
#: Texts are compressed in pieces of this many bytes, so that a dictionary counts all along a long text.
PIECE = 1024
#: Match search that finds repeats of four bytes, as short words need; fast levels look for six or more.
SEARCH = {"window_log": 18, "chain_log": 14, "hash_log": 15, "search_log": 3, "min_match": 4, "target_length": 8}
#: Texts whose two smallest sizes differ by less than this share are rejected: ties, in effect.
MIN_MARGIN = 0.002


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def learn_dictionaries(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", samples: int = SAMPLES, chars: int = SAMPLE_CHARS, languages: int = LANGUAGES
) -> dict[str, bytes]:
    """Raw-content dictionaries of a bounded sample of labelled texts.

    Hashes of texts fall into ``samples`` buckets; the smallest of each language and bucket wins, a
    plain aggregate over all rows. The beginnings of at most samples * languages texts come to the
    driver; of more languages, those that fill most buckets are learned, by name where they are equal.
    Rows whose text is null or blank or whose language is null teach nothing; rows that repeat teach
    once; an empty table gives no dictionary; other columns are ignored.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.trim(text_col) != "")).select(
        F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("_h"), F.col(text_col).alias("_text")
    )
    wins = rows.groupBy("lang", F.pmod("_h", F.lit(samples)).alias("_bucket")).agg(F.min("_h").alias("_h")).select("lang", "_h")
    wins = materialize(wins, "language-samples")
    common = wins.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    wins = wins.join(common, "lang", "left_semi").collect()
    if not wins:
        return {}
    texts = rows.where(F.col("_h").isin([r["_h"] for r in wins])).select("lang", "_h", F.substring("_text", 1, chars).alias("_text"))
    texts = texts.groupBy("lang", "_h").agg(F.first("_text").alias("_text")).collect()
    found: dict[str, list[str]] = {}
    for r in sorted(texts, key=lambda r: (r["lang"], r["_h"])):
        found.setdefault(r["lang"], []).append(r["_text"])
    return {lang: "\n".join(parts).lower().encode() for lang, parts in found.items()}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        params = zstd.ZstdCompressionParameters(**SEARCH, strategy=zstd.STRATEGY_LAZY, write_content_size=0, write_dict_id=0)
        self.langs = sorted(dictionaries)
        self.coders = []
        for lang in self.langs:
            d = zstd.ZstdCompressionDict(dictionaries[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.coders.append(zstd.ZstdCompressor(dict_data=d, compression_params=params))

    def sizes(self, text: str) -> list[int]:
        """Compressed bytes of the whole text in lower case, by language."""
        data = text.lower().encode()
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.coders]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of the smallest size, and by which share the next is larger; ties go to the first by name."""
        if not self.langs or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        sizes = self.sizes(text)
        best = int(np.argmin(sizes))
        if len(sizes) == 1:
            return self.langs[0], 1.0
        rest = min(s for i, s in enumerate(sizes) if i != best)
        return self.langs[best], (rest - sizes[best]) / rest


def identify(df: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep..., lang_pred, score`` of each row, from its whole text alone.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing was
    learned. Texts of any length are compressed whole, piece by piece. Repeated rows stay repeated, an
    empty table gives an empty result. ``keep`` can't name columns as the result's own are (an error).
    """
    checked_keep(keep, ("lang_pred", "score"))
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(dictionaries)  # bounded by the sample that taught it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(shared.value)
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            made = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=names)

    rows = df.select(*[F.col(c) for c in keep], F.col(text_col).alias("_text"))
    names = [*keep, "lang_pred", "score"]
    kinds = [f.dataType.simpleString() for f in rows.schema.fields[:-1]] + ["string", "double"]
    return rows.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))


def accepted(pred: Column, score: Column, min_margin: float = MIN_MARGIN) -> Column:
    """False for texts without a language and for narrow margins."""
    return (pred != UNKNOWN) & (score >= min_margin)
