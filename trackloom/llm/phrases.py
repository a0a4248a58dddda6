"""Removal of long repeated word passages: recurring windows are confirmed, spelled into Aho-Corasick automata, and all texts stream through these."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import materialize, ship_package
from trackloom.llm.suffix_dedup import BROADCAST_KEYS, piece_hashes

LENGTH = 35
#: Words of an anchor: each window's anchor is its run of so many words with the least hash.
ANCHOR = 16
#: Bytes of text that a block of documents holds on average, and windows that one automaton spells.
BLOCK_BYTES, SHARD_WINDOWS = 1 << 20, 1 << 15
#: Anchors whose windows are first seen in more texts than this meet blocks window by window; blocks that a text serves at a time.
WIDE, SERVED = 8, 64
#: Windows whose anchors are found at a time.
STEP = 1 << 18


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def anchor_of(grams: np.ndarray, n: int) -> np.ndarray:
    """For each run of ``n`` gram hashes the position of the least one, the leftmost of equals."""
    out = []
    for base in range(0, len(grams) - n + 1, STEP):
        part = grams[base : base + STEP + n - 1]
        least = (part & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(part), dtype=np.uint64)
        k = 1
        while 2 * k <= n:
            least = np.minimum(least[:-k], least[k:])
            k *= 2
        if k < n:
            least = np.minimum(least[: len(least) - (n - k)], least[n - k :])
        out.append((least & np.uint64(0xFFFFFF)).astype(np.int64) + base)
    return np.concatenate(out) if out else np.empty(0, np.int64)


class Windows:
    """Of one text's words: window hashes, and the hash of each window's anchor."""

    def __init__(self, words: list[bytes], length: int, size: int):
        self.hashes = word_hashes(words)
        if len(words) < length:
            self.window, self.anchor, self.at = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
            return
        grams = piece_hashes(self.hashes, size)
        self.at = anchor_of(grams, length - size + 1)
        self.anchor = grams[self.at].view(np.int64)
        self.window = piece_hashes(self.hashes, length).view(np.int64)


def _scan(length: int, size: int, texts: bool):
    """Number of words, digest of the words, and hashes of anchors of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sha, anchors, twice, joined = [], [], [], [], []
            for text in b.column("text").cast(pa.binary()):
                words = text.as_py().split()
                whole = b" ".join(words)
                found = Windows(words, length, size)
                own, count = np.unique(found.anchor[np.unique(found.at, return_index=True)[1]], return_counts=True)
                n.append(len(words))
                sha.append(hashlib.sha256(whole).hexdigest())
                anchors.append(own.tolist())
                twice.append(own[count > 1].tolist())
                joined.append(whole.decode())
            longs = pa.list_(pa.int64())
            made = [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(anchors, longs), pa.array(twice, longs)]
            names = ["n_words", "whole", "anchors", "twice"]
            if texts:
                made, names = [*made, pa.array(joined, pa.string())], [*names, "joined"]
            rest = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *made], names=[*rest, *names])

    return run


def _members(values: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Which values are among ``chosen``."""
    if not len(chosen):
        return np.zeros(len(values), bool)
    chosen = np.sort(chosen)
    return chosen[np.minimum(np.searchsorted(chosen, values), len(chosen) - 1)] == values


def _window_rows(length: int, size: int):
    """Windows of each text at those of its anchors that occur again: ``h, w, row, block``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, block, text, hs in zip(b.column("row").to_pylist(), b.column("block").to_pylist(), b.column("text").cast(pa.binary()), b.column("anchors")):
                found = Windows(text.as_py().split(), length, size)
                near = _members(found.anchor, hs.values.to_numpy())
                if near.any():
                    n = int(near.sum())
                    made = [pa.array(found.anchor[near]), pa.array(found.window[near]), pa.array(np.full(n, row)), pa.array(np.full(n, block))]
                    yield pa.RecordBatch.from_arrays(made, names=["h", "w", "row", "block"])

    return run


def _window_lists(length: int, size: int):
    """Windows of each text as one row for each anchor that occurs again: ``h, block, ws``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            anchors, blocks, lists = [], [], []
            for block, text, hs in zip(b.column("block").to_pylist(), b.column("text").cast(pa.binary()), b.column("anchors")):
                found = Windows(text.as_py().split(), length, size)
                near = np.flatnonzero(_members(found.anchor, hs.values.to_numpy()))
                by = near[np.argsort(found.anchor[near], kind="stable")]
                for part in np.split(by, np.flatnonzero(np.diff(found.anchor[by])) + 1) if len(by) else []:
                    anchors.append(int(found.anchor[part[0]]))
                    blocks.append(block)
                    lists.append(found.window[part].tolist())
            if anchors:
                yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(blocks), pa.array(lists, pa.list_(pa.int64()))], names=["h", "block", "ws"])

    return run


#: Windows that a task remembers, so that it names each but once; it starts anew beyond this.
REMEMBERED = 1 << 20


def _first_named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``block, h, w`` from lists of windows; copies of a passage in one task give their windows once."""
    seen: set[tuple[int, int, int]] = set()
    for b in batches:
        rows = []
        for h, block, ws in zip(b.column("h").to_pylist(), b.column("block").to_pylist(), b.column("ws").to_pylist()):
            for w in ws:
                if (block, h, w) not in seen:
                    seen.add((block, h, w))
                    rows.append((block, h, w))
        if len(seen) > REMEMBERED:
            seen.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["block", "h", "w"])


def _runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return zip(edges[::2].tolist(), edges[1::2].tolist())


def _passages(length: int, size: int):
    """Passages of confirmed windows, from the text that has them first to each block that needs them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, mine, needs in zip(b.column("text").cast(pa.binary()), b.column("mine"), b.column("needs")):
                words = text.as_py().split()
                found = Windows(words, length, size)
                mine = mine.values
                h, w = (mine.field(c).to_numpy(zero_copy_only=False) for c in ("h", "w"))
                # h and w are both hashes; their sum names the pair
                pair = found.anchor + found.window
                confirmed = _members(pair, h + w)
                needs = needs.values
                block, nh, nw = (needs.field(c) for c in ("block", "h", "w"))
                wide = nw.is_valid().to_numpy(zero_copy_only=False)
                block, nh, nw = block.to_numpy(zero_copy_only=False), nh.to_numpy(zero_copy_only=False), nw.fill_null(0).to_numpy(zero_copy_only=False)
                blocks, out = [], []
                for one in np.unique(block).tolist():
                    own = block == one
                    asked = confirmed & (_members(found.anchor, nh[own & ~wide]) | _members(pair, (nh + nw)[own & wide]))
                    for s, e in _runs(asked):
                        blocks.append(one)
                        out.append(b" ".join(words[s : e + length - 1]).decode())
                if out:
                    nothing = pa.nulls(len(out), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.nulls(len(out), pa.int64()).fill_null(0), nothing, nothing, pa.array(out)], names=["block", "kind", "a", "b", "text"])

    return run


def letter_words(length: int) -> int:
    """Words that one letter stands for: the greatest divisor of ``length`` up to 5, so that a window is a whole number of letters."""
    return max(k for k in range(1, 6) if length % k == 0)


class Spelling:
    """The windows of some words as strings of two characters a letter, with a window hash each."""

    def __init__(self, words: list[bytes], length: int):
        self.length, self.step = length, letter_words(length)
        hashes = word_hashes(words)
        self.window = piece_hashes(hashes, length).view(np.int64) if len(words) >= length else np.empty(0, np.int64)
        letters = (piece_hashes(hashes, self.step) >> np.uint64(48)).astype("<u2") if len(words) >= self.step else np.empty(0, "<u2")
        # one string for each phase, as a window's letters are ``step`` words apart
        self.phases = [letters[p :: self.step].tobytes().decode("latin-1") for p in range(self.step)]

    def spelled(self, start: int) -> str:
        at = start // self.step * 2
        return self.phases[start % self.step][at : at + self.length // self.step * 2]


def automaton(patterns: dict[int, str]) -> tuple[ahocorasick.Automaton, np.ndarray]:
    """One automaton for the given windows (by hash), and their hashes in the order of its values.

    Windows that are spelled alike share an end of the automaton; its value is then the first of a run of
    equal spellings in the array, which is in order of spelling.
    """
    order = sorted(patterns.items(), key=lambda x: x[1])
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, (_, spelled) in enumerate(order):
        if not i or order[i - 1][1] != spelled:
            machine.add_word(spelled, i)
    machine.make_automaton()
    return machine, np.array([h for h, _ in order], np.int64)


def occurrences(machine: ahocorasick.Automaton, known: np.ndarray, text: Spelling) -> np.ndarray:
    """Starts of the windows of ``text`` that the automaton spells; each is checked by its window hash."""
    width = text.length // text.step * 2
    starts = []
    for phase, letters in enumerate(text.phases):
        ends = [end for end, _ in machine.iter(letters)]
        if ends:
            at = np.array(ends, np.int64) - width + 1
            starts.append(at[at % 2 == 0] // 2 * text.step + phase)
    if not starts:
        return np.empty(0, np.int64)
    found = np.concatenate(starts)
    return found[_members(text.window[found], known)]


def _stream(length: int, shard: int):
    """Texts of a block through the automata of its passages: the spans of words that recurring windows cover.

    Rows come in order of block, passages before texts. A block's windows are spelled into automata of
    ``shard`` windows each, one after another, so an automaton's size is bounded however many there are.
    """

    def close(patterns: dict[int, str], texts: list[tuple[int, int, list[bytes], Spelling, np.ndarray]]) -> None:
        machine, known = automaton(patterns)
        for *_, spelling, cover in texts:
            found = occurrences(machine, known, spelling)
            np.add.at(cover, found, 1)
            np.add.at(cover, found + length, -1)

    def finish(passages: list[bytes], texts: list[tuple]) -> Iterator[pa.RecordBatch]:
        patterns: dict[int, str] = {}
        for passage in passages:
            spelling = Spelling(passage.split(), length)
            for s, h in enumerate(spelling.window.tolist()):
                if h not in patterns:
                    patterns[h] = spelling.spelled(s)
                    if len(patterns) >= shard:
                        close(patterns, texts)
                        patterns = {}
        if patterns:
            close(patterns, texts)
        out = []
        for a, b, words, _, cover in texts:
            gone = np.cumsum(cover[:-1]) > 0
            if gone.any():
                kept = b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()])
                spans = [{"start": s, "end": e} for s, e in _runs(gone)]
                out.append((a, b, int(gone.sum()), hashlib.sha256(kept).hexdigest(), spans))
        if out:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["a", "b", "n_removed", "kept", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, passages, texts = None, [], []
        for b in batches:
            for block, kind, x, y, text in zip(*(b.column(c).to_pylist() for c in ("block", "kind", "a", "b")), b.column("text").cast(pa.binary()).to_pylist()):
                if block != now:
                    yield from finish(passages, texts)
                    now, passages, texts = block, [], []
                if kind == 0:
                    passages.append(text)
                elif passages:  # a block without passages has nothing to find
                    words = text.split()
                    texts.append((x, y, words, Spelling(words, length), np.zeros(len(words) + 1, np.int32)))
        yield from finish(passages, texts)

    return run


def _broadcast_if_few(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def outside(words: Column, spans: Column) -> Column:
    """The words whose positions lie in no span."""
    gone = F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["end"] - 1)))
    stay = F.array_except(F.sequence(F.lit(0).cast("long"), F.size(words).cast("long") - 1), gone)
    return F.transform(stay, lambda i: F.get(words, i.cast("int")))


def remove_phrases(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    size: int = ANCHOR,
    texts: bool = False,
    block_bytes: int = BLOCK_BYTES,
    shard: int = SHARD_WINDOWS,
    wide: int = WIDE,
) -> DataFrame:
    """Remove every word that lies in a window of ``length`` words which starts anywhere else too.

    Returns ``doc_id, n_words, n_removed, kept_sha256, spans`` for each row (spans: ranges of removed word
    positions, null where none are), and with ``texts`` also ``clean_text``, the kept words joined by spaces.

    1. Equal windows have equal anchors, so only windows at anchors that occur again can recur. Anchors are
       counted over all texts, then the windows at repeated ones, by 128 bits of their words' hashes; those
       that start twice are confirmed, and belong to the first text that has them.
    2. Texts fall into blocks of bounded size. A block gets the confirmed passages that it may contain, cut
       from the texts they belong to, and compiles them into automata of at most ``shard`` windows.
       Only anchors tell which passages a block gets, so an anchor that passages of many texts share (over
       ``wide``) is told apart by whole windows instead: no block gets more windows than it has.
    3. All texts with repeated anchors stream through their block's automata, which find each occurrence.

    Texts that are equal as a whole are read once; with ``length`` words or more they lose all words, as
    each window starts in a copy. Null has no words; shorter texts keep all; texts of any length are read
    whole; rows that repeat are copies of each other; ids may be null; an empty table gives an empty result;
    other columns are dropped.
    """
    spark = df.sparkSession
    ship_package(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"), text.alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, a long, b long, n_words long, whole string, anchors array<long>, twice array<long>" + ", joined string" * texts
    rows = materialize(docs.mapInArrow(_scan(length, size, texts), columns), "phrase-rows")

    key = ["a", "b"]
    copied = rows.where(F.col("n_words") >= length).groupBy(*key).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(*key)
    copied = materialize(copied, "phrase-copies")
    each = rows.select(*key, F.explode("anchors").alias("h"))
    again = each.groupBy("h").agg((F.min("a") != F.max("a")).alias("more")).where("more").select("h")
    again = materialize(again.unionByName(rows.select(F.explode("twice").alias("h"))).distinct(), "phrase-anchors")
    marked = each.join(_broadcast_if_few(again), "h").groupBy(*key).agg(F.collect_set("h").alias("anchors"))
    marked = materialize(marked, "phrase-marked")
    few = docs.where(F.octet_length("text") >= 2 * length - 1).select(*key, "text")
    if (n := marked.count()) <= BROADCAST_KEYS:
        few = few.join(F.broadcast(marked.select(*key)), key, "left_semi")
    work = few.dropDuplicates(key).join(marked, key).select(F.monotonically_increasing_id().alias("row"), *key, "text", "anchors", F.octet_length("text").alias("n_bytes"))
    work = materialize(work, "phrase-texts")
    blocks = max(1, -(-(work.agg(F.sum("n_bytes")).first()[0] or 0) // block_bytes))
    work = work.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))

    windows = work.select("row", "block", "text", "anchors").mapInArrow(_window_rows(length, size), "h long, w long, row long, block long")
    confirmed = windows.groupBy("h", "w").agg(F.count(F.lit(1)).alias("c"), F.min("row").alias("first")).where("c > 1").select("h", "w", "first")
    confirmed = materialize(confirmed, "phrase-windows")
    owners = confirmed.select("h", "first").distinct()
    spread = materialize(owners.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > wide).select("h"), "phrase-wide")
    has = work.select("block", F.explode("anchors").alias("h")).distinct()
    near = _broadcast_if_few(spread)
    needs = owners.join(near, "h", "left_anti").join(has, "h").select("first", "block", "h", F.lit(None).cast("long").alias("w"))
    if not spread.isEmpty():
        lists = work.select("block", "text", "anchors").mapInArrow(_window_lists(length, size), "h long, block long, ws array<long>")
        apart = lists.join(near, "h", "left_semi").mapInArrow(_first_named, "block long, h long, w long").distinct()
        needs = needs.unionByName(confirmed.join(near, "h", "left_semi").join(apart, ["h", "w"]).select("first", "block", "h", "w"))
    served = (F.col("block") / SERVED).cast("long").alias("served")
    needs = needs.groupBy("first", served).agg(F.collect_list(F.struct("block", "h", "w")).alias("needs"))
    mine = confirmed.groupBy("first").agg(F.collect_list(F.struct("h", "w")).alias("mine"))
    sources = work.select(F.col("row").alias("first"), "text").join(mine, "first").join(needs, "first").select("text", "mine", "needs")
    shape = "block long, kind long, a long, b long, text string"
    passages = sources.mapInArrow(_passages(length, size), shape)
    streamed = work.join(copied, key, "left_anti").select("block", F.lit(1).cast("long").alias("kind"), *key, "text")
    met = passages.unionByName(streamed).repartition("block").sortWithinPartitions("block", "kind")
    cut = met.mapInArrow(_stream(length, shard), "a long, b long, n_removed long, kept string, spans array<struct<start:bigint,end:bigint>>")
    nothing = F.lit(None).cast("array<struct<start:bigint,end:bigint>>")
    gone = copied.select(*key, F.lit(-1).cast("long").alias("n_removed"), F.sha2(F.lit("").cast("binary"), 256).alias("kept"), nothing.alias("spans"))
    cut = materialize(cut.unionByName(gone), "phrase-cuts")
    out = rows.join(cut, key, "left")
    all_gone = F.col("n_removed") == -1
    spans = F.when(all_gone, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))).otherwise(F.col("spans"))
    found = out.select(
        "doc_id",
        "n_words",
        F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.coalesce("kept", "whole").alias("kept_sha256"),
        spans.alias("spans"),
        *(["joined"] if texts else []),
    )
    if not texts:
        return found
    clean = F.when(F.col("spans").isNull(), F.col("joined")).otherwise(F.array_join(outside(F.split("joined", " "), F.col("spans")), " "))
    return found.withColumn("clean_text", clean).drop("joined")
