"""SimHash near-duplicate detection: pigeonhole blocks, a join on blocks, then exact distances.

``near_duplicates`` finds every pair of 64-bit fingerprints at most a few bits apart. ``keep_one`` is for
texts that are merely similar: so many bits differ then that only longer fingerprints tell them from
others, and blocks of these catch a pair with a stated probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import fresh, materialize, ship_package
from trackloom.llm.components import connected_components

BITS = 64
SHINGLE_WORDS, MAX_DISTANCE, SEED = 3, 3, 42
#: Fingerprints of one block that are compared with each other in one task.
BLOCK_ROWS = 256
#: Shingles whose bits are counted at a time, which bounds memory for very long texts.
STEP = 255 * 256
#: ``keep_one``: words of a shingle, the similarity that links, and the chance to miss a pair of shingle sets whose overlap
#: (Jaccard) is as much. The distance is taken on CHECKED bits.
COPY_WORDS, SIMILARITY, MISSED, CHECKED = 5, 0.8, 0.01, 256
#: The least bits of a block; unrelated fingerprints that share a block are 2 ** SPARE at most, on average.
LEAST_BITS, SPARE = 16, 6
#: Blocks of up to so many fingerprints are compared pair by pair at once, larger ones from one fingerprint to the next, and
#: those beyond the second number lose their dense groups before. Keys of blocks that go to every executor.
SMALL_BLOCK, LARGE_BLOCK, BROADCAST_KEYS = 48, 1 << 13, 1_000_000


def simhash(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> bytes:
    """The fingerprint of a text as 8 bytes, highest bit first: a bit is set if more than half of the shingle hashes set it."""
    counts, n = np.zeros(BITS, np.int64), 0
    for part in _shingle_hashes(text, shingle_words, STEP):
        counts += _bit_counts(part.view(np.uint8).reshape(-1, 8))
        n += len(part)
    return np.packbits(counts * 2 > n).tobytes()


def _shingle_hashes(text: bytes | None, shingle_words: int, step: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, up to ``step`` at a time, as big-endian integers."""
    words = text.translate(_LOWER).split() if text else []
    if not words:
        return
    k = min(shingle_words, len(words))
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_digest
    n = len(words) - k + 1
    for at in range(0, n, step):
        part = b"".join([digest(joined[s : e - 1], SEED) for s, e in zip(starts[at : min(at + step, n)], ends[at + k - 1 : at + step + k - 1])])
        yield np.frombuffer(part, ">u8")


def _bit_counts(data: np.ndarray) -> np.ndarray:
    """How many rows of bytes set each bit."""
    bits = np.unpackbits(data, axis=1)
    whole = len(bits) // 255 * 255
    counts = bits[:whole].reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return counts + bits[whole:].sum(axis=0, dtype=np.int64)


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _fingerprint_batches(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            prints = b"".join(simhash(t.as_py(), shingle_words) for t in texts)
            fp = pa.array(np.frombuffer(prints, ">u8").astype(np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], names=["doc_id", "fp"])

    return run


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a long) of each row."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_fingerprint_batches(shingle_words), f"doc_id {kind}, fp long")


def _spread(bits: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` runs of the given bit positions, as equal as can be."""
    cuts = [len(bits) * i // parts for i in range(parts + 1)]
    return [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]


def block_masks(agreed: int, distance: int, free: int) -> list[int]:
    """Masks that cover every close pair that agrees on ``agreed``.

    The other bits fall into ``distance + free`` runs; two fingerprints at most ``distance`` bits
    apart agree on at least ``free`` of them, so some mask of ``free`` runs holds both.
    """
    rest = [b for b in range(BITS) if not agreed >> b & 1]
    runs = _spread(rest, distance + free)
    return sorted({agreed | sum(chosen) for chosen in combinations(runs, free)})


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(distance: int):
    """Links of each block's fingerprints to the smallest one of their group in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            offsets = column.offsets.to_numpy()
            flat = column.values.to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.diff(offsets)
            pairs = offsets[:-1][sizes == 2]
            a, b = flat[pairs], flat[pairs + 1]
            close = np.bitwise_count((a ^ b).view(np.uint64)) <= distance
            us, vs = [a[close]], [b[close]]
            for at, n in zip(offsets[:-1][sizes > 2], sizes[sizes > 2]):
                fps = np.sort(flat[at : at + n])
                near = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= distance
                todo = np.ones(n, bool)
                for i in range(n):
                    if not todo[i]:
                        continue
                    group = np.zeros(n, bool)
                    wave = group.copy()
                    wave[i] = True
                    while wave.any():
                        group |= wave
                        wave = near[wave].any(axis=0) & ~group
                    todo &= ~group
                    rest = fps[group][1:]
                    us.append(rest)
                    vs.append(np.full(len(rest), fps[i]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return run


def close_links(prints: DataFrame, distance: int = MAX_DISTANCE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links ``u, v`` that connect the same distinct fingerprints as all pairs within ``distance``.

    Fingerprints meet in blocks on which close pairs must agree. Blocks are counted first. One of
    up to ``block_rows`` is compared within one task; a fuller one, as of a large group of near
    copies, is cut into finer blocks by the same argument on its other bits, until so few bits are
    free that a block is small by itself. Of a block, links are a spanning forest of its close pairs.
    Each finer level makes up to 20 rows of a row in a crowded block.
    """
    spark = prints.sparkSession
    level = [(0, m) for m in block_masks(0, distance, 2)]
    todo = prints.select("fp", F.lit(0).alias("parent"))
    links = None
    while True:
        masks = spark.createDataFrame([(p, i, _signed(m)) for i, (p, m) in enumerate(level)], "parent int, mask_id int, mask long").hint("broadcast")
        keyed = todo.join(masks, "parent").select("mask_id", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        keyed = materialize(keyed, "simhash-blocks")
        counts = keyed.groupBy("mask_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        counts = materialize(counts, "simhash-counts")
        last = max(BITS - m.bit_count() for _, m in level) <= 8
        cut = 1 << 62 if last else block_rows
        fits = keyed.join(counts.where(F.col("n") <= cut), ["mask_id", "key"]).groupBy("mask_id", "key").agg(F.collect_list("fp").alias("fps"))
        found = fits.select("fps").mapInArrow(_forest(distance), "u long, v long")
        links = found if links is None else links.unionByName(found)
        hot = counts.where(F.col("n") > cut).select("mask_id", "key")
        if last or hot.isEmpty():
            return links
        todo = keyed.join(hot, ["mask_id", "key"], "left_semi").select("fp", F.col("mask_id").alias("parent"))
        crowded = sorted(r["mask_id"] for r in hot.select("mask_id").distinct().collect())  # masks, not fingerprints
        level = [(i, m) for i in crowded for m in block_masks(level[i][1], distance, 3)]


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    distance: int = MAX_DISTANCE,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row.

    Fingerprints of word shingles link at ``distance`` or fewer differing bits; the component is
    named by the smallest id that links reach. Texts are compared by their distinct fingerprints:
    copies are one node. A null, empty or blank text has fingerprint zero and links like any other.
    Rows with a null id take part and are never the name of a component unless it holds no other;
    repeated rows stay repeated; an empty table gives an empty result; other columns are dropped.
    Texts of any length are read whole, a bounded number of shingles at a time.
    """
    ship_package(df.sparkSession)
    prints = materialize(fingerprints(df, id_col, text_col, shingle_words), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = materialize(nodes, "fingerprint-nodes")
    parts = connected_components(close_links(nodes.select("fp"), distance, block_rows), "simhash-links")
    parts = parts.select(F.col("node").alias("fp"), "component")
    labelled = nodes.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    of = materialize(labelled.join(names, "component").select("fp", "component_id"), "fingerprint-components")
    return prints.join(of, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def block_plan(rows: int, similarity: float = SIMILARITY, missed: float = MISSED) -> tuple[int, int]:
    """``(bits, blocks)``: bits of a block and how many blocks, for a table of so many rows.

    Blocks grow by a bit each time the table doubles, so that a block holds few unrelated fingerprints
    at any size. Shingle sets whose Jaccard similarity is ``similarity`` have fingerprints of which each
    bit agrees with a known probability; there are as many blocks as make a pair agree on one of them
    but for a share of ``missed``.
    """
    bits = max(LEAST_BITS, math.ceil(math.log2(max(1, rows))) - SPARE)
    agree = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    return bits, math.ceil(math.log(missed) / math.log(1 - agree**bits))


def most_apart(similarity: float = SIMILARITY, bits: int = CHECKED) -> int:
    """The expected distance of fingerprints whose texts have this cosine similarity."""
    return int(math.acos(similarity) / math.pi * bits)


_ODD = np.uint64(0xD6E8FEB86659FD93)


def wide_bits(text: bytes | None, n_bits: int, shingle_words: int = COPY_WORDS) -> np.ndarray:
    """A fingerprint of ``n_bits`` bits (a multiple of 64): the hash of each distinct shingle is drawn out to as many by mixing.

    A tie sets every other bit.
    """
    lanes = np.arange(1, n_bits // BITS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    hashes = np.unique(np.concatenate([np.empty(0, np.uint64), *_shingle_hashes(text, shingle_words, STEP)]).astype(np.uint64))
    counts = np.zeros(n_bits, np.int64)
    for at in range(0, len(hashes), 255 * 8):
        x = (hashes[at : at + 255 * 8, None] ^ lanes) * _ODD
        x ^= x >> np.uint64(32)
        x *= _ODD
        x ^= x >> np.uint64(29)
        counts += _bit_counts(x.view(np.uint8))
    return counts * 2 > len(hashes) - (np.arange(n_bits) & 1)


def _wide_batches(bits: int, blocks: int, shingle_words: int):
    n_bits = -(-max(bits * blocks, CHECKED) // BITS) * BITS
    weights = np.int64(1) << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            checked, keys = [], []
            for text in batch.column(0).cast(pa.binary()):
                own = wide_bits(text.as_py(), n_bits, shingle_words)
                checked.append(np.packbits(own[:CHECKED]).view(np.int64))
                keys.append(own[: bits * blocks].reshape(blocks, bits) @ weights)
            words = np.array(checked).reshape(-1, CHECKED // BITS)
            values = (np.array(keys, np.int64).reshape(-1, blocks) * blocks + np.arange(blocks)).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * blocks), pa.array(values))
            made = [pa.array(np.ascontiguousarray(words[:, i])) for i in range(words.shape[1])]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made, lists], names=[*batch.schema.names[1:], *_CHECKED_NAMES, "keys"])

    return run


_CHECKED_NAMES = [f"w{i}" for i in range(CHECKED // BITS)]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=0, dtype=np.int64)


def _grown(w: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray], list[int]]:
    """Links of each fingerprint to the first one of its group, found from one fingerprint to the next; and the first ones."""
    left, us, vs, firsts = np.arange(w.shape[1]), [], [], []
    while len(left):
        first, left = left[0], left[1:]
        firsts.append(int(first))
        wave = [first]
        while wave and len(left):
            near = _apart(w[:, left], w[:, wave.pop()][:, None]) <= distance
            if near.any():
                us.append(left[near])
                vs.append(np.full(len(us[-1]), first))
                wave.extend(us[-1])
                left = left[~near]
    return us, vs, firsts


def _links_of(keys: np.ndarray, w: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of links that connect what is close within each run of equal keys."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    us, vs = [], []
    for at, n in zip(starts[sizes > SMALL_BLOCK], sizes[sizes > SMALL_BLOCK]):
        u, v, _ = _grown(w[:, at : at + n], distance)
        us += [x + at for x in u]
        vs += [x + at for x in v]
    ends = np.where(sizes > SMALL_BLOCK, 0, starts + sizes)
    left = np.repeat(ends, sizes) - np.arange(len(keys))  # rows of the same small block from here on
    at, lag = np.flatnonzero(left > 1), 1
    pairs_u, pairs_v = [], []
    while len(at):
        close = _apart(w[:, at], w[:, at + lag]) <= distance
        pairs_u.append(at[close] + lag)
        pairs_v.append(at[close])
        lag += 1
        at = at[left[at] > lag]
    if pairs_u:
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := root.get(x, x)) != x:
                root[x] = root.get(y, y)
                x = y
            return x

        kept = []
        for u, v in zip(np.concatenate(pairs_u).tolist(), np.concatenate(pairs_v).tolist()):
            a, b = top(u), top(v)
            if a != b:
                root[max(a, b)] = min(a, b)
                kept.append((u, v))
        us.append(np.array([u for u, _ in kept], np.int64))
        vs.append(np.array([v for _, v in kept], np.int64))
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *us]), np.concatenate([empty, *vs])


def _link_batch(w: np.ndarray, u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    w = w.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(w[i][x])) for x in (u, v) for i in (0, 1)], names=["u0", "u1", "v0", "v1"])


def _wide_links(distance: int):
    """Links of rows ``key, w0, w1, ...`` in order of key, each between two that are close and share a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((1 + len(_CHECKED_NAMES), 0), np.int64)
        for batch in batches:
            rest = np.concatenate([rest, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
            cut = int(np.searchsorted(rest[0], rest[0, -1])) if rest.shape[1] else 0  # the last block may go on
            if cut:
                w = rest[1:, :cut].view(np.uint64)
                yield _link_batch(w, *_links_of(rest[0, :cut], w, distance))
                rest = rest[:, cut:]
        if rest.shape[1]:
            w = rest[1:].view(np.uint64)
            yield _link_batch(w, *_links_of(rest[0], w, distance))

    return run


_LINK = "u0 long, u1 long, v0 long, v1 long"


def _witnesses(distance: int):
    """For each row outside of a ball one of the ball's rows that is close to it, if a group has one.

    Rows ``part, side, w0, w1, ...`` come in order of part, the ball's (side 0) before the others.
    """

    def found(side: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ball, us, vs = np.flatnonzero(side == 0), [], []
        if len(ball):
            own = np.ascontiguousarray(w[:, ball])
            for y in np.flatnonzero(side == 1):
                near = _apart(own, w[:, y][:, None]) <= distance
                if near.any():
                    us.append(y)
                    vs.append(ball[near.argmax()])
        return np.array(us, np.int64), np.array(vs, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((2 + len(_CHECKED_NAMES), 0), np.int64)
        for batch in _with_end(batches):
            if batch is not None:
                rest = np.concatenate([rest, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
            n = rest.shape[1]
            cut = n if batch is None else int(np.searchsorted(rest[0], rest[0, -1])) if n else 0
            if not cut:
                continue
            starts = np.flatnonzero(np.concatenate([[True], rest[0, 1:cut] != rest[0, : cut - 1]]))
            for a, b in zip(starts, [*starts[1:], cut]):
                w = rest[2:, a:b].view(np.uint64)
                u, v = found(rest[1, a:b], w)
                yield _link_batch(w, u, v)
            rest = rest[:, cut:]

    return run


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def thinned(rows: DataFrame, distance: int, large: int) -> tuple[DataFrame, list[DataFrame]]:
    """Rows ``key, w0, w1, ...`` of blocks, with those left out that links speak for; and these links.

    A block of more than ``large`` rows isn't compared in one task. It names a leader, and each of its rows
    measures its own distance to it: those within ``distance`` are the leader's ball and link to it, and the
    rest is the block from now on. What links the two is found as well: a row outside needs one witness in
    the ball, as the ball is connected, and only rows on the ball's rim can be one, by the triangle inequality.
    Rim and rest meet in parts of at most ``large`` rows each. So a dense group leaves its block without losing
    a link, and no task holds it. That is done again until blocks are small enough, or balls hold less than a tenth
    of what is left.
    """
    counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large).select("key")
    hot = materialize(counted, "wide-hot")
    if hot.isEmpty():
        return rows, []
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_KEYS else df
    near = few(hot)
    small = [rows.join(near, "key", "left_anti")]
    now = materialize(rows.join(near, "key", "left_semi"), "wide-hot-rows")
    links, place = [], F.xxhash64(*_CHECKED_NAMES)
    while True:
        first = F.min(F.struct(place.alias("h"), *_CHECKED_NAMES)).alias("lead")
        leaders = now.groupBy("key").agg(F.count(F.lit(1)).alias("n"), first).where(F.col("n") > large).select("key", *[F.col(f"lead.{w}").alias(f"l{i}") for i, w in enumerate(_CHECKED_NAMES)])
        leaders = materialize(leaders, "wide-leaders")
        led = few(leaders)
        small.append(now.join(led, "key", "left_anti"))
        if leaders.isEmpty():
            break
        apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"l{i}"))) for i, w in enumerate(_CHECKED_NAMES)), F.lit(0))
        met = materialize(now.join(led, "key").withColumn("d", apart), "wide-led")
        links.append(met.where((F.col("d") <= distance) & (F.col("d") > 0)).select(F.col("w0").alias("u0"), F.col("w1").alias("u1"), F.col("l0").alias("v0"), F.col("l1").alias("v1")))
        beyond = F.col("d") > distance
        out = met.groupBy("key").agg(F.min(F.when(beyond, F.col("d"))).alias("least"), F.count_if(beyond).alias("n_out")).where("n_out > 0")
        out = materialize(out, "wide-beyond")
        rim = met.join(few(out), "key").where(~beyond & (F.col("d") >= F.col("least") - distance)).select("key", *_CHECKED_NAMES, "n_out")
        sizes = materialize(rim.groupBy("key").agg(F.count(F.lit(1)).alias("n_rim"), F.first("n_out").alias("n_out")), "wide-rims")
        parts = sizes.select("key", *[F.ceil(F.col(c) / large).cast("int").alias(c[2:]) for c in ("n_rim", "n_out")])
        sides = []
        for side, source, own, other in ((0, rim.drop("n_out"), "rim", "out"), (1, met.where(beyond).select("key", *_CHECKED_NAMES), "out", "rim")):
            laid = source.join(few(parts), "key").withColumns({"_own": F.pmod(place, F.col(own)).cast("int"), "_other": F.explode(F.sequence(F.lit(0), F.col(other) - 1))})
            at = F.xxhash64("key", *(("_own", "_other") if side == 0 else ("_other", "_own"))).alias("part")
            sides.append(laid.select(at, F.lit(side).cast("long").alias("side"), *_CHECKED_NAMES))
        meeting = sides[0].unionByName(sides[1]).repartition("part").sortWithinPartitions("part", "side")
        links.append(materialize(meeting.mapInArrow(_witnesses(distance), _LINK), "wide-witnesses"))
        left = materialize(met.where(beyond).select("key", *_CHECKED_NAMES), "wide-left")
        if left.count() > 0.9 * met.count():
            small.append(left)
            break
        now = left
    return reduce(DataFrame.unionByName, small), links


def keep_one(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = COPY_WORDS,
    similarity: float = SIMILARITY,
    missed: float = MISSED,
    large: int = LARGE_BLOCK,
) -> DataFrame:
    """The rows of ``df`` with one row of each group of similar texts: that with the smallest id.

    Fingerprints of word shingles are cut into disjoint blocks; pairs that share a block are compared
    on CHECKED bits and link if they are no farther apart than texts of this cosine ``similarity`` are
    on average. Sets with a Jaccard similarity of 0.8 have a cosine of 0.89, so blocks miss a share of
    ``missed`` of such pairs and the distance about one in 96 more (2.4 standard deviations); at 0.85
    both together miss one in a thousand. Pairs of a Jaccard similarity from about 0.6 to 0.75 link by
    chance, and less similar ones don't.

    A block of up to ``large`` rows is compared within one task: dense groups are linked from one
    fingerprint to the next, which takes few comparisons. Larger ones lose their dense groups first
    (``thinned``), without losing a link; what stays of a block, at 40 bytes a row, is in one task. Only a block of
    very many fingerprints that are neither alike nor unrelated stays large. Copies are one
    fingerprint and meet nowhere.

    Ids that are null come after all others, so such a row stays only if its group has no id. Rows
    are told apart by id and text, so another text under the same id stays; rows that repeat, in id and
    text, are cut to one. Null, empty and blank texts are alike. Texts of any length are read whole; an
    empty table gives an empty result; all columns of ``df`` stay, whatever their names.
    """
    ship_package(df.sparkSession)
    bits, blocks = block_plan(df.count(), similarity, missed)
    text = F.col(text_col)
    key = {"_a": F.xxhash64(text), "_b": F.xxhash64(F.lit(1), text)}
    rows = df.select(text.alias("text"), F.col(id_col).alias("id"), *[c.alias(n) for n, c in key.items()])
    kinds = [f"{n} {rows.schema[n].dataType.simpleString()}" for n in ("id", "_a", "_b")] + [f"{n} long" for n in _CHECKED_NAMES]
    prints = rows.mapInArrow(_wide_batches(bits, blocks, shingle_words), ", ".join([*kinds, "keys array<long>"]))
    prints = materialize(prints, "wide-fingerprints")
    node = F.struct("w0", "w1").alias("node")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_a", "_b")).alias("least")
    nodes = prints.groupBy(*_CHECKED_NAMES).agg(least, F.first("keys").alias("keys"))
    nodes = materialize(nodes, "wide-nodes")
    in_blocks, found = thinned(nodes.select(F.explode("keys").alias("key"), *_CHECKED_NAMES), most_apart(similarity), large)
    in_blocks = in_blocks.repartition("key").sortWithinPartitions("key", *_CHECKED_NAMES)
    found = reduce(DataFrame.unionByName, found, in_blocks.mapInArrow(_wide_links(most_apart(similarity)), _LINK))
    links = found.select(F.struct(F.col("u0").alias("w0"), F.col("u1").alias("w1")).alias("u"), F.struct(F.col("v0").alias("w0"), F.col("v1").alias("w1")).alias("v"))
    parts = connected_components(links, "wide-links")
    labelled = nodes.select(node, "least").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    stays = labelled.groupBy("component").agg(F.min("least").alias("least")).select("least.id", "least._a", "least._b")
    stays = materialize(stays, "wide-stays")
    a, b, nth = (fresh(df, n) for n in ("_a", "_b", "_nth"))
    own = df.withColumns({a: key["_a"], b: key["_b"]})
    one = stays.select(*[F.col(n).alias(fresh(own, f"_stays{n}")) for n in stays.columns])
    same = F.col(id_col).eqNullSafe(F.col(one.columns[0])) & (F.col(a) == F.col(one.columns[1])) & (F.col(b) == F.col(one.columns[2]))
    kept = own.join(one, same)
    names = [F.col(f"`{c}`") for c in df.columns]
    order = Window.partitionBy(a, b, id_col).orderBy(F.xxhash64(*names))
    return kept.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).select(*names)
