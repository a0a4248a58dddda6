"""Removal of long repeated byte strings: suffixes at shared anchors, in deep-shallow order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import materialize, ship_package
from trackloom.llm.deep_shallow import common_prefix, with_prefixes

LENGTH = 200
#: Bytes of an anchor. Each string of LENGTH bytes has an anchor: its piece of so many bytes with the least hash.
ANCHOR = 80
#: Window starts whose anchors are found at a time; anchors with more rows are counted by context
#: first; distinct contexts that one task sorts; document keys that go to every executor; parts of the
#: offsets for which an anchor with more contexts is lengthened.
STEP, MANY, GROUP, BROADCAST_KEYS, PARTS = 1 << 19, 512, 1 << 11, 1_000_000, 8
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def piece_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all pieces of ``size`` bytes, by doubling polynomial sums modulo 2**64."""
    power, have = {1: BASE}, {1: data.astype(np.uint64) + np.uint64(1)}
    n = 1
    with np.errstate(over="ignore"):
        while 2 * n <= size:
            h = have[n]
            have[2 * n] = h[:-n] * np.uint64(power[n]) + h[n:]
            power[2 * n] = power[n] * power[n] % (1 << 64)
            n *= 2
        out, done = have[n], n
        while done < size:
            part = 1 << ((size - done).bit_length() - 1)
            keep = len(data) - done - part + 1
            out = out[:keep] * np.uint64(power[part]) + have[part][done : done + keep]
            done += part
        out = out ^ (out >> np.uint64(32))
        out = out * np.uint64(MIX)
        return out ^ (out >> np.uint64(29))


def anchors(data: bytes, length: int = LENGTH, size: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of anchors: in each string of ``length`` bytes its least piece, the leftmost of equals."""
    window = length - size + 1
    positions, hashes = [], []
    for base in range(0, max(0, len(data) - length + 1), STEP):
        part = np.frombuffer(data, np.uint8, min(len(data) - base, STEP + length - 1), base)
        h = piece_hashes(part, size)
        least = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        n = 1
        while 2 * n <= window:
            least = np.minimum(least[:-n], least[n:])
            n *= 2
        if n < window:
            least = np.minimum(least[: len(least) - (window - n)], least[window - n :])
        changed = np.concatenate([[True], least[1:] != least[:-1]])
        at = (least[changed] & np.uint64(0xFFFFFF)).astype(np.int64)
        positions.append(at + base)
        hashes.append(h[at].view(np.int64))
    if not positions:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pos, first = np.unique(np.concatenate(positions), return_index=True)
    return pos, np.concatenate(hashes)[first]


def _anchor_rows(length: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # copies within a task are read once; a key of 16 bytes a text
        for batch in batches:
            keys, more = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found, at = [], []
            for i, text in enumerate(batch.column(2).cast(pa.binary())):
                key = (int(keys[i]), int(more[i]))
                if key not in seen and len(text.as_buffer()) >= length:
                    seen.add(key)
                    pos, h = anchors(text.as_buffer(), length, size)
                    found.append((pos, h))
                    at.append(np.full(len(pos), i))
            if found:
                at = np.concatenate(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([h for _, h in found])), pa.array(keys[at]), pa.array(more[at]), pa.array(np.concatenate([p for p, _ in found]))],
                    names=["h", "doc", "doc2", "pos"],
                )

    return run


def context(data: memoryview, pos: int, length: int, size: int) -> tuple[int, bytes]:
    """How many bytes before the anchor, and all bytes that strings of ``length`` around it may hold."""
    start = max(0, pos - (length - size))
    return pos - start, bytes(data[start : pos + length])


def _context_id(left: int, text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text, left) - (1 << 63)


def _contexts(length: int, size: int, places: bool):
    """Rows of contexts with how often a batch has them, or with ``places`` the documents and positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column("text").cast(pa.binary()), batch.column("anchors")
            offsets, inner = lists.offsets.to_numpy(), lists.values
            pos, h, many = (inner.field(n).to_numpy(zero_copy_only=False) for n in ("pos", "h", "many"))
            docs, docs2 = batch.column("doc").to_numpy(), batch.column("doc2").to_numpy()
            seen: dict[tuple[int, int], list] = {}
            rows: list[tuple[int, int, int, int, int]] = []
            for i, text in enumerate(texts):
                view = memoryview(text.as_buffer())
                for j in range(offsets[i], offsets[i + 1]):
                    left, data = context(view, int(pos[j]), length, size)
                    cid = _context_id(left, data)
                    if places:
                        rows.append((int(h[j]), cid, int(docs[i]), int(docs2[i]), int(pos[j])))
                    elif (got := seen.get((h[j], cid))) is not None:
                        got[4] += 1
                    else:
                        seen[h[j], cid] = [int(h[j]), cid, left, data, 1, bool(many[j])]
            if places and rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["h", "cid", "doc", "doc2", "pos"])
            elif seen:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.bool_()]
                names = ["h", "cid", "left", "data", "n", "many"]
                made = list(seen.values())
                for at in range(0, len(made), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made[at : at + 20_000]), kinds)], names=names)

    return run


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2])]


def repeated_offsets(group: list[tuple[int, int, bytes, int]], length: int = LENGTH, size: int = ANCHOR) -> list[tuple[int, int, int]]:
    """``(cid, i1, i2)``: the strings that start i1 to i2 bytes before the anchor of a context and occur again.

    ``group`` has (cid, bytes before the anchor, data, count) of the contexts of one anchor hash.
    Suffixes from the anchor and reversed prefixes before it are sorted; a string i bytes before
    the anchor is shared by two contexts if their suffixes share length - i bytes or more and their
    prefixes i or more. Neighbours in both orders give these lengths for all.
    """
    most = length - size
    merged: dict[tuple[int, bytes], list[int]] = {}
    names: dict[tuple[int, bytes], int] = {}
    for cid, left, data, n in group:
        merged.setdefault((left, data), [0])[0] += n
        names[left, data] = cid
    rows = [(names[k], *k, v[0]) for k, v in merged.items()]
    m = len(rows)
    lefts = [r[1] for r in rows]
    rights = [len(r[2]) - r[1] for r in rows]
    out = []
    if m == 1:
        if rows[0][3] < 2:
            return []
        lo, hi = max(0, length - rights[0]), min(most, lefts[0])
        return [(rows[0][0], lo, hi)] if lo <= hi else []
    after = [r[2][r[1] :] for r in rows]
    before = [r[2][: r[1]][::-1] for r in rows]
    if m == 2:
        lo, hi = max(0, length - common_prefix(*after)), min(most, common_prefix(*before))
        for k, r in enumerate(rows):
            if r[3] > 1:
                own = max(0, length - rights[k]), min(most, lefts[k])
                if own[0] <= own[1]:
                    out.append((r[0], *own))
            elif lo <= hi:
                out.append((r[0], lo, hi))
        return out
    right_order, right_lcp = with_prefixes(after)
    left_order, left_lcp = with_prefixes(before)
    right_order, left_order = np.array(right_order), np.array(left_order)
    right_lcp, left_lcp = np.array(right_lcp), np.array(left_lcp)
    n = np.array([r[3] for r in rows])
    lo = np.maximum(0, length - np.array(rights))
    hi = np.minimum(most, np.array(lefts))
    # runs of equal prefixes change at these offsets only
    cuts = np.unique(np.concatenate([[0], left_lcp + 1, length - right_lcp, lo, hi + 1]))
    cuts = cuts[(cuts >= 0) & (cuts <= most)]
    flags = np.zeros((m, most + 2), bool)
    run_r, run_l = np.empty(m, np.int64), np.empty(m, np.int64)
    for a, b in zip(cuts, [*cuts[1:], most + 1]):
        ok = (lo <= a) & (a <= hi)
        if ok.sum() == 0:
            continue
        run_r[right_order] = np.cumsum(right_lcp < length - a)
        run_l[left_order] = np.cumsum(left_lcp < a)
        key = np.where(ok, run_r * (m + 1) + run_l, -1)
        _, inverse = np.unique(key, return_inverse=True)
        total = np.bincount(inverse, weights=n)[inverse]
        flags[:, a:b] = (ok & (total > 1))[:, None]
    for k in np.flatnonzero(flags.any(axis=1)):
        out += [(rows[k][0], a, b) for a, b in _runs(flags[k])]
    return out


def _sort_groups(length: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            hashes, lists = batch.column("h").to_pylist(), batch.column("rows")
            offsets, inner = lists.offsets.to_numpy(), lists.values
            cid, left, n = (inner.field(c).to_numpy(zero_copy_only=False) for c in ("cid", "left", "n"))
            data = inner.field("data")
            for i, h in enumerate(hashes):
                group = [(int(cid[j]), int(left[j]), data[j].as_py(), int(n[j])) for j in range(offsets[i], offsets[i + 1])]
                out += [(h, *found) for found in repeated_offsets(group, length, size)]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["h", "cid", "i1", "i2"])

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the spans out of each text; the digest of what stays."""
    for batch in batches:
        out = []
        for doc, doc2, text, spans in zip(batch.column("doc").to_pylist(), batch.column("doc2").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("spans").to_pylist()):
            view, at, removed, count, sha = memoryview(text.as_buffer()), 0, 0, 0, hashlib.sha256()
            end = -1
            for s in sorted((x["start"], x["end"]) for x in spans):
                if s[0] > end:
                    sha.update(view[max(at, 0) : s[0]])
                    count, removed = count + 1, removed + s[1] - s[0]
                    at = end = s[1]
                elif s[1] > end:
                    removed += s[1] - end
                    at = end = s[1]
            sha.update(view[at:])
            out.append((doc, doc2, removed, count, sha.hexdigest()))
        kinds = [pa.int64()] * 4 + [pa.string()]
        columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc", "doc2", "n_removed", "n_spans", "kept_sha256"])


def _crowded(contexts: DataFrame, length: int, size: int) -> DataFrame:
    """Repeated strings of anchors with too many contexts to sort at once: each string is counted by its hash.

    Counts are partial sums within tasks, so strings that very many contexts share stay small.
    """
    lo = F.greatest(F.lit(0), length - (F.octet_length("data") - F.col("left")))
    hi = F.least(F.lit(length - size), F.col("left"))
    strings = contexts.where(lo <= hi).select("h", "cid", "n", "left", "data", F.explode(F.sequence(lo, hi)).alias("i"))
    text = F.substring("data", F.col("left") - F.col("i") + 1, F.lit(length))
    strings = strings.select("h", "cid", "n", "i", F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))
    again = strings.groupBy("h", "i", "a", "b").agg(F.sum("n").alias("total")).where("total > 1").drop("total")
    again = materialize(again, "crowded-strings")  # so that the join below may split a frequent string
    found = strings.join(again, ["h", "i", "a", "b"], "left_semi").groupBy("h", "cid").agg(F.collect_set("i").alias("at"))
    # neighbouring offsets become one range
    first = F.array_sort(F.filter("at", lambda i: ~F.array_contains("at", i - 1)))
    last = F.array_sort(F.filter("at", lambda i: ~F.array_contains("at", i + 1)))
    ranges = found.select("h", "cid", F.explode(F.arrays_zip(first.alias("i1"), last.alias("i2"))).alias("r"))
    return ranges.select("h", "cid", "r.i1", "r.i2")


def _parted(rows: DataFrame, key: list[str], group: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys with up to ``group`` rows, and those of larger ones (None if there are none).

    Keys of larger groups are few; as long as there are at most BROADCAST_KEYS of them they go to every
    executor, so rows of a large group aren't brought together only to be told from others.
    """
    large = materialize(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > group).select(*key), "large-groups")
    n = large.count()
    if not n:
        return rows, None
    near = F.broadcast(large) if n <= BROADCAST_KEYS else large
    return rows.join(near, key, "left_anti"), rows.join(near, key, "left_semi")


def _lengthened(contexts: DataFrame, length: int, size: int, group: int) -> DataFrame:
    """Repeated strings of anchors with too many contexts to sort at once.

    Offsets fall into PARTS ranges. All strings whose offset lies in one range share the bytes about the
    anchor that each of them holds, most of their length; so contexts, cut to what the range needs,
    meet by these bytes. Contexts that differ elsewhere are one then, and copies of a passage that was
    changed here and there part by where it was. What is still too large is counted string by string.
    """
    width = -(-(length - size + 1) // PARTS)
    lo = F.col("part") * width
    hi = F.least(lo + width - 1, F.lit(length - size))
    rows = contexts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).withColumns({"lo": lo, "hi": hi, "right": F.octet_length("data") - F.col("left")})
    rows = rows.where((F.col("left") >= F.col("lo")) & (F.col("right") >= length - F.col("hi")) & (F.col("lo") <= F.col("hi")))
    before, after = F.least("left", "hi"), F.least(F.col("right"), length - F.col("lo"))
    core = F.substring("data", F.col("left") - F.col("lo") + 1, F.col("lo") + length - F.col("hi"))
    rows = rows.select("h", "cid", "n", "part", before.alias("_left"), F.substring("data", F.col("left") - before + 1, before + after).alias("_data"), core.alias("_core"))
    rows = rows.withColumn("_cid", F.xxhash64("part", "_left", "_data"))
    key = ["h", "part", "a", "b"]
    cut = rows.select("h", "part", F.xxhash64("_core").alias("a"), F.xxhash64(F.lit(7), "_core").alias("b"), F.col("_cid").alias("cid"), F.col("_left").alias("left"), F.col("_data").alias("data"), "n")
    cut = materialize(cut.groupBy(*key, "cid", "left", "data").agg(F.sum("n").alias("n")), "lengthened-contexts")
    some, rest = _parted(cut, key, group)
    some = some.groupBy(*key).agg(F.collect_list(F.struct("cid", "left", "data", "n")).alias("rows"))
    found = some.select("h", "rows").mapInArrow(_sort_groups(length, size), "h long, cid long, i1 int, i2 int")
    if rest is not None:
        found = found.unionByName(_crowded(rest.select("h", "cid", "left", "data", "n"), length, size))
    found = found.withColumnRenamed("cid", "_cid")
    return rows.select("h", "cid", "_cid").join(found, ["h", "_cid"]).select("h", "cid", "i1", "i2")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, size: int = ANCHOR, many: int = MANY, group: int = GROUP) -> DataFrame:
    """Remove every byte that lies in a string of ``length`` bytes which starts anywhere else too.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row. Equal strings have the
    same anchor at the same place, so only suffixes at anchors whose hash occurs again can matter.
    Anchors are counted over all texts first. Texts with repeated anchors are kept at hand; their
    contexts meet by anchor hash and are sorted there (deep-shallow). Anchors of many rows are first
    reduced to distinct contexts with counts; those with more contexts than one task may sort are
    lengthened first, and at last resolved string by string. Contexts are compared by their bytes.

    Texts that are equal as a whole are read once: with ``length`` bytes or more they lose all, as each
    string starts in a copy too, and only what they share with other texts is looked for.

    Null is the empty text; texts shorter than ``length`` keep all, and texts of any length are read
    whole, a bounded part at a time; repeated rows repeat each other's bytes and so lose them; an empty
    table gives an empty result; other columns are dropped. Texts are known by 128 bits of hashes.
    """
    ship_package(df.sparkSession)
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumns({"doc": F.xxhash64("text"), "doc2": F.xxhash64(F.lit(1), "text")})
    own = ["doc", "doc2"]
    long_ones = docs.where(F.octet_length("text") >= length).select(*own, "text")
    copied = materialize(long_ones.groupBy(*own).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(*own), "copied-texts")
    found = materialize(long_ones.mapInArrow(_anchor_rows(length, size), "h long, doc long, doc2 long, pos long"), "anchors")
    other = (F.min("doc") != F.max("doc")) | (F.min("doc2") != F.max("doc2")) | (F.min("pos") != F.max("pos"))
    counts = found.groupBy("h").agg(F.count(F.lit(1)).alias("c"), other.alias("again")).where("again").select("h", (F.col("c") > many).alias("many"))
    counts = materialize(counts, "anchor-counts")  # so that the join below may split a frequent anchor
    few_keys = lambda keys: F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    per_doc = found.join(few_keys(counts), "h").groupBy(*own).agg(F.collect_set(F.struct("pos", "h", "many")).alias("anchors"))
    per_doc = materialize(per_doc, "repeated-anchors")
    texts = long_ones
    if per_doc.count() <= BROADCAST_KEYS:
        texts = texts.join(F.broadcast(per_doc.select(*own)), own, "left_semi")
    work = materialize(texts.dropDuplicates(own).join(per_doc, own), "repeated-texts")

    contexts = work.mapInArrow(_contexts(length, size, False), "h long, cid long, left int, data binary, n long, many boolean")
    row = F.struct("cid", "left", "data", "n")
    few = contexts.where("not many").groupBy("h").agg(F.collect_list(row).alias("rows"))
    offsets = few.mapInArrow(_sort_groups(length, size), "h long, cid long, i1 int, i2 int")
    distinct = contexts.where("many").groupBy("h", "cid", "left", "data").agg(F.sum("n").alias("n"))
    distinct = materialize(distinct, "distinct-contexts")
    sorted_ones, crowded = _parted(distinct, ["h"], group)
    sorted_ones = sorted_ones.groupBy("h").agg(F.collect_list(row).alias("rows"))
    offsets = offsets.unionByName(sorted_ones.mapInArrow(_sort_groups(length, size), "h long, cid long, i1 int, i2 int"))
    if crowded is not None:
        offsets = offsets.unionByName(_lengthened(crowded, length, size, group))
    offsets = materialize(offsets, "repeated-offsets")

    single = work.join(few_keys(copied), own, "left_anti")
    places = single.mapInArrow(_contexts(length, size, True), "h long, cid long, doc long, doc2 long, pos long")
    span = F.struct((F.col("pos") - F.col("i2")).alias("start"), (F.col("pos") - F.col("i1") + length).alias("end"))
    spans = places.join(offsets, ["h", "cid"]).groupBy(*own).agg(F.collect_set(span).alias("spans"))
    cut = single.select(*own, "text").join(spans, own).mapInArrow(_remove, "doc long, doc2 long, n_removed long, n_spans long, kept_sha256 string")
    all_of_it = [F.lit(-1).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha256")]
    cut = materialize(cut.unionByName(copied.select(*own, *all_of_it)), "cut-texts")
    whole = docs.select("doc_id", *own, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("_whole"))
    removed = F.when(F.col("n_removed") == -1, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0)))
    return whole.join(cut, own, "left").select(
        "doc_id",
        "n_bytes",
        removed.cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "_whole").alias("kept_sha256"),
    )
