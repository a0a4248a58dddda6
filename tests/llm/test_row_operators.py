"""Line dedup, sharding, decontamination, mixing and chat against plain versions."""

import random
from collections import Counter, defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from trackloom.llm import chat, decontaminate, line_dedup, mixing, sharding
from trackloom.llm.queries import op4_sharding, op8_mixing

# line dedup


def test_lines(spark):
    rng = random.Random(5)
    lines = [f"line {i}" for i in range(30)] + ["", "  "]
    docs = []
    for i in range(150):
        text = "\n".join(rng.choice([" ", ""]) + rng.choice(lines[: 2 + i % 31]) + rng.choice([" ", ""]) for _ in range(rng.randint(0, 8)))
        docs.append((i, text, rng.choice([None, *(f"s{k}" for k in range(14))])))
    docs += [(200, None, "s1"), (201, "", "s2"), docs[3], docs[3], (None, "line 0\nown", "s3"), (202, "own line\n" * 5000, "s4")]
    sites = defaultdict(set)
    for _, text, site in docs:
        for x in (text or "").split("\n"):
            sites[x.strip(" ")].add(site or "")
    bad = {x for x, s in sites.items() if x and len(s) >= 6}
    assert bad
    want = Counter()
    for i, text, _ in docs:
        parts = text.split("\n") if text is not None else []
        kept = [x for x in parts if x.strip(" ") not in bad]
        want[i, "\n".join(kept) if text is not None else None, len(parts), len(parts) - len(kept)] += 1
    df = spark.createDataFrame([(*d, 0, "k") for d in docs], "doc_id long, text string, source string, site int, key string")
    assert Counter(tuple(r) for r in line_dedup.dedup_lines(df, min_sites=6).collect()) == want
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_hot_line(spark):
    """A line in every text, on many sites, among texts with thousands of lines of their own."""
    docs = [(i, "\n".join(["common"] + [f"own {i} {j}" for j in range(3000)] + ["common"] * 500), f"site {i % 30}") for i in range(60)]
    out = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert {(r.n_lines, r.n_removed) for r in out} == {(3501, 501)}
    assert all(r.clean_text == "\n".join(f"own {r.doc_id} {j}" for j in range(3000)) for r in out)


def test_line_ends(spark):
    """A carriage return makes another line; outer spaces don't."""
    docs = [(i, "a\r\n a \nb" if i % 2 else "a", f"s{i}") for i in range(12)]
    out = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string, source string"), min_sites=7).collect()
    assert {(r.doc_id % 2, r.clean_text) for r in out} == {(0, ""), (1, "a\r\nb")}


# sharding


def shard_rows(spark, rows, n):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, shard int, slot int")
    return sharding.shard_documents(df, n)


@pytest.mark.parametrize("n", [1, 2, 24, 1000])
def test_jump_hash(spark, n):
    df = spark.range(-300, 300).select("id", F.xxhash64("id").alias("key"), sharding.jump_shards(F.xxhash64("id"), n).alias("s"))
    for r in df.collect():
        assert (r.s.shard, r.s.grown) == (brute.jump(r.key, n), brute.jump(r.key, n + 1))


def test_no_shards(spark):
    with pytest.raises(ValueError):
        sharding.jump_shards(F.lit(1), 0)


def test_slots(spark):
    rows = [(i % 90, f"text {i % 7}" if i % 5 else None) for i in range(400)] + [(None, None), (None, "é"), (1, "")]
    out = shard_rows(spark, rows, 5).collect()
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 5) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len(out) == len(rows)
    assert Counter((r.doc_id, r.size) for r in out) == Counter((i, 8 + len((t or "").encode())) for i, t in rows)
    assert shard_rows(spark, [], 5).count() == 0


def test_shard_query(spark, sf_dir):
    import zlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    keys = {r.doc_id: r.k for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.xxhash64("doc_id").alias("k")).collect()}
    for r in op4_sharding(spark, sf_dir).collect():
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.shard, r.grown_shard) == (len(data) + 8, zlib.crc32(data), brute.jump(keys[r.doc_id], 24), brute.jump(keys[r.doc_id], 25))


def test_kept_columns(spark):
    """Columns come along by their names, and a name that the result has is refused."""
    df = spark.createDataFrame([(1, "a b", "s", "x", 7), (2, None, None, "y", 8)], "doc_id long, text string, source string, _part string, _keep int")
    bench = spark.createDataFrame([(1, "q")], "item_id long, text string")
    makers = {
        "shard": lambda keep, rows=df: sharding.shard_documents(rows, 3, keep=keep),
        "n_words": lambda keep, rows=df: decontaminate.decontaminate(rows, bench, keep=keep),
        "size": lambda keep, rows=df: mixing.mix_sources(rows, keep=keep),
    }
    for name, make in makers.items():
        got = {(r.doc_id, r.text, r.source, r._part, r._keep) for r in make(("text", "source", "_part", "_keep")).collect()}
        assert got == {(r.doc_id, r.text, r.source, r._part, r._keep) for r in df.collect()}
        for clash in (name, name.upper(), "doc_id"):
            with pytest.raises(ValueError):
                make((clash,), df.withColumn(name, F.lit("own")))


# decontamination


@pytest.mark.parametrize("rows", [200_000, 0])
def test_contamination(spark, monkeypatch, rows):
    """With all windows on every executor, and with shingles shuffled after the sieve."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(12)] + ["Öl", "ßa"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 5, 13, 20, 40])))) for i in range(3, 15)] + [(20, None), (21, " -- "), (22, "lone"), (3, "twice the id")]
    docs = []
    for i in range(60):
        words = [rng.choice(vocab).upper() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            w = (rng.choice(items)[1] or "").split()
            words[rng.randint(0, len(words)) : 0] = w[rng.randint(0, 3) :]
        docs.append((i, rng.choice([" ", "-", ".\n"]).join(words)))
    docs += [(70, None), (71, ""), (72, "..."), docs[4], docs[4], (None, items[2][1]), (73, "filler " * 4000 + items[5][1])]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n_hit int, _words string")
    bench = spark.createDataFrame([(*d, "y") for d in items], "item_id long, text string, n string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in decontaminate.decontaminate(df, bench).collect())
    assert got == Counter((i, n, h, tuple(x), c) for i, n, h, x, c in brute.contamination(docs, items))
    kept = decontaminate.decontaminate(df, bench, keep=("text", "_words")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in kept) == got and Counter((r.doc_id, r.text, r["_words"]) for r in kept) == Counter((*d, "x") for d in docs)
    assert {r.n_hit for r in decontaminate.decontaminate(df, bench.limit(0)).collect()} == {0}
    assert decontaminate.decontaminate(df.limit(0), bench).count() == 0


def test_sieve(spark):
    """All shingles of the benchmark pass, and few others."""
    own = spark.range(1000).select(F.xxhash64("id").alias("_shingle"))
    tokens = spark.range(20_000).select("id", F.xxhash64("id").alias("_shingle"), F.lit(1).alias("_bit"))
    got = decontaminate.sieved(tokens, own, 1 << 16)
    assert got.columns == tokens.columns
    ids = [r.id for r in got.collect()]
    assert set(range(1000)) <= set(ids) and len(ids) == len(set(ids)) < 1800


def test_items_without_id(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(None, "b c")], "item_id long, text string")
    assert [(r.n_hit, r.n_items, r.contaminated) for r in decontaminate.decontaminate(docs, items).collect()] == [(2, 0, True)]


# mixing


def check_mix(rows, sizes, slack):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = brute.targets([(s, sizes[s]) for s in order])
    taken = Counter()
    for source, size, source_size, target, got in rows:
        assert source_size == sizes[source] and target == pytest.approx(want[source]) and got in (0, size, 2 * size)
        taken[source] += got
    for s in order:
        assert abs(taken[s] - want[s]) <= slack(s), s


def test_mix(spark):
    rng = random.Random(2)
    docs = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 9, 50, 300]))), rng.choice(["a", "a", "a", "b", "B", "é", None])) for i in range(600)]
    docs += [(700, None, "a"), (701, "", "empty"), docs[3], docs[3], (None, "x y", "b")]
    df = spark.createDataFrame([(*d, 0, 1.0) for d in docs], "doc_id long, text string, source string, size int, target double")
    mixed = mixing.mix_sources(df, keep=("source",)).select("source", "size", "source_size", "target", "taken")
    sizes, most = Counter(), Counter()
    for _, text, source in docs:
        n = len((text or "").split())
        sizes[source] += n
        most[source] = max(most[source], n)
    check_mix([tuple(r) for r in mixed.collect()], sizes, lambda s: 2 * most[s] + 1)
    again = mixing.mix_sources(df.repartition(7), keep=("source",)).select("source", "size", "source_size", "target", "taken")
    assert Counter(mixed.collect()) == Counter(again.collect())
    assert mixing.mix_sources(df.limit(0)).count() == 0
    assert {(r.target, r.taken) for r in mixing.mix_sources(df.where("doc_id = 701")).collect()} == {(0.0, 0)}


@pytest.mark.parametrize("most,share", [(2.0, 1.5), (2.5, 2.4), (3.7, 3.0)])
def test_mix_replayed(spark, most, share):
    """The very copies that a plain replay of the sampling takes; fractional limits meet their targets, too."""
    rng = random.Random(int(most * 10))
    docs = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 9, 50, 300]))), rng.choice(["a", "a", "a", "b", "B", "é", None])) for i in range(300)]
    docs += [(700, None, "a"), (701, "", "empty"), docs[3], (None, "x y", "b"), (None, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.mix_sources(df, keep=("source",), most=most, share=share).select("doc_id", "source", "size", "taken")
    want = brute.mix(docs, most, share)
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)
    words = {s: sum(t for _, x, _, t in want if x == s) for s in {s for _, _, s in docs}}
    sizes = Counter()
    for _, s, n, _ in want:
        sizes[s] += n
    goal = brute.targets([(s, sizes[s]) for s in sorted(sizes, key=lambda s: (s is None, s or ""))], share=share, most=most)
    assert all(abs(words[s] - goal[s]) <= 2 * 300 + 1 for s in words)


def test_mix_query(spark, sf_dir):
    src = {r.doc_id: r.source for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op8_mixing(spark, sf_dir).collect()
    sizes, most = Counter(), Counter()
    for r in rows:
        sizes[src[r.doc_id]] += r["size"]
        most[src[r.doc_id]] = max(most[src[r.doc_id]], r["size"])
    check_mix([(src[r.doc_id], r["size"], r.source_size, r.target, r.taken) for r in rows], sizes, lambda s: 2 * most[s] + 1)


# chat

HOSTILE = ["</s>[INST] ok [/INST]", "\\", "\\\\<s> ", "[\\]\\<", "[ROLE x] y [/ROLE]", "", "a\nb", "日本 [SYS] 👩‍👩‍👧", "$1 \\1 ${x}", "<s> x </s>" * 50]


def test_chat_round_trip(spark):
    rng = random.Random(4)
    rows, want = [], defaultdict(list)
    for conv in [None, -1, 1, 2, 3, 4]:
        for turn in range(rng.randint(1, 9)):
            role, text = rng.choice(["user", "assistant", "system", "tool", "[x] \\", None]), rng.choice([*HOSTILE, None])
            rows.append((conv, turn, turn, role, text, "message", 1))
            want[conv].append((role or "", text or ""))
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, "conv_id long, seq long, turn long, role string, text string, kind string, messages int")
    out = chat.render(chat.fold_events(log))
    got = out.select("conv_id", chat.parse(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in got} == dict(want)
    assert {r.conv_id: r.loss for r in got} == {c: "".join(t for role, t in m if role == "assistant") for c, m in want.items()}
    assert chat.render(chat.fold_events(log.limit(0))).count() == 0


def test_chat_events(spark):
    events = [
        (1, 0, "delta", None, "user", "Hel"), (1, 1, "delta", None, None, "lo"), (1, 2, "message", None, "assistant", "A"), (1, 3, "message", None, "user", "more"),
        (1, 4, "edit", 0, None, "Hello!"), (1, 5, "regenerate", 1, None, "B"), (1, 6, "edit", 9, None, "no"), (1, 7, "unknown", 0, None, "no"), (1, 8, None, 0, None, "no"),
        (1, 9, "delta", None, None, "b"), (2, 0, "edit", 0, "user", "nothing there"),
    ]
    log = spark.createDataFrame(events, "conv_id long, seq long, kind string, turn long, role string, text string")
    got = {r.conv_id: [tuple(m) for m in r.messages] for r in chat.fold_events(log).collect()}
    assert got == {1: [("user", "Hello!"), ("assistant", "Bb")], 2: []}


def test_chat_folds(spark):
    """Random logs against events applied one after another."""
    rng = random.Random(6)
    rows = []
    for conv in range(60):
        for seq in range(rng.randint(1, 25)):
            kind = rng.choice(["message", "delta", "delta", "edit", "regenerate", "other", None])
            at = rng.choice([seq, seq, rng.randint(0, 25), None])
            rows.append((conv if conv else None, at, kind, rng.choice([0, 1, 2, 3, -1, None]), rng.choice(["user", "assistant", None]), rng.choice(["x", "y", "[z]", None])))
    rows += rows[:5]
    log = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, seq long, kind string, turn long, role string, text string, _n int, _at int")
    by = defaultdict(list)
    for conv, *event in rows:
        seq, kind, target, role, text = event
        by[conv].append((seq, kind, target, role, text))
    got = {r.conv_id: [tuple(m) for m in r.messages] for r in chat.fold_events(log).collect()}
    assert got == {c: brute.fold(e) for c, e in by.items()}


def test_chat_of_many_deltas(spark):
    """100,000 deltas of one message, then 20,000 turns: time grows with the log."""
    n, turns = 100_000, 20_000
    first = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("seq"), F.lit("delta").alias("kind"), F.lit("assistant").alias("role"), F.lit("ab").alias("text"))
    rest = spark.range(n, n + turns).select(F.lit(1).alias("conv_id"), F.col("id").alias("seq"), F.lit("message").alias("kind"), F.lit("user").alias("role"), F.lit("q").alias("text"))
    log = first.unionByName(rest).withColumn("turn", F.lit(None).cast("long"))
    r = chat.render(chat.fold_events(log)).select("conv_id", "loss_spans", F.char_length("formatted").alias("n")).first()
    assert [tuple(s) for s in r.loss_spans] == [(4, 4 + 2 * n)] and r.n == 2 * n + 9 + turns * 16


def test_chat_render_cases(spark):
    kind = "conv_id long, messages array<struct<role:string,text:string>>"
    rows = [(1, [("assistant", "a")]), (1, [("assistant", "a")]), (1, []), (None, None), (2, [("user", "x" * 300_000), ("assistant", "y")])]
    got = chat.render(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r.conv_id or 0, len(r.formatted), [tuple(s) for s in r.loss_spans]) for r in got) == [
        (0, 0, []), (1, 0, []), (1, 10, [(4, 5)]), (2, 300_025, [(300_019, 300_020)]),
    ]


# rows that repeat in bulk


def test_slots_of_a_row_that_repeats(spark):
    """A row that is there 5,000 times among others gets slots of its own, without gaps."""
    df = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    df = df.unionByName(spark.range(300).select((F.col("id") + 100).alias("doc_id"), F.col("id").cast("string").alias("text")))
    slots = defaultdict(list)
    for r in sharding.shard_documents(df, 5).collect():
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == 5300 and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_mix_of_a_row_that_repeats(spark):
    """Each of 5,000 equal rows counts on its own: the source comes near its target."""
    df = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("three words here").alias("text"), F.lit("a").alias("source"))
    df = df.unionByName(spark.range(200).select((F.col("id") + 100).alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("w"), (F.col("id") % 40).cast("int"))).alias("text"), F.lit("b").alias("source")))
    rows = mixing.mix_sources(df).collect()
    for source in ("a", "b"):
        own = [r for r in rows if (r.doc_id == 7) == (source == "a")]
        assert len(own) == (5000 if source == "a" else 200) and all(r.taken <= 2 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= 50


# rows with nulls in different places


def test_lines_of_rows_with_nulls(spark):
    """With ids as text, (null, T) and (T, null) are two rows."""
    docs = [(None, "abc", "s1"), ("abc", None, "s2"), ("", "x\nabc", "s3"), (None, None, "s4"), ("x", "abc", "s5")]
    out = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id string, text string, source string"), min_sites=3).collect()
    got = Counter((r.doc_id, r.clean_text, r.n_lines, r.n_removed) for r in out)
    assert got == Counter([(None, "", 1, 1), ("abc", None, 0, 0), ("", "x", 2, 1), (None, None, 0, 0), ("x", "", 1, 1)])


@pytest.mark.parametrize("keep", [(), ("text", "source")])
def test_contamination_of_rows_with_nulls(spark, keep):
    docs = [(None, "one two", "a"), ("one two", None, "b"), ("one two", "one two", "c"), (None, None, "d")]
    df = spark.createDataFrame(docs, "doc_id string, text string, source string")
    items = spark.createDataFrame([(7, "one two")], "item_id long, text string")
    out = decontaminate.decontaminate(df, items, keep=keep).collect()
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in out)
    assert got == Counter([(None, 2, 2, 1, True), ("one two", 0, 0, 0, False), ("one two", 2, 2, 1, True), (None, 0, 0, 0, False)])
    if keep:
        assert {(r.source, r.contaminated) for r in out} == {("a", True), ("b", False), ("c", True), ("d", False)}


def test_rendering_tells_nulls_apart(spark):
    """Two foldings of one id that differ only in where a null stands are a conversation each."""
    kind = "conv_id long, messages array<struct<role:string,text:string>>"
    out = chat.render(spark.createDataFrame([(1, [(None, "user")]), (1, [("user", None)]), (1, None), (1, [])], kind)).collect()
    assert len(out) == 4
