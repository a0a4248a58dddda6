"""Chat formatting: conversations folded from event logs, rendered with a reversible template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import row_key

#: Markers of a turn by role; any other role (and its name) goes into a generic marker.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("[SYS] ", " [/SYS]")}
OTHER = ("[ROLE ", "] ", " [/ROLE]")
#: Where a turn begins in a rendering: no escaped text holds one of these.
TURN_START = r"(?=\[INST\] |<s> |\[SYS\] |\[ROLE )"


def escape(text: Column) -> Column:
    r"""Put a backslash after each ``[``, ``]``, ``<`` and before each backslash, so no marker can occur."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), r"([\[\]<])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[\]<\\])\\", "$1")


def fold_events(
    log: DataFrame, conv: str = "conv_id", seq: str = "seq", kind: str = "kind", target: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Fold an event log into final messages: ``conv_id, messages array<struct<role, text>>``.

    Events of a conversation in order of ``seq`` (nulls first; ties by target, role, text and kind):
    ``message`` appends a message; ``delta`` adds its text to the last message, or begins one;
    ``edit`` replaces the text of the message with number ``target`` (from 0); ``regenerate`` does
    so and drops every later message. An edit or regeneration of a message that isn't there, and an
    unknown or null kind, change nothing. Null texts and roles are empty; rows without a conversation
    are one; rows that repeat are events of their own; an empty log gives no rows; other columns are
    ignored.

    One sorted pass over a conversation gives the number of messages after each event, and so the
    message that it acts on; a message is its last beginning, the last text put in its place since,
    and all deltas after that, joined once. So time grows with the log, however many deltas or edits a
    conversation or a message has, and texts of any length are copied a few times at most. Each
    conversation is one group, as its rendering is one value.
    """
    events = log.select(
        F.col(conv).alias("conv_id"),
        F.col(seq).alias("seq"),
        F.col(target).cast("long").alias("target"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.col(kind).alias("kind"),
    )
    order = Window.partitionBy("conv_id").orderBy("seq", "target", "role", "text", "kind")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    writes = F.col("kind").isin("message", "delta")
    cuts = (F.col("kind") == "regenerate") & (F.col("target") >= 0)
    # messages that began, less what regenerations took: a regeneration leaves at most target + 1 of those there were
    events = events.withColumns({"_r": F.row_number().over(order), "_writes": F.count_if(writes).over(so_far)})
    events = events.withColumn("_begins", (F.coalesce(F.col("kind") == "message", F.lit(False))) | (F.coalesce(writes, F.lit(False)) & (F.col("_writes") == 1)))
    events = events.withColumn("_sum", F.count_if("_begins").over(so_far))
    events = events.withColumn("_n", F.least("_sum", F.col("_sum") + F.min(F.when(cuts, F.col("target") + 1 - F.col("_sum"))).over(so_far)))
    before = F.coalesce(F.lag("_n").over(order), F.lit(0))
    there = (F.col("target") >= 0) & (F.col("target") < F.col("_before"))
    at = F.when(writes, F.col("_n") - 1).when(F.col("kind").isin("edit", "regenerate") & there, F.col("target"))
    acts = events.withColumn("_before", before).withColumn("_at", at)
    puts = F.col("_begins") | ~F.coalesce(writes, F.lit(False))
    piece = F.struct("_r", "text")
    messages = acts.groupBy("conv_id", "_at").agg(
        F.max(F.struct("_r", "_n")).alias("_last"),
        F.max(F.when(F.col("_begins"), F.struct("_r", "role"))).alias("_first"),
        F.max(F.when(puts, piece)).alias("_put"),
        F.collect_list(F.when(~puts, piece)).alias("_deltas"),
    )
    later = F.filter(F.sort_array("_deltas"), lambda d: d["_r"] > F.col("_put._r"))
    joined = F.concat_ws("", F.array("_put.text"), F.transform(later, lambda d: d["text"]))
    one = F.struct("_at", F.col("_first.role").alias("role"), joined.alias("text"))
    folded = messages.groupBy("conv_id").agg(F.max("_last").alias("_last"), F.collect_list(F.when(F.col("_at").isNotNull(), one)).alias("_all"))
    final = F.filter(F.sort_array("_all"), lambda m: m["_at"] < F.col("_last._n"))
    return folded.select("conv_id", F.transform(final, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("messages"))


def _render_turn(m: Column) -> Column:
    body = escape(m["text"])
    out = F.concat(F.lit(OTHER[0]), escape(m["role"]), F.lit(OTHER[1]), body, F.lit(OTHER[2]))
    for role, (before, after) in MARKS.items():
        out = F.when(m["role"] == role, F.concat(F.lit(before), body, F.lit(after))).otherwise(out)
    return out


def render(folded: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans array<struct<start, end>>`` of folded conversations.

    ``loss_spans`` covers the escaped assistant texts in ``formatted``, in code points from 0, end
    exclusive; markers are never under the mask. A conversation without messages (or null ones)
    renders empty; an empty table gives no rows; rows that repeat an id with other messages are a
    conversation each, rows that repeat whole are one; other columns are dropped.
    """
    begin, end = (len(x) for x in MARKS["assistant"])
    told = F.transform("messages", lambda m: F.struct(m["role"].isNull(), m["role"], m["text"].isNull(), m["text"]))
    keyed = folded.select("conv_id", "messages", row_key(told).alias("_which"))  # once for a conversation, not for each turn
    turns = keyed.select("conv_id", "_which", F.posexplode_outer("messages").alias("_pos", "_m"))
    turns = turns.withColumn("_turn", _render_turn(F.col("_m"))).withColumn("_n", F.coalesce(F.char_length("_turn"), F.lit(0)).cast("long"))
    order = Window.partitionBy("conv_id", "_which").orderBy("_pos")
    turns = turns.withColumn("_before", F.lag("_pos").over(order)).where("_before is null or _before <> _pos")
    turns = turns.withColumn("_stop", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    span = F.struct((F.col("_stop") - F.col("_n") + begin).alias("start"), (F.col("_stop") - end).alias("end"))
    whole = turns.groupBy("conv_id", "_which").agg(
        F.collect_list(F.when(F.col("_pos").isNotNull(), F.struct("_pos", "_turn"))).alias("_turns"),
        F.sort_array(F.collect_list(F.when(F.col("_m.role") == "assistant", span))).alias("loss_spans"),
    )
    return whole.select("conv_id", F.concat_ws("", F.transform(F.sort_array("_turns"), lambda t: t["_turn"])).alias("formatted"), "loss_spans")


def parse(formatted: Column) -> Column:
    """The messages of a rendering, as ``array<struct<role, text>>``; the inverse of rendering."""

    def read(t: Column) -> Column:
        head = F.instr(t, OTHER[1])
        out = F.struct(
            unescape(F.substring(t, F.lit(len(OTHER[0]) + 1), head - len(OTHER[0]) - 1)).alias("role"),
            unescape(F.substring(t, head + len(OTHER[1]), F.char_length(t) - head - len(OTHER[1]) - len(OTHER[2]) + 1)).alias("text"),
        )
        for role, (before, after) in MARKS.items():
            body = F.substring(t, F.lit(len(before) + 1), F.char_length(t) - len(before) - len(after))
            out = F.when(F.startswith(t, F.lit(before)), F.struct(F.lit(role).alias("role"), unescape(body).alias("text"))).otherwise(out)
        return out

    return F.transform(F.filter(F.split(formatted, TURN_START), lambda t: t != ""), read)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))))
