"""Chat formatting from an event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Kinds of event. message: the whole text; delta: text to append; edit: a new text for a
#: message; regenerate: drop the message's text and every later message.
KINDS = ("message", "delta", "edit", "regenerate")

_RANK = "__ch_rank"


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``(conv_id, msg, role, text)`` of a log of conversation events.

    ``events`` has ``conv_id, seq, kind, msg, role, text``; further columns are ignored.
    Within a conversation events apply in the order of ``seq``; equal ``seq`` are ordered
    by msg, kind (message, edit, regenerate, delta), role and text. What a left fold over
    that order would yield is stated without one: an event counts unless a later event
    resets its message (message, edit or regenerate) or a later regenerate names an
    earlier message. So the log is shuffled once, by conversation, and sorted.

    Events delivered twice (all six fields equal) count once. Events with a null conv_id,
    seq or msg, or with another kind, are dropped. Null texts are empty. A message's role is
    the last one given with it, null if none was. A message left without events does not appear;
    one that an edit or delta begins does. ``msg`` and ``seq`` may be of any type that has an order. Long texts stay whole;
    an empty log gives no rows.
    """
    e = events.select("conv_id", "seq", F.lower("kind").alias("kind"), "msg", "role", F.coalesce("text", F.lit("")).alias("text"))
    e = e.where(F.col("conv_id").isNotNull() & F.col("seq").isNotNull() & F.col("msg").isNotNull() & F.col("kind").isin(*KINDS))
    order = F.when(F.col("kind") == "message", 0).when(F.col("kind") == "edit", 1).when(F.col("kind") == "regenerate", 2).otherwise(3)
    e = e.withColumn("__ch_kind", order)
    log = Window.partitionBy("conv_id").orderBy("seq", "msg", "__ch_kind", "role", "text")
    same = Window.partitionBy("conv_id").orderBy("seq", "msg", "__ch_kind", "role", "text")
    repeated = F.coalesce(
        (F.lag("seq").over(same) == F.col("seq")) & (F.lag("msg").over(same) == F.col("msg")) & (F.lag("kind").over(same) == F.col("kind"))
        & F.lag("role").over(same).eqNullSafe(F.col("role")) & (F.lag("text").over(same) == F.col("text")),
        F.lit(False),
    )
    e = e.withColumn("__ch_rep", repeated).withColumn(_RANK, F.row_number().over(log)).where(~F.col("__ch_rep"))
    message = Window.partitionBy("conv_id", "msg").orderBy(_RANK)
    whole = message.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    e = e.withColumn("__ch_msg", F.dense_rank().over(Window.partitionBy("conv_id").orderBy("msg")))
    earlier = Window.partitionBy("conv_id").orderBy("__ch_msg").rangeBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("__ch_cut", F.max(F.when(F.col("kind") == "regenerate", F.col(_RANK))).over(earlier))
    e = e.where(F.col("__ch_cut").isNull() | (F.col("__ch_cut") < F.col(_RANK)))
    e = e.withColumn("__ch_reset", F.max(F.when(F.col("kind") != "delta", F.col(_RANK))).over(whole))
    e = e.withColumn("role", F.last("role", True).over(whole))
    e = e.where((F.col("__ch_reset").isNull() | (F.col(_RANK) >= F.col("__ch_reset"))))
    piece = F.when(F.col("kind") == "regenerate", F.lit("")).otherwise(F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct(F.col(_RANK).alias("r"), piece.alias("t"), F.col("kind").alias("k"))))
    folded = e.groupBy("conv_id", "msg").agg(F.first("role").alias("role"), parts.alias("__ch_parts"))
    folded = folded.where(F.exists("__ch_parts", lambda p: p["k"] != "regenerate"))
    return folded.select("conv_id", "msg", "role", F.concat_ws("", F.transform("__ch_parts", lambda p: p["t"])).alias("text"))


def render_chat(messages: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """One row ``(conv_id, n_messages, text)`` per conversation: the messages in order of msg.

    ``<|`` inside a message is written ``< |``, so that a text cannot forge a marker. A
    null role is rendered as ``unknown``; equal msg are ordered by role and text.
    """
    clean = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    role = clean(F.coalesce("role", F.lit("unknown")))
    line = F.concat(F.lit(start), role, F.lit("\n"), clean(F.coalesce("text", F.lit(""))), F.lit(end + "\n"))
    turns = F.array_sort(F.collect_list(F.struct("msg", F.coalesce("role", F.lit("unknown")).alias("role"), line.alias("line"))))
    return (
        messages.groupBy("conv_id").agg(turns.alias("__ch_turns"))
        .select("conv_id", F.size("__ch_turns").alias("n_messages"), F.array_join(F.transform("__ch_turns", lambda t: t["line"]), "").alias("text"))
    )


def stream_events(conversations: DataFrame) -> DataFrame:
    """The event log of a table ``(conv_id, turn, role, text)`` of whole messages, as a client with drafts would log it.

    A turn of an assistant opens with a ``message``, streams a draft and begins the next message; then it is
    regenerated and streams its text, one ``delta`` for each line. Any other turn opens with a draft, which an ``edit``
    replaces by the first line; the further lines are deltas. Folding the log gives the table again.

    Rows with a null turn or conv_id give no events; if a turn occurs more than once, the row whose role and text
    sort last counts. Null and empty texts are one empty line. Turns of up to 18 digits keep their order.
    Other columns are ignored; an empty table gives no events.
    """
    w = Window.partitionBy("conv_id", "turn").orderBy(F.col("role").desc_nulls_last(), F.col("text").desc_nulls_last())
    rows = conversations.select("conv_id", "turn", "role", "text").where("conv_id is not null and turn is not null")
    rows = rows.withColumn("__ch_row", F.row_number().over(w)).where("__ch_row = 1")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    event = lambda kind, text, role="role", later=False: F.struct(F.lit(kind).alias("kind"), F.lit(later).alias("later"), (F.col(role) if role == "role" else F.lit(role)).alias("role"), text.alias("text"))
    rest = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: event("delta", F.concat(F.lit("\n"), x)))
    again = F.array(event("message", F.lit("")), event("delta", F.lit("draft")), event("message", F.lit("too early"), "tool", True), event("regenerate", F.lit("")), event("delta", F.get(lines, F.lit(0))))
    edited = F.array(event("message", F.lit("draft")), event("delta", F.lit(" text")), event("edit", F.get(lines, F.lit(0))))
    opened = F.concat(F.when(F.col("role") == "assistant", again).otherwise(edited), rest)
    return rows.select("conv_id", F.col("turn").cast("decimal(18,0)").alias("turn"), F.posexplode(opened).alias("__ch_i", "e")).select(
        "conv_id",
        (F.col("turn") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("__ch_i")).alias("seq"),
        F.col("e.kind").alias("kind"),
        (F.col("turn") + F.col("e.later").cast("int")).alias("msg"),
        F.col("e.role").alias("role"),
        F.col("e.text").alias("text"),
    )


def format_chat(events: DataFrame) -> DataFrame:
    """Fold a log of events into final messages and render each conversation: ``(conv_id, n_messages, text)``.

    What nulls, ties, repeated events and other columns give is stated at ``fold_events`` and ``render_chat``.
    """
    return render_chat(fold_events(events))
