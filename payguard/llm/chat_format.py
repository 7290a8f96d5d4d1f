"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A conversation is a log of events in sequence: ``delta`` appends text to the message
of a turn, ``edit`` replaces it, ``regenerate`` discards that turn's message
and all later ones. The fold needs no loop: an event survives unless, later in
the log, its own turn is edited or a turn up to its own is regenerated; both are
windows over the log read backwards. Surviving texts join into
messages, messages render into one string with a loss mask over the assistant's texts.

The template marks turns as ``<turn ROLE>\\nTEXT</turn>\\n``. Inside texts and roles
``\\`` becomes ``\\b`` and ``<`` ``\\l`` (in roles also ``>`` ``\\g``), so no control string can
occur in them and two replacements undo the escape.

Everything is partitioned by conversation, whose string is one value of the result
anyway. Defined cases: null texts and roles are empty, null turns come first, a null
conversation id is a conversation of its own; events of one sequence number apply
in order of type and text; events of other types have no effect; a conversation
whose messages are all discarded has no row. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """Exact inverse: every backslash of an escaped text begins an escape, and
    the one for the backslash itself goes last."""
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def _unrole(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\g"), F.lit(">")))


def fold_events(events: DataFrame) -> DataFrame:
    """Events (conv_id, seq, type, turn, role, text) to the final messages
    (conv_id, turn, role, text); a message's role is that of its first surviving event with one."""
    def later(*keys: str):
        return (Window.partitionBy(*keys).orderBy(F.desc("seq"), F.desc("type"), F.desc("text"))
                .rowsBetween(Window.unboundedPreceding, -1))
    turn = F.coalesce("turn", F.lit(-2**63))
    redone = F.min(F.when(F.col("type") == "regenerate", turn)).over(later("conv_id"))
    edited = F.count(F.when(F.col("type") == "edit", 1)).over(later("conv_id", "turn"))
    alive = (events.withColumn("redone", redone).withColumn("edited", edited)
             .filter(F.col("type").isin("delta", "edit") & (F.col("redone").isNull() | (turn < F.col("redone"))) & (F.col("edited") == 0)))
    parts = F.sort_array(F.collect_list(F.struct("seq", "type", "text", "role")))
    m = alive.groupBy("conv_id", "turn").agg(parts.alias("parts"))
    return m.select("conv_id", "turn",
                    F.coalesce(F.try_element_at(F.filter("parts", lambda x: x["role"].isNotNull()), F.lit(1))["role"], F.lit("")).alias("role"),
                    F.array_join(F.transform("parts", lambda x: F.coalesce(x["text"], F.lit(""))), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (start and length
    in code points of each assistant text within formatted)."""
    head = F.concat(F.lit("<turn "), _role(F.col("role")), F.lit(">\n"))
    body = escape(F.col("text"))
    m = messages.select("conv_id", "turn", "role", head.alias("head"), body.alias("body"))
    size = (F.char_length("head") + F.char_length("body") + F.lit(len("</turn>\n"))).cast("long")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.char_length("head"))
    whole = F.sort_array(F.collect_list(F.struct("turn", F.concat("head", "body", F.lit("</turn>\n")).alias("t"))))
    loss = F.sort_array(F.collect_list(F.when(F.col("role") == LOSS_ROLE, F.struct(
        F.col("at").alias("start"), F.char_length("body").cast("long").alias("length")))))
    return m.groupBy("conv_id").agg(F.array_join(F.transform(whole, lambda x: x["t"]), "").alias("formatted"), loss.alias("loss"))


def parse(formatted: str | Column) -> Column:
    """The turns of a formatted string: array of (role, text)."""
    c = F.col(formatted) if isinstance(formatted, str) else formatted
    turns = F.split(c, "</turn>\n")

    def turn(x: Column) -> Column:
        close = F.locate(">", x)
        return F.struct(_unrole(F.substr(x, F.lit(7), close - 7)).alias("role"), unescape(F.substr(x, close + 2)).alias("text"))
    return F.transform(F.slice(turns, F.lit(1), F.size(turns) - 1), turn)


def loss_text(formatted: str = "formatted", loss: str = "loss") -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(F.col(formatted), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def events_of_turns(turns: DataFrame) -> DataFrame:
    """The log of finished turns (conv_id, turn, role, text): each streamed as
    two deltas. Rows of one turn number are messages of their own, by role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    half = F.floor(F.char_length("text") / 2).cast("int")
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("place", F.row_number().over(order).cast("long"))
    deltas = F.array(F.struct(F.lit(0).alias("k"), F.substr("text", F.lit(1), half).alias("text")),
                     F.struct(F.lit(1).alias("k"), F.substr("text", half + 1).alias("text")))
    return (t.withColumn("d", F.explode(deltas)).select(
        "conv_id", (F.col("place") * 2 + F.col("d.k")).alias("seq"), F.lit("delta").alias("type"),
        F.col("place").alias("turn"), "role", F.col("d.text").alias("text")))


def drafted(log: DataFrame) -> DataFrame:
    """A log of deltas with the detours of a real one, which folds to the same messages: a
    third of the turns are first streamed as a draft and then edited, a third of the conversations go
    on from a turn in another way before that turn is regenerated. Sequence numbers are spread to make room."""
    role, turn = F.col("role"), F.col("turn")
    spread = log.withColumn("seq", F.col("seq") * 10)
    first = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("seq"))
    mine = spread.withColumn("nth", first)
    odd = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3))
    redo = F.pmod(F.xxhash64("conv_id"), F.lit(3)) == 0

    def event(back: int, kind: str, text: Column, at: Column = turn, who: Column = role) -> Column:
        return F.struct((F.col("seq") - back).alias("seq"), F.lit(kind).alias("type"), at.alias("turn"), who.alias("role"), text.alias("text"))
    draft = F.concat(F.lit("draft </turn> of "), F.col("text"))
    edited = F.array(event(3, "delta", draft), event(2, "delta", F.lit(" more")), event(1, "edit", F.lit("")))
    another = F.array(event(9, "delta", draft), event(8, "delta", F.lit("another way"), turn + 1, F.lit("assistant")),
                      event(7, "edit", F.lit("edited"), turn + 1, F.lit("assistant")), event(6, "regenerate", F.lit(None).cast("string")))
    none = F.slice(edited, 1, 0)
    before = F.concat(F.when((F.col("nth") == 1) & redo & (odd != 1), another).otherwise(none), F.when((F.col("nth") == 1) & (odd == 1), edited).otherwise(none))
    own = F.array(event(0, "delta", F.col("text")))
    return mine.select("conv_id", F.explode(F.concat(before, own)).alias("e")).select("conv_id", "e.*")
