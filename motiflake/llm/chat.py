"""Chat formatting from an event log.

Events of a message are folded into its final text, messages are rendered into a template whose marks cannot occur inside
escaped text, and the loss mask names the stretches that an assistant wrote. Only SQL functions are used.

Grouping is by message, then by ``PART`` successive turns: a conversation of any length is spread over as many groups
as it has parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let

#: Turns that one row of the output holds at most.
PART = 64
OPEN, MID, CLOSE = "### ", ": ", " </turn>\n"
# Characters that marks are made of, and what stands for them. The backslash comes first.
TEXT_ESCAPES = (("\\", "\\s"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*TEXT_ESCAPES, (":", "\\c"), ("\n", "\\n"))
#: Events that give a message a new text; a delta adds to it, and a delete takes the message away. ``message`` begins one.
FRESH = ("message", "edit", "regenerate")


def escape(text: Column, table: tuple[tuple[str, str], ...] = TEXT_ESCAPES) -> Column:
    for char, mark in table:
        text = F.replace(text, F.lit(char), F.lit(mark))
    return text


def unescape(text: Column) -> Column:
    """Undoes both tables: a mark's backslash never stands for itself, so marks are told apart in any order but
    for the backslash's, which comes last."""
    for char, mark in reversed(ROLE_ESCAPES):
        text = F.replace(text, F.lit(mark), F.lit(char))
    return text


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of events (conv_id, seq, turn, event, role, text).

    A turn's events are taken by seq, equal ones by event (``message`` first), role and text. Each ``message`` begins a
    message, so a turn that holds several, as rows with the same turn or with none do, keeps each of them; the events after it
    are its own, and those before a turn's first one make a message of their own. A message's text is that of the
    last event of ``FRESH`` and of all deltas after it; one whose last event but for deltas is a delete is left out. Its
    role is the last one given, else empty. A null text is empty, a null event a message; null ids and turns are values like
    others, first in order.
    """
    event = F.coalesce("event", F.lit("message"))
    row = F.struct(
        "seq",
        (event != "message").alias("later"),
        event.alias("event"),
        F.col("role").alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    logs = events.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(row)).alias("log"))

    def split(log: Column) -> Column:
        begun = F.filter(F.transform(log, lambda e, i: F.when((i == 0) | ~e["later"], i)), lambda i: i.isNotNull())
        return let(begun, lambda at: F.transform(at, lambda i, j: F.slice(log, i + 1, F.coalesce(F.get(at, j + 1), F.size(log)) - i)))

    def folded(log: Column) -> Column:
        marks = F.transform(log, lambda e, i: F.when(e["event"] != "delta", i))
        last = F.array_max(marks)
        gone = F.coalesce(F.get(log, last)["event"] == "delete", F.lit(False))
        rest = let(F.coalesce(last, F.lit(0)), lambda at: F.slice(log, at + 1, F.size(log)))
        roles = F.filter(F.transform(log, lambda e: e["role"]), lambda r: r.isNotNull())
        return F.struct(
            gone.alias("gone"),
            F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
            F.array_join(F.transform(rest, lambda e: e["text"]), "").alias("text"),
        )

    each = logs.select("conv_id", "turn", F.explode(let(F.col("log"), split)).alias("log"))
    out = each.select("conv_id", "turn", let(F.col("log"), folded).alias("m"))
    return out.filter("not m.gone").select("conv_id", "turn", "m.role", "m.text")


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """Rows (conv_id, part, formatted, loss) of messages (conv_id, turn, role, text).

    Parts of ``PART`` turns by turn number follow one another; a conversation's text is that of its parts in order.
    formatted marks each turn, ``### role: text </turn>`` and a line end, with text and role escaped so that both can be
    read back. loss is an array<struct<start, length>> of code points in formatted: each text of the trained
    role, in order, without marks. Messages of one conversation and turn are ordered by role and text, as escaped. Null roles
    and texts are empty; an empty table gives an empty one.
    """
    role = F.coalesce("role", F.lit(""))
    row = F.struct(
        "turn",
        escape(role, ROLE_ESCAPES).alias("role"),
        escape(F.coalesce("text", F.lit(""))).alias("text"),
        (role == trained).alias("trained"),
    )
    part = F.coalesce(F.floor(F.col("turn") / PART), F.lit(-(1 << 62)))
    grouped = messages.groupBy("conv_id", part.alias("part")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MID))
    pieces = F.transform("turns", lambda t: F.concat(head(t), t["text"], F.lit(CLOSE)))

    def built(p: Column) -> Column:
        starts = F.aggregate(
            F.transform(p, lambda x: F.char_length(x)),
            F.array(F.lit(0)),
            lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)),
        )

        def masks(at: Column) -> Column:
            one = lambda t, i: F.when(
                t["trained"],
                F.struct(
                    (F.get(at, i) + F.char_length(head(t))).alias("start"), F.char_length(t["text"]).alias("length")
                ),
            )
            return F.filter(F.transform("turns", one), lambda s: s.isNotNull())

        return F.struct(F.array_join(p, "").alias("formatted"), let(starts, masks).alias("loss"))

    return grouped.select("conv_id", "part", let(pieces, built).alias("r")).select("conv_id", "part", "r.*")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted part, read back."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda x: x != "")

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, MID, 1)
        return F.struct(
            unescape(F.substring(head, F.lit(len(OPEN) + 1), F.char_length(head))).alias("role"),
            unescape(F.substring(piece, F.char_length(head) + len(MID) + 1, F.char_length(piece))).alias("text"),
        )

    return F.transform(pieces, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, read back."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
