"""Chat formatting with a loss mask (DataFrame functions only).

A declarative template names, for each role, the mark that opens its turns,
whether its text is trained on, and which role may follow.  Turn order is
validated by a finite-state machine over the roles.  Each turn becomes three
segments (opening mark, escaped text, closing mark) with a loss flag each; the
concatenated segments are the formatted conversation.  Turns stay rows: only
``format_chats`` puts a conversation into one row.

Escaping is reversible: the escape character becomes its own code first, then
each control string becomes a code, so that an escaped text holds no control
string and every escape character in it starts a code.

Defined results: a null text is empty; a null role is the role ``""``; turns of
equal number are ordered by role and text, null turns come first; rows that
repeat wholly are separate turns; rows with a null conversation id are left
out.  A conversation with an undeclared role or order is formatted like any
other and flagged ``valid = false``.  Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starwright.llm.common import whole_text


# Turn numbers that share all but their lowest bits are ordered together.
STRETCH = 10


@dataclass(frozen=True)
class Role:
    name: str
    follows: tuple[str, ...]  # roles it may come after; "" is the start
    loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: tuple[Role, ...]
    open: str = "### "  # + role + colon opens a turn
    colon: str = ": "
    close: str = "</turn>\n"
    escape: str = "\\"
    # control string -> letter of its code; the escape's own code is "b"
    codes: tuple[tuple[str, str], ...] = (("###", "h"), ("</turn>", "e"))


CHAT = Template((
    Role("system", ("",)),
    Role("user", ("", "system", "assistant")),
    Role("assistant", ("user",), loss=True),
))


def escaped(text: Column, t: Template) -> Column:
    out = F.replace(text, F.lit(t.escape), F.lit(t.escape + "b"))
    for control, letter in t.codes:
        out = F.replace(out, F.lit(control), F.lit(t.escape + letter))
    return out


def unescaped(text: Column, t: Template) -> Column:
    for control, letter in t.codes:
        text = F.replace(text, F.lit(t.escape + letter), F.lit(control))
    return F.replace(text, F.lit(t.escape + "b"), F.lit(t.escape))


def _role_name(role: Column, t: Template) -> Column:
    """Role as it stands in an opening mark: it must not hold the colon."""
    return F.replace(escaped(role, t), F.lit(":"), F.lit(t.escape + "c"))


def _step(before: Column, role: Column, t: Template) -> Column:
    """Whether the template's state machine goes from one role to another."""
    steps = [F.lit(f"{f}>{r.name}") for r in t.roles for f in r.follows]
    return F.array_contains(F.array(*steps), F.concat(before, F.lit(">"), role))


def _segments(role: Column, text: Column, t: Template) -> Column:
    trained = F.array(*[F.lit(r.name) for r in t.roles if r.loss])
    head = F.concat(F.lit(t.open), _role_name(role, t), F.lit(t.colon))
    seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    return F.array(seg(head, F.lit(False)), seg(escaped(text, t), F.array_contains(trained, role)),
                   seg(F.lit(t.close), F.lit(False)))


def format_turns(conversations: DataFrame, t: Template = CHAT) -> DataFrame:
    """One row per turn: conv_id, seq (from 0), step_valid (the state machine may
    go from the turn before to this one), segments (array of three struct(text,
    loss)), formatted (their concatenation; all of a conversation's in the order
    of ``seq`` are its formatted text), start (code points of the conversation
    before the turn) and loss_start, loss_length (the part under the loss mask,
    counted as ``start`` is; null for a turn without).

    Turns are ordered and counted within stretches of 2**``STRETCH`` turn numbers;
    the totals of earlier stretches come from a table of one row per stretch.
    So a long conversation is many tasks' work, and every step is linear; only
    turns whose numbers are equal or absent are one stretch, sorted on disk."""
    number = F.col("turn").cast("long")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", number.alias("turn"), whole_text("role").alias("role"), whole_text("text").alias("text"),
        F.coalesce(F.shiftright(number, STRETCH), F.lit(-(1 << 62))).alias("stretch"))
    # Only the length goes with the text where rows move; the segments are made after that.
    segments = _segments(F.col("role"), F.col("text"), t)
    rows = rows.withColumn("chars", sum((F.length(segments[i]["text"]).cast("long") for i in range(3)), F.lit(0)))

    earlier = Window.partitionBy("conv_id").orderBy("stretch")
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "stretch").agg(
        F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.max(F.struct("turn", "role"))["role"].alias("last"))
    totals = totals.select(
        "conv_id", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"),
        F.lag("last", 1, "").over(earlier).alias("role_before"))

    within = Window.partitionBy("conv_id", "stretch").orderBy("turn", "role", "text")
    rows = rows.select(
        "*", (F.row_number().over(within) - 1).alias("place"), F.lag("role").over(within).alias("previous"),
        F.coalesce(F.sum("chars").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("at"))
    rows = rows.drop("chars").join(totals, ["conv_id", "stretch"])
    rows = rows.withColumn("segments", segments)
    start = F.col("chars_before") + F.col("at")
    loss = F.col("segments")[1]["loss"]
    return rows.select(
        "conv_id", (F.col("n_before") + F.col("place")).alias("seq"),
        _step(F.coalesce("previous", "role_before"), F.col("role"), t).alias("step_valid"),
        "segments", F.concat(*[F.col("segments")[i]["text"] for i in range(3)]).alias("formatted"), start.alias("start"),
        F.when(loss, start + F.length(F.col("segments")[0]["text"])).alias("loss_start"),
        F.when(loss, F.length(F.col("segments")[1]["text"]).cast("long")).alias("loss_length"))


def format_chats(conversations: DataFrame, t: Template = CHAT) -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, segments
    (array of struct(text, loss)), formatted (their concatenation) and
    loss_spans (array of struct(start, length): code points of ``formatted``
    under the loss mask, from 0).  A conversation must fit into a row (2 GB);
    :func:`format_turns` has no such bound."""
    kept = F.struct("seq", "segments", "formatted", "loss_start", "loss_length")
    chats = format_turns(conversations, t).groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.bool_and("step_valid").alias("valid"),
        F.sort_array(F.collect_list(kept)).alias("turns"))
    return chats.select(
        "conv_id", "n_turns", "valid", F.flatten(F.transform("turns", lambda x: x["segments"])).alias("segments"),
        F.array_join(F.transform("turns", lambda x: x["formatted"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda x: x["loss_start"].isNotNull()), lambda x: F.struct(
            x["loss_start"].cast("int").alias("start"), x["loss_length"].cast("int").alias("length"))).alias("loss_spans"))


def _read_turn(piece: Column, t: Template) -> Column:
    """struct(role, text) of a formatted turn without its closing mark."""
    colon = F.instr(piece, t.colon)
    role = F.substring(piece, F.lit(len(t.open) + 1), colon - len(t.open) - 1)
    role = unescaped(F.replace(role, F.lit(t.escape + "c"), F.lit(":")), t)
    text = F.substring(piece, colon + len(t.colon), F.length(piece))
    return F.struct(role.alias("role"), unescaped(text, t).alias("text"))


def read_turn(formatted: Column, t: Template = CHAT) -> Column:
    """struct(role, text) read back from a formatted turn."""
    return _read_turn(F.substring(formatted, F.lit(1), F.length(formatted) - len(t.close)), t)


def read_turn_loss(formatted: Column, start: Column, loss_start: Column, loss_length: Column,
                   t: Template = CHAT) -> Column:
    """Text of a formatted turn under the loss mask, unescaped; null without."""
    return unescaped(F.substring(formatted, (loss_start - start + 1).cast("int"), loss_length.cast("int")), t)


def read_turns(formatted: Column, t: Template = CHAT) -> Column:
    """Turns (array of struct(role, text)) read back from a formatted text."""
    pieces = F.split(formatted, "\\Q" + t.close + "\\E")
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)  # what follows the last mark is empty
    return F.transform(pieces, lambda piece: _read_turn(piece, t))


def read_loss_text(formatted: Column, loss_spans: Column, t: Template = CHAT) -> Column:
    """All text under the loss mask, unescaped, read from a formatted text.  Each
    span is looked for from the text's start, so this is for conversations of
    ordinary length; long ones are read by :func:`read_turn_loss`."""
    return F.array_join(F.transform(loss_spans, lambda s: unescaped(
        F.substring(formatted, s["start"] + 1, s["length"]), t)), "")
