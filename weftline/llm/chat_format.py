r"""Conversations as training text: one text each, whose loss mask covers what the assistant says, in Spark expressions only.

A conversation's turns are collected as structs and sorted by (turn, role, text). Adjacent turns of one role are merged into one block by an
array aggregation, and all pieces are concatenated:

    ### user:
    first text</part>second text</turn>
    ### assistant:
    answer</turn>

Inside texts a backslash is doubled, and another stands within each `##` and each `</`, so that no text holds a control string; in a role one stands
within a colon and line break, too. A backslash thus always escapes the character behind it, and read_turns() gives back every role and text as it was.

The aggregation runs over SIZE turns at a time, each run starting from the role before it: a list that grows by one piece at a time
costs its square, so that it stays as short as SIZE and a conversation of any number of turns costs in proportion.
A conversation is one text and so one row, at most 2 GB; nothing but its own turns meets in a task.

Defined cases: null texts and roles are empty ones; rows without a conversation's id are one conversation, whose id is null; null turns come first; rows
that repeat a turn all stay, in the order of role and text; an empty table has no conversations; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK, HEAD, PART, END = "### ", ":\n", "</part>", "</turn>\n"
#: Turns of one run of the aggregation.
SIZE = 256
_PIECES = "array<struct<mark:string,text:string,loss:boolean>>"


def escaped(text: Column) -> Column:
    """text without control strings."""
    for plain, safe in (("\\", "\\\\"), ("##", "#\\#"), ("</", "<\\/")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\/#\n])", "$1")


def _header(role: Column) -> Column:
    return F.concat(F.lit(MARK), F.replace(escaped(role), F.lit(HEAD), F.lit(":\\\n")), F.lit(HEAD))


def _pieces(turns: Column, learn: str) -> Column:
    """Each turn's text and whether it is learned, with the marks that stand before it: all that a merge of the turns needs."""

    def step(state: Column, t: Column) -> Column:
        first, same = state["role"].isNull(), state["role"] == t["role"]
        mark = F.when(first, _header(t["role"])).when(same, F.lit(PART)).otherwise(F.concat(F.lit(END), _header(t["role"])))
        piece = F.struct(mark.alias("mark"), escaped(t["text"]).alias("text"), (t["role"] == learn).alias("loss"))
        return F.struct(t["role"].alias("role"), F.concat(state["pieces"], F.array(piece)).alias("pieces"))

    def run(k: Column) -> Column:
        before = F.get(turns, k * SIZE - 1)["role"]
        return F.aggregate(F.slice(turns, k * SIZE + 1, F.lit(SIZE)), F.struct(before.alias("role"), F.array().cast(_PIECES).alias("pieces")), step, lambda s: s["pieces"])

    return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(turns) - 1) / SIZE).cast("int")), run))


def format_chats(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, segments): each conversation's text, and the same text in segments (text, loss), in order, of which those with loss are
    what a model of the role `learn` is to learn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.select(F.col(id_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).select("conv_id", _pieces(F.col("turns"), learn).alias("pieces"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    parts = F.flatten(F.transform("pieces", lambda p: F.array(segment(p["mark"], F.lit(False)), segment(p["text"], p["loss"]))))
    chats = chats.select("conv_id", F.concat(parts, F.array(segment(F.lit(END), F.lit(False)))).alias("segments"))
    return chats.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_blocks(formatted: Column) -> Column:
    """The blocks of a formatted conversation: (role, texts), the texts being those of the merged turns."""

    def block(b: Column) -> Column:
        at = F.instr(b, HEAD)
        role, rest = F.substring(b, F.lit(len(MARK) + 1), at - len(MARK) - 1), F.substring(b, at + len(HEAD), F.length(b))
        return F.struct(unescaped(role).alias("role"), F.transform(F.split(rest, PART), unescaped).alias("texts"))

    return F.transform(F.filter(F.split(formatted, END), lambda b: b != ""), block)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: (role, text), as they were before formatting."""
    return F.flatten(F.transform(read_blocks(formatted), lambda b: F.transform(b["texts"], lambda t: F.struct(b["role"].alias("role"), t.alias("text")))))


def chat_digests(chats: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from them: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_blocks)."""
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    rows = chats.select("conv_id", read_turns(F.col("formatted")).alias("turns"), learned.alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"), F.size(read_blocks(F.col("formatted"))).cast("long").alias("n_blocks"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars", "n_blocks",
    )
