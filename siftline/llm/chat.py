"""Chat formatting with a role state machine, a declarative template and
per-segment loss flags. DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """How a conversation is written, and which turn orders are valid.

    ``transitions`` maps a state (the role before, or ``start``) to the roles
    that may follow; ``finals`` are the states in which a conversation may end.
    ``control`` lists every string that must not come out of a text unescaped.
    """

    turn_open: str = "<|turn|>"
    text_open: str = "<|text|>"
    turn_close: str = "<|close|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    transitions: tuple[tuple[str, str], ...] = (
        ("start", "system"), ("start", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user"),
    )
    finals: tuple[str, ...] = ("user", "assistant")
    control: tuple[str, ...] = (
        "<|turn|>", "<|text|>", "<|close|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
        "<|im_start|>", "<|im_end|>", "<|startoftext|>", "<|endoftext|>",
    )

    def __post_init__(self):
        if any(len(c) < 2 or "\\" in c for c in self.control):
            raise ValueError("control strings need two characters or more and no backslash")

    @property
    def overhead(self) -> int:
        """Characters that a turn has beside its role and text."""
        return len(self.turn_open + self.text_open + self.turn_close)


DEFAULT = ChatTemplate()


def escape(text: Column, template: ChatTemplate = DEFAULT) -> Column:
    """Put a backslash after each backslash and after the first character of
    each control string, so that none is left whole. ``unescape`` undoes it."""
    firsts = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in template.control)
    return F.regexp_replace(text, rf"(\\|{firsts})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def segments(conversations: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """Three segments for each turn, without gathering conversations:
    conv_id, turn, role, part (0 header, 1 text, 2 close), segment, loss."""
    parts = F.array(*(F.struct(F.lit(i).alias("part"), t.alias("segment"), l.alias("loss")) for i, (t, l) in enumerate(_parts(template, F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))))))
    return conversations.select("conv_id", "turn", "role", F.inline(parts))


def _parts(t: ChatTemplate, role: Column, text: Column) -> list[tuple[Column, Column]]:
    return [
        (F.concat(F.lit(t.turn_open), escape(role, t), F.lit(t.text_open)), F.lit(False)),
        (escape(text, t), role.isin(*t.loss_roles)),
        (F.lit(t.turn_close), F.lit(False)),
    ]


def format_chats(conversations: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, first_bad_turn (the
    index of the first turn that the state machine refuses, n_turns for a
    wrong end, else null), segments (array of struct segment, loss) and
    formatted (all segments joined).

    Turns go by ``turn``; ties by role, then text; a null turn comes first. A
    null role or text counts as empty; an unknown role is written but makes
    the conversation invalid. Rows without a conv_id form one conversation.
    Repeated rows are repeated turns. An empty table gives an empty table;
    other columns are not looked at. A conversation is one row of the result
    and so has to fit in a task, as its text and digest do.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.select("conv_id", "turn", "role", "text", F.array(*(
        F.struct(text.alias("segment"), loss.alias("loss")) for text, loss in _parts(template, F.col("role"), F.col("text"))
    )).alias("parts"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "parts"))).alias("turns"))
    edges = F.array(*(F.lit(f"{a} {b}") for a, b in template.transitions))
    step = lambda acc, t: F.struct(
        t["role"].alias("state"), (acc["at"] + 1).alias("at"),
        F.when(acc["bad"].isNull() & ~F.array_contains(edges, F.concat_ws(" ", acc["state"], t["role"])), acc["at"]).otherwise(acc["bad"]).alias("bad"),
    )
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))
    end = F.aggregate("turns", start, step, lambda acc: F.when(acc["bad"].isNull() & ~acc["state"].isin(*template.finals), acc["at"]).otherwise(acc["bad"]))
    segs = F.flatten(F.transform("turns", lambda t: t["parts"]))
    out = turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), end.alias("first_bad_turn"), segs.alias("segments"))
    return out.select(
        "conv_id", "n_turns", F.col("first_bad_turn").isNull().alias("valid"), "first_bad_turn", "segments",
        F.array_join(F.transform("segments", lambda s: s["segment"]), "").alias("formatted"),
    )


def read_back(formatted: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """Parse what ``format_chats`` wrote: conv_id, formatted, turns (array of
    struct role, text, from the formatted string alone), loss_text (all text
    under the loss flags, unescaped), and the state machine's valid and first_bad_turn."""
    turns = F.slice(F.split("formatted", _literal(template.turn_open)), 2, F.greatest(F.lit(1), F.length("formatted")))
    close = len(template.turn_close)

    def turn(s: Column) -> Column:
        role = F.substring_index(s, template.text_open, 1)
        at = F.length(role) + len(template.text_open)
        body = F.substring(s, at + 1, F.length(s) - at - close)
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["segment"]))
    return formatted.select("conv_id", "formatted", F.transform(turns, turn).alias("turns"), F.array_join(loss, "").alias("loss_text"), "valid", "first_bad_turn")


def _literal(s: str) -> str:
    return f"\\Q{s}\\E"
