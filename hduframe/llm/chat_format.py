"""Chat formatting with DataFrame functions only: a finite-state machine over roles and a declarative template.

Each turn becomes three segments: what opens it, its text and what closes it; only the texts of roles whose ``loss`` is
set carry the loss flag.  Control strings of the template that occur inside a text are replaced by codes that start
with a backslash (and the backslash itself by one), so that a text can't open or close a turn and parsing gives it back.

A conversation is one row of the result, so its turns come together in one row by definition; turns are ordered by
turn, then role, then text, and repeated rows stay.  Null texts and roles count as empty; a null conv_id is a
conversation of its own.  Conversations that break the order of turns are formatted too, with ``valid`` false and
``bad_turn`` the place (from 0) of the first turn that the machine doesn't accept (the number of turns if it ends early; -1 if
all is well).  Texts of any length are kept whole.  An empty table gives no rows; columns other than conv_id, turn, role and text aren't read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """roles: how each is written; accepts: state -> role -> next state; ends: the states a conversation may end in."""

    roles: dict[str, Role]
    other: Role  # for roles that the template doesn't name; its opening string is followed by the role and a line end
    accepts: dict[str, dict[str, str]]
    start: str
    ends: tuple[str, ...]

    def controls(self) -> list[str]:
        strings = {s.strip() for r in (*self.roles.values(), self.other) for s in (r.open, r.close)}
        return sorted(strings, key=lambda s: (-len(s), s))


INSTRUCT = Template(
    roles={
        "system": Role("<<SYS>>\n", "\n<</SYS>>"),
        "user": Role("[INST] ", " [/INST]"),
        "assistant": Role("<s> ", "</s>", loss=True),
    },
    other=Role("[ROLE] ", "[/ROLE]"),
    accepts={"start": {"system": "briefed", "user": "asked"}, "briefed": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}},
    start="start",
    ends=("answered",),
)


def escape(text: Column, t: Template) -> Column:
    """The backslash first; the codes hold no control string and none comes about beside them."""
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for k, s in enumerate(t.controls()):
        out = F.replace(out, F.lit(s), F.lit(f"\\{k};"))
    return out


def unescape(text: Column, t: Template) -> Column:
    out = text
    for k, s in enumerate(t.controls()):
        out = F.replace(out, F.lit(f"\\{k};"), F.lit(s))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def _of(role: Column, t: Template, field: str) -> Column:
    return reduce(lambda c, kv: c.when(role == kv[0], F.lit(getattr(kv[1], field))), t.roles.items(), F).otherwise(F.lit(getattr(t.other, field)))


def _opening(role: Column, t: Template) -> Column:
    return F.when(role.isin(*t.roles), _of(role, t, "open")).otherwise(F.concat(F.lit(t.other.open), F.replace(escape(role, t), F.lit("\n"), F.lit("\\n")), F.lit("\n")))


def format_chats(df: DataFrame, template: Template = INSTRUCT, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation: n_turns, segments (array of text, loss), formatted, valid, bad_turn."""
    t = template
    turns = df.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    segment = lambda s, loss: F.struct(s.alias("text"), loss.alias("loss"))
    pieces = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                segment(_opening(x["role"], t), F.lit(False)),
                segment(escape(x["text"], t), _of(x["role"], t, "loss")),
                segment(_of(x["role"], t, "close"), F.lit(False)),
            ),
        )
    )
    # the machine: its state after each turn, "" once a turn isn't accepted; bad counts the accepted turns before
    step = reduce(lambda c, e: c.when(e[0], F.lit(e[1])), ((lambda a, x, s=s, r=r: (a["state"] == s) & (x["role"] == r), n) for s, to in t.accepts.items() for r, n in to.items()), _Cases())
    machine = F.aggregate(
        "turns",
        F.struct(F.lit(t.start).alias("state"), F.lit(0).alias("good")),
        lambda a, x: F.struct(step.column(a, x).alias("state"), F.when(step.column(a, x) != "", a["good"] + 1).otherwise(a["good"]).alias("good")),
    )
    return (
        chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), pieces.alias("segments"), machine.alias("m"))
        .select(
            "conv_id",
            "n_turns",
            "segments",
            F.array_join(F.col("segments.text"), "").alias("formatted"),
            F.col("m.state").isin(*t.ends).alias("valid"),
            F.when(F.col("m.state").isin(*t.ends), F.lit(-1)).otherwise(F.col("m.good")).cast("long").alias("bad_turn"),
        )
    )


class _Cases:
    """The transition table as CASE WHEN over a state and a turn."""

    def __init__(self, cases=()):
        self.cases = cases

    def when(self, cond, then):
        return _Cases((*self.cases, (cond, then)))

    def column(self, a: Column, x: Column) -> Column:
        return reduce(lambda c, ct: c.when(ct[0](a, x), ct[1]), self.cases, F).otherwise(F.lit(""))


def parse_chats(df: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Turns (array of role, text) read back from ``formatted`` alone."""
    t = template
    whole = "|".join(f"{re.escape(r.open)}[\\s\\S]*?{re.escape(r.close)}" for r in (*t.roles.values(), t.other))
    raw = F.regexp_extract_all("formatted", F.lit(whole), F.lit(0))

    def turn(x: Column) -> Column:
        role, body = F, F
        for name, r in t.roles.items():
            here = x.startswith(r.open)
            role = role.when(here, F.lit(name))
            body = body.when(here, F.substring(x, F.lit(len(r.open) + 1), F.length(x) - len(r.open) - len(r.close)))
        inner = F.substring(x, F.lit(len(t.other.open) + 1), F.length(x) - len(t.other.open) - len(t.other.close))
        role = role.otherwise(unescape(F.replace(F.substring_index(inner, "\n", 1), F.lit("\\n"), F.lit("\n")), t))
        body = body.otherwise(F.substring(inner, F.length(F.substring_index(inner, "\n", 1)) + 2, F.length(inner)))
        return F.struct(role.alias("role"), unescape(body, t).alias("text"))

    return df.withColumn("turns", F.transform(raw, turn))


PROBE = "</s>[INST] ok [/INST]"


def with_probe(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The contract's conversation -1 beside all others."""
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return df.select("conv_id", "turn", "role", "text").unionByName(probe)


def digests(chats: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """op5: read back from formatted texts and segments."""
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
    return (
        parse_chats(chats, template)
        .withColumn("loss_text", loss)
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
            F.length("loss_text").cast("long").alias("loss_chars"),
            F.sha2("loss_text", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
            "valid",
            "bad_turn",
        )
    )
