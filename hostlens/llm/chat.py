"""Chat formatting: a finite-state machine over roles, a declarative template, loss flags by segment.

Only Spark SQL functions. A conversation is one training example, so its turns meet in one row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """marks: role -> (opening mark, closing mark); any other role r is written as other[0] + r + other[1] + text + other[2].
    loss: roles whose text is trained on. moves: state -> states that may follow; finals: states that may end a conversation.
    """

    marks: dict = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple = ("[TURN]", "[BODY]", "[/TURN]")
    loss: tuple = ("assistant",)
    moves: dict = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    finals: tuple = ("assistant",)

    @property
    def controls(self) -> list[str]:
        return [*{m: 0 for pair in self.marks.values() for m in pair}, *self.other]


LLAMA_LIKE = Template()


def escape(text: Column, t: Template = LLAMA_LIKE) -> Column:
    """A backslash follows each backslash, and the first character of each control string: no control string is left."""
    heads = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in t.controls)
    return F.regexp_replace(text, rf"\\|{heads}", r"$0\\")


def unescape(text: Column) -> Column:
    """The text that escape() was given."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1").alias("text")


# In escaped text a backslash stands after the character it protects, or after another
# backslash; taking pairs from the left, `\\` is one backslash and `\x` is x.


def format_chat(turns: DataFrame, template: Template = LLAMA_LIKE) -> DataFrame:
    """One row for each conversation of (conv_id, turn, role, text).

    conv_id, n_turns, valid (the role machine accepts the order), bad_turn (position from 1 of the
    first turn it refuses, one past the last if the end is refused, else null), segments (array of text, loss), formatted (all
    segment texts joined).

    * Invalid conversations are formatted all the same; `valid` lets a caller drop them.
    * Null role or text is the empty text; an unknown role is refused by the machine and written
      with the template's `other` marks. Ties in turn are ordered by role, then text; repeated
      rows are repeated turns. Null turns come first. Rows of null conv_id are one conversation.
    * Other columns are ignored. An empty table gives an empty result.
    """
    t = template
    rows = turns.select("conv_id", F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("_turns"))

    # the machine: state is the last accepted role, "" once a turn was refused
    def table(role: Column, pick) -> Column:
        out = F.lit(None).cast("string")
        for name in reversed(t.marks):
            out = F.when(role == name, pick(name)).otherwise(out)
        return out

    pairs = F.array(*[F.lit(f"{a}>{b}") for a, after in t.moves.items() for b in after])
    walk = F.aggregate(
        F.transform("_turns", lambda x: x.role),
        F.struct(F.lit("start").alias("state"), F.lit(0).alias("seen"), F.lit(None).cast("int").alias("bad")),
        lambda s, role: F.when(s.bad.isNotNull(), s).otherwise(
            F.when(F.array_contains(pairs, F.concat(s.state, F.lit(">"), role)), F.struct(role.alias("state"), (s.seen + 1).alias("seen"), F.lit(None).cast("int").alias("bad")))
            .otherwise(F.struct(s.state.alias("state"), (s.seen + 1).alias("seen"), (s.seen + 1).alias("bad")))
        ),
        lambda s: F.when(s.bad.isNull() & ~s.state.isin(*t.finals), s.seen + 1).otherwise(s.bad),
    )

    def segments(x: Column) -> Column:
        seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        known = x.role.isin(*t.marks)
        opening = F.when(known, table(x.role, lambda r: F.lit(t.marks[r][0]))).otherwise(F.concat(F.lit(t.other[0]), escape(x.role, t), F.lit(t.other[1])))
        closing = F.when(known, table(x.role, lambda r: F.lit(t.marks[r][1]))).otherwise(F.lit(t.other[2]))
        return F.array(seg(opening, F.lit(False)), seg(escape(x.text, t), x.role.isin(*t.loss)), seg(closing, F.lit(False)))

    out = convs.select("conv_id", F.size("_turns").cast("bigint").alias("n_turns"), walk.alias("bad_turn"), F.flatten(F.transform("_turns", segments)).alias("segments"))
    return out.select("conv_id", "n_turns", F.col("bad_turn").isNull().alias("valid"), "bad_turn", "segments", F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"))


def parse_chat(formatted: Column, template: Template = LLAMA_LIKE) -> Column:
    """Reads formatted text back: an array of (role, text), as format_chat() was given them."""
    t = template
    q = re.escape
    # each branch is one role: opening mark, body, closing mark
    branches = [rf"{q(a)}(.*?){q(b)}" for a, b in t.marks.values()] + [rf"{q(t.other[0])}(.*?){q(t.other[1])}(.*?){q(t.other[2])}"]
    pattern = "(?s)" + "|".join(branches)
    whole = F.regexp_extract_all(formatted, F.lit(pattern), F.lit(0))

    def turn(piece: Column) -> Column:
        out = F.struct(
            unescape(F.substring_index(F.substring(piece, F.lit(len(t.other[0]) + 1), F.length(piece)), t.other[1], 1)).alias("role"),
            unescape(F.regexp_extract(piece, rf"(?s)^{q(t.other[0])}.*?{q(t.other[1])}(.*){q(t.other[2])}$", 1)).alias("text"),
        )
        for role, (a, b) in t.marks.items():
            body = F.substring(piece, F.lit(len(a) + 1), F.length(piece) - len(a) - len(b))
            out = F.when(piece.startswith(a), F.struct(F.lit(role).alias("role"), unescape(body).alias("text"))).otherwise(out)
        return out

    return F.transform(whole, turn)
