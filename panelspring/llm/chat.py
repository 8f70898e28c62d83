"""Chat formatting: a finite-state machine over roles, and a template that tells what each of its moves writes.

The state is the role of the turn before. A declared move to the next role is allowed, any other is an error of the
conversation, which is still written. Each turn becomes text segments with a loss flag: marks never, its text as its role
says. Control strings within texts get a backslash behind their first character (those that have some get one more), so no
text can forge a mark and the written text can be read back. Turns are formatted row by row; a conversation of any size is
put in order by ranges. All of it is built-in expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import RANGE, carry, cut, within

#: Turns of a conversation that one task puts in order.
MOST_TURNS = 1_000_000


@dataclass(frozen=True)
class Role:
    """What stands before and after a turn's text, and whether the text counts for the loss."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """A declarative chat format. `begin` opens an exchange: it stands before a turn that follows one of the states in `fresh` ("" is the start)."""

    begin: str
    fresh: tuple[str, ...]
    roles: dict[str, Role]
    #: For roles that the template does not name: before the role's name, between the name and the text, after the text.
    other: tuple[str, str, str]
    #: Allowed moves: state -> next roles. The state is the role of the turn before, "" at the start.
    moves: dict[str, tuple[str, ...]]
    final: tuple[str, ...]
    controls: tuple[str, ...] = field(default=())

    def control_strings(self) -> list[str]:
        """All marks, without white space around them. Each begins with a character that no other mark has inside."""
        marks = [self.begin, *self.other, *[m for r in self.roles.values() for m in (r.before, r.after)], *self.controls]
        return sorted({m.strip() for m in marks if m.strip()})


INSTRUCT = Template(
    begin="<s>",
    fresh=("", "assistant"),
    roles={"system": Role("[SYS] ", " [/SYS]"), "user": Role("[INST] ", " [/INST]"), "assistant": Role(" ", "</s>", loss=True)},
    other=("[ROLE] ", " [TEXT] ", " [/ROLE]"),
    moves={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    final=("assistant",),
)


def _places(template: Template, extra: str) -> str:
    """A pattern of the places behind the first character of a control string, where `extra` stands before any backslashes and the rest."""
    firsts: dict[str, list[str]] = {}
    for c in template.control_strings():
        firsts.setdefault(c[0], []).append(re.escape(c[1:]))
    return "|".join(rf"(?<={re.escape(first)}){extra}(?=\\*(?:{'|'.join(rest)}))" for first, rest in sorted(firsts.items()))


def escape(text: Column, template: Template = INSTRUCT) -> Column:
    return F.regexp_replace(text, F.lit(_places(template, "")), F.lit(r"\\"))


def unescape(text: Column, template: Template = INSTRUCT) -> Column:
    return F.regexp_replace(text, F.lit(_places(template, r"\\")), F.lit(""))


def ordered(turns: DataFrame, most: int = MOST_TURNS) -> DataFrame:
    """(conv_id, number, state, role, text, last): turns in order, from 0, with the role of the one before ("" at the start).

    By turn, a null turn first, ties by role, then text; null roles and texts are empty. last marks a conversation's end.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows, hot = cut(rows, ["conv_id"], "turn", most)
    order = (F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"))
    w = within(["conv_id"], hot).orderBy(*order)
    rows = rows.withColumns({"number": (F.row_number().over(w) - 1).cast("long"), "state": F.lag("role").over(w), "last": F.lead(F.lit(False), 1, True).over(w)})
    if hot:
        key = F.struct(F.col("turn").isNotNull(), "turn", "role", "text")
        totals = {"n": F.count("*"), "end": F.max_by("role", key), "top": F.max(RANGE)}
        rows = carry(rows, ["conv_id"], totals, {"__n": lambda v: F.sum("n").over(v), "__end": lambda v: F.last("end").over(v), "__more": lambda v: F.count("*").over(v.rowsBetween(1, 1)) > 0})
        rows = rows.withColumns({"number": F.col("number") + F.coalesce("__n", F.lit(0)), "state": F.coalesce("state", "__end"), "last": F.col("last") & ~F.col("__more")})
    return rows.select("conv_id", "number", F.coalesce("state", F.lit("")).alias("state"), "role", "text", "last")


def segments(turns: DataFrame, template: Template = INSTRUCT, most: int = MOST_TURNS) -> DataFrame:
    """(conv_id, number, role, allowed, segments): each turn of turns (conv_id, turn, role, text) as an array of (text, loss).

    Segments follow one another without anything between, within a turn and from turn to turn. allowed says that the machine
    has a move from the turn before to this one, and for the last turn that it may end here. Repeated rows are turns of
    their own; a null conv_id is a conversation of its own. An empty table gives an empty one; other columns are not read.
    """
    rows = ordered(turns, most)
    moves = [F.col("state").eqNullSafe(s) & F.col("role").isin(*to) for s, to in template.moves.items()]
    legal = F.lit(False)
    for m in moves:
        legal = legal | m
    legal = legal & (~F.col("last") | F.col("role").isin(*template.final))
    name, between, end = template.other
    before, after, loss = F.concat(F.lit(name), escape(F.col("role"), template), F.lit(between)), F.lit(end), F.lit(False)
    for role, r in template.roles.items():
        at = F.col("role") == role
        before, after, loss = F.when(at, F.lit(r.before)).otherwise(before), F.when(at, F.lit(r.after)).otherwise(after), F.when(at, F.lit(r.loss)).otherwise(loss)
    begin = F.when(F.col("state").isin(*template.fresh), F.lit(template.begin)).otherwise(F.lit(""))
    part = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
    parts = F.array(part(F.concat(begin, before), F.lit(False)), part(escape(F.col("text"), template), loss), part(after, F.lit(False)))
    return rows.select("conv_id", "number", "role", legal.alias("allowed"), parts.alias("segments"))


def chats(rows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, valid, first_error, segments): the rows of segments(), a conversation each.

    first_error is the number of the first turn that the machine does not allow, null if valid. A conversation's text is one
    value of up to 2 GB; longer ones are for segments() alone.
    """
    turns = F.array_sort(F.collect_list(F.struct("number", "segments")))
    out = rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.min(F.when(~F.col("allowed"), F.col("number"))).alias("first_error"), turns.alias("t"))
    return out.select("conv_id", "n_turns", F.col("first_error").isNull().alias("valid"), "first_error", F.flatten(F.transform("t", lambda x: x.segments)).alias("segments"))


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s.text), "")


def loss_text(segments: Column, template: Template = INSTRUCT) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescape(s.text, template)), "")


def read_back(text: Column, template: Template = INSTRUCT) -> Column:
    """The turns of a formatted text, an array of (role, text)."""
    begin = f"(?:{re.escape(template.begin)})?"
    name, between, end = map(re.escape, template.other)
    known = {role: (re.escape(r.before), re.escape(r.after)) for role, r in template.roles.items()}
    whole = rf"(?s)\G{begin}(?:{name}.*?{between}.*?{end}|" + "|".join(f"{a}.*?{b}" for a, b in known.values()) + ")"
    turns = F.regexp_extract_all(text, F.lit(whole), F.lit(0))

    def turn(x: Column) -> Column:
        role, body = F.regexp_extract(x, rf"(?s)\A{begin}{name}(.*?){between}", 1), F.regexp_extract(x, rf"(?s)\A{begin}{name}.*?{between}(.*){end}\z", 1)
        for r, (a, b) in known.items():
            pattern = rf"(?s)\A{begin}{a}(.*){b}\z"
            role, body = F.when(x.rlike(pattern), F.lit(r)).otherwise(role), F.when(x.rlike(pattern), F.regexp_extract(x, pattern, 1)).otherwise(body)
        return F.struct(unescape(role, template).alias("role"), unescape(body, template).alias("text"))

    return F.transform(turns, turn)
