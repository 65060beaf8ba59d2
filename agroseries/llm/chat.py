"""Chat formatting: a finite-state machine over roles and a declarative template.

``segments`` turns every turn into text segments, each with a loss flag;
``conversations`` puts the segments of a conversation together and says
whether its turns are in an order that the machine accepts; ``read_back``
parses the formatted text into turns and the text under the loss mask.

Control strings inside a role or text are escaped reversibly: one more
backslash goes between ``<`` and ``|``, so ``<|`` occurs in formatted text only
where the template put it.  Line breaks in a role are written ``%0A``.

Defined results: null role and null text count as empty; turns are taken in the
order of (turn, role, text), nulls first, so that repeated rows and ties have
one order; an unknown role or a turn out of order leaves ``valid`` false and the
conversation is still formatted; a null conv_id is a conversation of its own.
A conversation's formatted text is one value, so one conversation must fit a row
(2 GB); nothing else is gathered by conversation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


@dataclass(frozen=True)
class Template:
    """How turns are marked, which roles are learned from and who may follow whom."""

    opening: str = "<|im_start|>"
    after_role: str = "\n"
    closing: str = "<|im_end|>"
    between: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> states that may follow; "" is the start
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"),
        "tool": ("assistant", "tool"),
    })
    last: tuple[str, ...] = ("assistant",)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def segments(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Per turn: its place, the step of the machine and three segments (header,
    body, footer) with their loss flags.  Needs conv_id, turn, role, text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn("before", F.lag("role", 1, "").over(order)).withColumn("place", F.row_number().over(order))
    allowed = F.lit(False)
    for state, nexts in template.follows.items():
        first = (F.col("place") == 1) if state == "" else (F.col("place") > 1) & (F.col("before") == state)
        allowed = allowed | (first & F.col("role").isin(*nexts))
    learn = F.col("role").isin(*template.loss_roles)
    segment = lambda x, loss: F.struct(x.alias("text"), loss.alias("loss"))
    return t.select(
        "conv_id", "place", "role", allowed.alias("step_ok"),
        F.array(
            segment(F.concat(F.lit(template.opening), escape_role(F.col("role")), F.lit(template.after_role)), F.lit(False)),
            segment(escape(F.col("text")), learn),
            segment(F.lit(template.closing + template.between), F.lit(False)),
        ).alias("segments"),
    )


def conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, formatted, loss_spans (start and length in code points), valid, first_bad
    (the first place where the machine does not go on; null if it only may not end)."""
    own = segments(turns, template).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "role", "segments"))).alias("turns"),
        F.min("step_ok").alias("steps_ok"), F.min(F.when(~F.col("step_ok"), F.col("place"))).alias("first_bad"))
    flat = own.withColumn("all", F.flatten("turns.segments"))
    spans = F.expr("""
        filter(aggregate(`all`, named_struct('at', 0L, 'spans', cast(array() AS array<struct<start: bigint, length: bigint, loss: boolean>>)),
          (s, x) -> named_struct('at', s.at + char_length(x.text),
            'spans', concat(s.spans, array(named_struct('start', s.at, 'length', cast(char_length(x.text) AS bigint), 'loss', x.loss))))).spans,
          x -> x.loss)""")
    return flat.select(
        "conv_id", F.array_join("all.text", "").alias("formatted"),
        F.transform(spans, lambda x: F.struct(x["start"], x["length"])).alias("loss_spans"),
        (F.col("steps_ok") & F.element_at("turns.role", -1).isin(*template.last)).alias("valid"), "first_bad")


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Parse ``conversations`` again: adds turns (role, text) and loss_text."""
    literal = lambda mark: r"\Q" + mark + r"\E"
    parts = F.expr("slice(parts, 2, size(parts) - 1)")  # nothing stands before the first mark

    def turn(part: Column) -> Column:
        halves = F.split(part, literal(template.after_role), 2)
        return F.struct(unescape_role(halves[0]).alias("role"),
                        unescape(F.split(halves[1], literal(template.closing), 2)[0]).alias("text"))

    under = F.transform("loss_spans", lambda s: unescape(
        F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int"))))
    return (formatted.withColumn("parts", F.split("formatted", literal(template.opening)))
            .withColumn("turns", F.transform(parts, turn)).drop("parts")
            .withColumn("loss_text", F.array_join(under, "")))
