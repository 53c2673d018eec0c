"""Chat formatting from a declarative template, in DataFrame functions only.

A :class:`Template` states the roles, what stands before and after a text, which roles are trained on, and the moves of a
finite-state machine over roles.  A conversation's turns become text segments, each with a loss flag: the mark before a
text, the text, the mark after it.  The machine runs over the roles in turn order and tells whether the order is valid and
where it stopped.

Control strings inside texts are escaped so that the output can be read back: a backslash is doubled and ``<|`` becomes
``<\\|``; so ``<|`` stands in the output only where a mark does.  A role is written the same way, its line breaks as the mark
``<|nl|>``.

Defined cases: a null text is empty; a null role is the empty role, which no template knows; turns of equal number are
ordered by role and text; a null turn comes first; invalid conversations are formatted all the same and flagged; repeated
rows are turns of their own; an empty table gives an empty result.  A conversation is one output row, so its size is
that of the conversation; conversations are spread by id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiermill.llm.common import whole

BREAK = "<|nl|>"


@dataclass(frozen=True)
class Template:
    """Marks may hold ``{role}``.  ``moves`` maps (state, role) to a state; whatever is missing leads to ``error``."""

    before: str = "<|im_start|>{role}\n"
    after: str = "<|im_end|>\n"
    trained: tuple[str, ...] = ("assistant",)
    start: str = "start"
    final: tuple[str, ...] = ("answered",)
    error: str = "error"
    moves: dict = field(default_factory=lambda: {
        ("start", "system"): "instructed", ("start", "user"): "asked", ("instructed", "user"): "asked",
        ("asked", "assistant"): "answered", ("answered", "user"): "asked"})


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _mark(mark: str, role: Column) -> Column:
    parts = mark.split("{role}")
    pieces = [F.lit(parts[0])]
    for p in parts[1:]:
        pieces += [role, F.lit(p)]
    return F.concat(*pieces)


def machine(roles: Column, template: Template) -> Column:
    """The state after the roles."""
    moves = F.create_map(*[F.lit(x) for (s, r), to in template.moves.items() for x in (f"{s}\n{r}", to)])
    return F.aggregate(roles, F.lit(template.start), lambda state, role: F.coalesce(
        F.try_element_at(moves, F.concat(state, F.lit("\n"), role)), F.lit(template.error)))


def format_chats(turns: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """``conv_id, segments, state, valid``: ``segments`` are (text, loss), in output order."""
    t = turns.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), whole(F.col(role)).alias("role"),
                                                            whole(F.col(text)).alias("text")).alias("t"))
    t = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))

    def segments(x):
        name = F.replace(escape(x.role), F.lit("\n"), F.lit(BREAK))
        part = lambda c, loss: F.struct(c.alias("text"), loss.alias("loss"))
        return F.array(part(_mark(template.before, name), F.lit(False)),
                       part(escape(x.text), x.role.isin(*template.trained)),
                       part(_mark(template.after, name), F.lit(False)))

    state = machine(F.transform("t", lambda x: x.role), template)
    return (t.select("conv_id", F.flatten(F.transform("t", segments)).alias("segments"), state.alias("state"))
             .withColumn("valid", F.col("state").isin(*template.final)))


def formatted_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s.text), "")


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescape(s.text)), "")


def read_turns(text: Column, template: Template = Template()) -> Column:
    """``(role, text)`` of each turn of a formatted text, for templates whose mark before a text is
    ``<mark>{role}<line break>``."""
    head, tail = template.before.split("{role}")
    if tail != "\n" or not head.startswith("<|") or not template.after.startswith("<|"):
        raise ValueError("only templates with marks of the form <|...|>{role}\\n can be read back")
    pieces = F.slice(F.split(text, "\\Q" + head + "\\E"), 2, 1 << 30)

    def turn(p):
        name = F.substring_index(p, "\n", 1)
        body = F.substr(p, F.char_length(name) + 2, F.char_length(p) - F.char_length(name) - 1 - len(template.after))
        return F.struct(unescape(F.replace(name, F.lit(BREAK), F.lit("\n"))).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def digests(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """What a reader of the output finds: turns from the formatted text, trained text from the segments' flags."""
    text = formatted_text(F.col("segments"))
    x = chats.select("conv_id", "valid", text.alias("formatted"), loss_text(F.col("segments")).alias("loss"))
    x = x.select("*", read_turns(F.col("formatted"), template).alias("turns"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return x.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"),
                    F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                    F.char_length("formatted").cast("long").alias("formatted_chars"), "valid")
