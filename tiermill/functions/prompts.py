"""Prompt building as column expressions.

Templates are plain Python strings with ``{instruction}``, ``{input}`` and
``{system_prompt}`` slots.  They are split into literal pieces on the driver
once, and turned into one ``concat``; no per-row formatting, and literal
braces in the data are never interpreted.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tiermill.functions.lang import map_literal
from tiermill.functions.text import blank

_SLOT = re.compile(r"\{(instruction|input|system_prompt)\}")

# Fixed value: the response marker that makes wrapping idempotent.
RESPONSE_MARKER = "### Response:"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def render_template(template: str, **slots) -> Column:
    parts: list[Column] = []
    pos = 0
    for m in _SLOT.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        v = slots.get(m.group(1))
        if v is None:
            raise KeyError(f"template slot {m.group(1)!r} has no column")
        parts.append(F.coalesce(v if isinstance(v, Column) else F.lit(v), F.lit("")))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if parts else F.lit("")


def has_input(inp, rule: str = "strip") -> Column:
    """"strip": non-null and not only whitespace; "empty": non-null and non-empty."""
    c = _c(inp)
    if rule == "strip":
        return ~blank(c)
    if rule == "empty":
        return c.isNotNull() & (c != "")
    raise ValueError(rule)


def build_prompt(instruction, inp, with_input: str, without_input: str,
                 rule: str = "strip", system_prompt=None) -> Column:
    """Pick the with-input template when the input counts as present."""
    sp = F.lit(system_prompt) if isinstance(system_prompt, str) else (system_prompt if system_prompt is not None else F.lit(""))
    slots = dict(instruction=_c(instruction), input=_c(inp), system_prompt=sp)
    return F.when(has_input(inp, rule), render_template(with_input, **slots)).otherwise(
        render_template(without_input, **slots))


def wrap_prompt(prompt, pre: str, post: str, marker: str = RESPONSE_MARKER) -> Column:
    """Wrap only when the marker is not already present (idempotent)."""
    p = _c(prompt)
    return F.when(p.contains(marker), p).otherwise(F.concat(F.lit(pre), p, F.lit(post)))


def system_prompt_by_lang(lang, template: str, names: dict[str, str], extra_for: dict[str, str]) -> Column:
    """``template`` slots: {name}, {name_lower}, {extra}.  ``names`` maps the
    lower-cased key to a display name (unknown keys stay as given);
    ``extra_for`` adds a sentence for some keys."""
    low = F.lower(_c(lang))
    name = F.coalesce(F.try_element_at(map_literal(names), low), _c(lang))
    extra = F.coalesce(F.try_element_at(map_literal(extra_for), low), F.lit("")) if extra_for else F.lit("")
    parts: list[Column] = []
    pos = 0
    for m in re.finditer(r"\{(name|name_lower|extra)\}", template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append({"name": name, "name_lower": F.lower(name), "extra": extra}[m.group(1)])
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def render_chat(messages, turn_template: str, generation_prompt: str = "") -> Column:
    """Render ``array<struct<role, content>>`` with a per-message template
    having ``{role}`` and ``{content}`` slots; a null role or content is an
    empty one, so that no message is lost."""
    pre, rest = turn_template.split("{role}", 1)
    mid, post = rest.split("{content}", 1)
    body = F.array_join(F.transform(_c(messages), lambda m: F.concat(
        F.lit(pre), F.coalesce(m["role"], F.lit("")), F.lit(mid), F.coalesce(m["content"], F.lit("")), F.lit(post))), "")
    return F.concat(body, F.lit(generation_prompt))


# The public single-turn format of instruction models, before the system text, between the texts, and after.
INST_HEAD, INST_MID, INST_TAIL = "[INST] <<SYS>>\n", "\n<</SYS>>\n\n", " [/INST]"


def inst_chat(system, user) -> Column:
    """Llama-2 style single-turn prompt: [INST] <<SYS>> ... <</SYS>> ... [/INST]."""
    return F.concat(F.lit(INST_HEAD), _c(system), F.lit(INST_MID), _c(user), F.lit(INST_TAIL))


def tag_wrap(c, tag: str) -> Column:
    return F.concat(F.lit(f"<{tag}>\n"), _c(c), F.lit(f"\n</{tag}>"))


def sample_key(category, idx) -> Column:
    return F.concat_ws("_", _c(category), _c(idx).cast("string"))


def hardness(cb) -> Column:
    """1 - score + 0.001: strictly positive hardness."""
    return F.lit(1.0) - _c(cb) + F.lit(0.001)


def add_suffix(c, suffix: str) -> Column:
    return F.concat(_c(c), F.lit(suffix))
