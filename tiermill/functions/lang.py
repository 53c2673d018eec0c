"""Language / direction parsing as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tiermill.functions.text import WS, py_strip

# Language spellings -> scorer keys.
LANG_ALIASES = {
    "c++": "cpp", "cpp": "cpp",
    "python": "python",
    "java": "java",
    "c#": "c_sharp", "csharp": "c_sharp",
    "go": "go", "php": "php", "javascript": "javascript",
}
# Language keys -> display names for system prompts.
LANG_NAMES = {"cpp": "C++", "c++": "C++", "java": "Java", "python": "Python", "go": "Go"}

# Fixed value: "from X to Y", where Y ends at whitespace, '.' or end.  (?d) makes '.' stop only at
# '\n', as in Python.
DIRECTION = r"(?d)from" + WS + r"+(.*?)" + WS + r"+to" + WS + r"+(.*?)(?:" + WS + r"|\z|\.)"

# Ordered detection rules (fence tags in ground truth first, then
# " to <lang>" in the lower-cased instruction); default cpp.
GT_FENCE_RULES = [(("```cpp", "```c++"), "cpp"), (("```python",), "python"), (("```java",), "java")]
INSTRUCTION_RULES = [((" to cpp", " to c++"), "cpp"), ((" to java",), "java"), ((" to python",), "python")]
DEFAULT_LANG = "cpp"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def map_literal(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def alias(c, mapping: dict[str, str] = LANG_ALIASES) -> Column:
    """``mapping.get(x, x)``."""
    c = _c(c)
    return F.coalesce(F.try_element_at(map_literal(mapping), c), c)


def parse_direction(c, aliases: dict[str, str] = LANG_ALIASES) -> Column:
    """struct(category, lang) from "from X to Y"; ("unknown", "python") when absent."""
    low = F.lower(_c(c))
    src = alias(py_strip(F.regexp_extract(low, DIRECTION, 1)), aliases)
    tgt = alias(F.regexp_replace(py_strip(F.regexp_extract(low, DIRECTION, 2)), r"\.+\z", ""), aliases)
    hit = low.rlike(DIRECTION)
    return F.struct(
        F.when(hit, F.concat(src, F.lit("2"), tgt)).otherwise(F.lit("unknown")).alias("category"),
        F.when(hit, tgt).otherwise(F.lit("python")).alias("lang"),
    )


def pair_target(c) -> Column:
    """Second piece of "src-tgt"; null when there is no '-'."""
    return F.nullif(F.split_part(_c(c), F.lit("-"), F.lit(2)), F.lit(""))


def detect_language(instruction, gt_code, gt_rules=GT_FENCE_RULES,
                    instr_rules=INSTRUCTION_RULES, default: str = DEFAULT_LANG) -> Column:
    gt = F.coalesce(_c(gt_code), F.lit(""))
    low = F.lower(F.coalesce(_c(instruction), F.lit("")))
    out = F.lit(default)
    rules = [(gt, pats, lang) for pats, lang in gt_rules] + [(low, pats, lang) for pats, lang in instr_rules]
    for col, pats, lang in reversed(rules):
        cond = None
        for p in pats:
            cond = col.contains(p) if cond is None else (cond | col.contains(p))
        out = F.when(cond, F.lit(lang)).otherwise(out)
    return out
