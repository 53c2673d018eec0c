"""Running values over long keys, by blocks.

A window over a key puts all rows of the key into one task.  Here the rows are cut into blocks; a window over (key, block)
gives the running values inside a block, a carry table with one row per block holds what a block does to the value (its sum,
the lowest point of its running sum, its maximum), a window over the carry table composes these, and a join on (key,
block) brings each block what came before it.  So one huge document is spread over many tasks, and what meets in one task
is a row per block.  The composition is associative, so that any cut into blocks gives the same values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 16_384


def plain_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``df`` and the columns to partition by for ``keys``: a key that may be null becomes two columns that are not (value, is it
    null), because a null-safe join would compute those itself and shuffle the rows again for them."""
    names, new = [], {}
    for i, k in enumerate(keys):
        field = df.schema[k]
        if not field.nullable:
            names.append(k)
            continue
        names += [f"_key{i}", f"_null{i}"]
        if f"_key{i}" not in df.columns:
            simple = isinstance(field.dataType, (T.NumericType, T.StringType))
            empty = F.lit("") if isinstance(field.dataType, T.StringType) else F.lit(0).cast(field.dataType) if simple else None
            new[f"_key{i}"] = F.coalesce(F.col(k), empty) if simple else F.struct(k)
            new[f"_null{i}"] = F.col(k).isNull()
    return (df.withColumns(new) if new else df), names


def cut_array(df: DataFrame, keys: Sequence[str], values: Column, size: int = BLOCK, block: str = "_blk", carry: Sequence[str] = (),
              sums: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """``keys, carry, block, pos, value``: the elements of an array column, dealt out by keys and blocks of ``size``.  The blocks
    leave the row before the shuffle, so that they are what is shuffled, not single elements; a null or empty array gives none.

    ``sums``: name -> what an element adds; the column ``name`` is then the sum over all elements of the row up to this one.  What
    comes before a block is summed up in the row that the blocks leave, a number per block, so that it needs neither a carry
    table nor a join; the rest is a window inside the block."""
    sums = sums or {}
    a = F.col("_a")
    last = F.floor((F.greatest(F.size(a), F.lit(1)) - 1) / F.lit(size)).cast("int")
    part = lambda b: F.slice(a, b * size + 1, F.lit(size))
    total = lambda v, f: F.aggregate(v, F.lit(0).cast("bigint"), lambda s, x: s + f(x).cast("bigint"))
    parts = F.transform(F.sequence(F.lit(0), last), lambda b: F.struct(
        b.alias("b"), part(b).alias("v"), *[total(part(b), f).alias(f"t{i}") for i, f in enumerate(sums.values())]))
    x = df.select(*keys, *carry, values.alias("_a")).where(F.size("_a") > 0).select(*keys, *carry, parts.alias("_parts"))
    before = lambda i, n: F.aggregate(F.slice("_parts", F.lit(1), n), F.lit(0).cast("bigint"), lambda s, p: s + p[f"t{i}"])
    based = F.transform("_parts", lambda p, n: F.struct(p["b"].alias("b"), p["v"].alias("v"), *[before(i, n).alias(f"o{i}") for i in range(len(sums))]))
    x = x.select(*keys, *carry, F.explode(based).alias("_p")).select(
        *keys, *carry, F.col("_p.b").alias(block), F.col("_p.v").alias("_v"), *[F.col(f"_p.o{i}").alias(f"_o{i}") for i in range(len(sums))])
    x, names = plain_keys(x, keys)
    rest = [c for c in x.columns if c != "_v"]
    x = x.repartition(*names, block).select(*rest, F.posexplode("_v").alias("_i", "value"))
    here = Window.partitionBy(*names, block).orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumns({n: F.col(f"_o{i}") + F.sum(f(F.col("value")).cast("bigint")).over(here) for i, (n, f) in enumerate(sums.items())})
    return x.select(*keys, *carry, block, (F.col(block).cast("bigint") * size + F.col("_i")).alias("pos"), "value", *sums)


def running(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], sums: dict[str, Column] | None = None,
            lows: dict[str, str] | None = None, tops: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with running values over ``keys`` in ``order``, each row included:

    * ``sums``: name -> sum of the column so far;
    * ``lows``: name -> smallest value that the running sum of that name has had (0 before the first row);
    * ``tops``: name -> largest value so far.

    ``order`` must sort the blocks of a key like ``block`` does, and ``block`` is never null.  The rows are shuffled once, by keys and
    block."""
    sums, lows, tops = sums or {}, lows or {}, tops or {}
    df, names = plain_keys(df, keys)
    here = Window.partitionBy(*names, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = df.withColumns({f"_v_{n}": c for n, c in (sums | tops).items()})
    x = x.withColumns({f"_s_{n}": F.sum(f"_v_{n}").over(here) for n in sums} | {f"_t_{n}": F.max(f"_v_{n}").over(here) for n in tops})
    if lows:
        x = x.withColumns({f"_l_{n}": F.min(f"_s_{s}").over(here) for n, s in lows.items()})
    carry = x.groupBy(*names, block).agg(
        *[F.sum(f"_v_{n}").alias(f"_c_{n}") for n in sums], *[F.min(f"_s_{s}").alias(f"_m_{n}") for n, s in lows.items()],
        *[F.max(f"_v_{n}").alias(f"_x_{n}") for n in tops])
    before = Window.partitionBy(*names).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.withColumns({f"_b_{n}": F.coalesce(F.sum(f"_c_{n}").over(before), F.lit(0)) for n in sums}
                              | {f"_y_{n}": F.max(f"_x_{n}").over(before) for n in tops})
    if lows:
        carry = carry.withColumns({f"_z_{n}": F.least(F.lit(0), F.min(F.col(f"_m_{n}") + F.col(f"_b_{s}")).over(before)) for n, s in lows.items()})
    brought = [f"_b_{n}" for n in sums] + [f"_y_{n}" for n in tops] + [f"_z_{n}" for n in lows]
    x = x.join(carry.select(*names, block, *brought), [*names, block])
    x = x.withColumns({n: F.col(f"_b_{n}") + F.col(f"_s_{n}") for n in sums} | {n: F.greatest(f"_y_{n}", f"_t_{n}") for n in tops}
                      | {n: F.least(F.col(f"_z_{n}"), F.col(f"_l_{n}") + F.col(f"_b_{s}")) for n, s in lows.items()})
    own = [c for c in df.columns if c not in names or c in keys]
    return x.select(*own, *sums, *lows, *tops)
