"""Distinct counts and most frequent values of several columns in one aggregate.

`count(DISTINCT a), count(DISTINCT b)` copies every input row once per column
(Expand), and `mode()` holds all values of a group in one buffer. Here a group's
rows are first combined to one row per (group, values of those columns), map side
before the shuffle. Only these rows are turned into one row per column and value,
combined again to (group, column, value) with its number of rows, and counted:
a column's distinct count is its number of values, its most frequent value the one
with the highest number. The plain measures ride along on a row of their own. No
buffer grows with a group's values, and a group with most of the rows costs a row per
task and value combination.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
_FIRST = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
#: Counters that approx_top_k tracks a group.
TRACKED = 1000


def approx_most_frequent(c: Column, tracked: int = TRACKED) -> Column:
    """Most frequent value of a group from a sketch of `tracked` counters, NULL left
    out. Exact for groups of fewer distinct values, but for ties."""
    return F.element_at(F.call_function("approx_top_k", c.cast("string"), F.lit(1), F.lit(tracked)), 1)["item"]


def summarise(df: DataFrame, keys: Sequence[str], measures: Mapping[str, tuple[str, Column]],
              distinct: Mapping[str, str] | None = None, frequent: Mapping[str, str] | None = None,
              approximate: bool = False) -> DataFrame:
    """One row per `keys` (null is a key) with

    * `measures`: name -> (count | sum | min | max, column);
    * `distinct`: name -> column, its number of distinct values (NULL is none);
    * `frequent`: name -> column, its most frequent value as text. NULL counts as a
      value; ties go to NULL, then to the smallest. `approximate` takes them from a
      sketch instead (NULL and ties: see approx_most_frequent).

    Without keys there is one row, also for an empty table.
    """
    keys, distinct, frequent = list(keys), dict(distinct or {}), dict(frequent or {})
    if approximate:
        sketched = {name: approx_most_frequent(F.col(c)).alias(name) for name, c in frequent.items()}
        if not distinct:
            plain = [_FIRST[how](c).alias(name) for name, (how, c) in measures.items()]
            return df.groupBy(*keys).agg(*plain, *sketched.values())
        if frequent:
            raise ValueError("approximate values are for summaries without distinct counts")
    columns = list(dict.fromkeys([*distinct.values(), *frequent.values()]))
    if not columns:
        return df.groupBy(*keys).agg(*[_FIRST[how](c).alias(name) for name, (how, c) in measures.items()])
    names = {name: f"_m{i}" for i, name in enumerate(measures)}
    values = {c: f"_v{i}" for i, c in enumerate(columns)}
    combined = df.groupBy(*keys, *[F.col(c).alias(v) for c, v in values.items()]).agg(
        F.count(F.lit(1)).alias("_n"), *[_FIRST[how](c).alias(names[name]) for name, (how, c) in measures.items()])

    types = dict(combined.dtypes)
    none = [F.lit(None).cast(types[m]).alias(m) for m in names.values()]
    text = F.lit(None).cast("string")
    rows = [F.struct(F.lit(-1).alias("_kind"), text.alias("_value"), F.lit(0).cast("long").alias("_n"), *[F.col(m) for m in names.values()])]
    rows += [F.struct(F.lit(i).alias("_kind"), F.col(v).cast("string").alias("_value"), F.col("_n"), *none)
             for i, v in enumerate(values.values())]
    merged = [_MERGE[how](names[name]).alias(names[name]) for name, (how, _) in measures.items()]
    counted = combined.select(*keys, F.inline(F.array(*rows))).groupBy(*keys, "_kind", "_value").agg(F.sum("_n").alias("_n"), *merged)

    kind = {c: i for i, c in enumerate(columns)}
    out = [(F.coalesce(_MERGE[how](names[name]), F.lit(0)) if how == "count" else _MERGE[how](names[name])).alias(name)
           for name, (how, _) in measures.items()]
    out += [F.count_if((F.col("_kind") == kind[c]) & F.col("_value").isNotNull()).alias(name) for name, c in distinct.items()]
    # false sorts before true: NULL comes before every value, the empty string too
    place = F.struct((-F.col("_n")).alias("n"), F.col("_value").isNotNull().alias("known"), F.col("_value").alias("value"))
    out += [F.min(F.when(F.col("_kind") == kind[c], place))["value"].alias(name) for name, c in frequent.items()]
    return counted.groupBy(*keys).agg(*out)


def surplus(df: DataFrame, keys: Sequence[str], checks: Mapping[str, Sequence[Column]]) -> DataFrame:
    """Per `keys` and check (name -> columns) the number of rows beyond the first of each
    value, as name columns. Rows with a NULL in the check's columns count as
    surplus, as with COUNT(*) - COUNT(DISTINCT a || b). All checks read one shuffle:
    a row per check with its columns as a struct, and no text is built."""
    keys, names = list(keys), list(checks)
    parts = {n: list(cols) for n, cols in checks.items()}
    width = max(len(c) for c in parts.values())
    rows = []
    for i, n in enumerate(names):
        known = F.lit(True)
        for c in parts[n]:
            known = known & c.isNotNull()
        cols = [c.cast("string") for c in parts[n]] + [F.lit(None).cast("string")] * (width - len(parts[n]))
        rows.append(F.struct(F.lit(i).alias("_check"), known.alias("_known"),
                             F.when(known, F.struct(*[c.alias(f"p{j}") for j, c in enumerate(cols)])).alias("_key")))
    per = df.select(*keys, F.inline(F.array(*rows))).groupBy(*keys, "_check", "_known", "_key").agg(F.count(F.lit(1)).alias("_n"))
    over = lambda i: F.coalesce(F.sum(F.when(F.col("_check") == i, F.col("_n") - F.col("_known").cast("long"))), F.lit(0))
    return per.groupBy(*keys).agg(*[over(i).cast("long").alias(n) for i, n in enumerate(names)])
