"""Positions and tiles over a whole ordered table, or per key, in parallel.

`ROW_NUMBER() OVER (ORDER BY ...)` brings the table, and with a key every row
of that key, to one task. Here the rows are dealt by ranges of (keys, order) and
sorted within each partition; a row's place in its partition comes with the
sort. A summary of one row per partition and key gives the number of rows of the
key in earlier partitions, and place plus offset is the position. A key with most
of the rows is spread over partitions like everything else, and rows that are
equal in all of `order` are dealt by their place in the input.

The sorted rows are written to the shared folder once, so that the summary and
the positions see the same partitions, and a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.spark import ensure_checkpoint_dir

_AT, _PART, _TIE = "__at", "__part", "__tie"
_SPAN = 33                                   # monotonically_increasing_id: partition number above 33 bits of place


def with_position(df: DataFrame, order, keys=(), name: str = "position", total: str | None = None) -> DataFrame:
    """Add `name`: 1, 2, 3... in `order` (columns or sort expressions) among the
    rows of equal `keys` (null is a key), and with `total` their number. Rows that tie on
    the whole order get different positions, in no promised order."""
    keys = list(keys)
    ensure_checkpoint_dir(df.sparkSession)
    by = [*[F.col(f"`{k}`").asc_nulls_first() for k in keys], *[o if isinstance(o, Column) else F.col(o) for o in order]]
    tied = df.withColumn(_TIE, F.monotonically_increasing_id())
    sort = [*by, F.col(_TIE).asc()]
    rows = tied.repartitionByRange(*sort).sortWithinPartitions(*sort).drop(_TIE) \
        .withColumn(_AT, F.monotonically_increasing_id()).checkpoint()
    rows = rows.withColumn(_PART, F.shiftright(_AT, _SPAN))
    per = rows.groupBy(_PART, *keys).agg(F.min(_AT).alias("__first"), F.count(F.lit(1)).alias("__n"))
    # one row per partition and key: at most partitions + keys rows
    of_key = Window.partitionBy(*keys)
    earlier = of_key.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"__before": F.coalesce(F.sum("__n").over(earlier), F.lit(0)), "__total": F.sum("__n").over(of_key)})
    if not keys:
        per = F.broadcast(per)               # a row per partition
    a, b = rows.alias("a"), per.alias("b")
    same = F.col(f"a.{_PART}") == F.col(f"b.{_PART}")
    for k in keys:
        same = same & F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
    position = F.col(f"a.{_AT}") - F.col("b.__first") + F.col("b.__before") + 1
    out = [F.col(f"a.`{c}`") for c in df.columns] + [position.cast("long").alias(name)]
    return a.join(b, same).select(*out, *([F.col("b.__total").cast("long").alias(total)] if total else []))


def tile(position: Column, total: Column, tiles: int) -> Column:
    """NTILE from a row's position: the first total % tiles tiles hold one row more."""
    small, extra = F.floor(total / tiles), total % tiles
    head = extra * (small + 1)
    return F.when(position <= head, F.floor((position - 1) / (small + 1)) + 1) \
        .otherwise(extra + F.floor((position - 1 - head) / F.greatest(small, F.lit(1))) + 1).cast("long")


def with_tile(df: DataFrame, order, keys=(), tiles: int = 4, name: str = "tile") -> DataFrame:
    """Add NTILE(tiles) OVER (PARTITION BY keys ORDER BY order)."""
    x = with_position(df, order, keys, "__position", "__total")
    return x.withColumn(name, tile(F.col("__position"), F.col("__total"), tiles)).drop("__position", "__total")
