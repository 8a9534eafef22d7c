"""Share-of-total and top-N helpers (the two most repeated query shapes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.functions import rounding as R


def total_window(keys) -> Window:
    keys = list(keys)
    return Window.partitionBy(*keys) if keys else Window.partitionBy()


def with_share(agg: DataFrame, keys, count_col: str, pct_col: str = "pct_of_total",
               digits: int = 2) -> DataFrame:
    """Add ROUND(count * 100 / SUM(count) OVER (PARTITION BY keys), digits).

    Runs on the aggregated rows (one per group), so the window moves only
    group counts, never plays.
    """
    total = F.sum(count_col).over(total_window(keys))
    return agg.withColumn(pct_col, R.pct(F.col(count_col), total, digits))


def top_n(df: DataFrame, keys, order: list[Column], n: int, rank_col: str | None = None,
          method: str = "row_number") -> DataFrame:
    """Keep the first n rows per keys by `order` (QUALIFY rank <= n).

    Written as filter-over-window so Spark plans WindowGroupLimit (partial
    top-n before the shuffle) or TakeOrderedAndProject for no keys.
    """
    keys = list(keys)
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(*order)
    fn = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}[method]
    name = rank_col or "_rank"
    out = df.withColumn(name, fn().over(w).cast("long")).filter(F.col(name) <= n)
    return out if rank_col else out.drop(name)


def join_on_keys(a: DataFrame, b: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join two per-key summaries. With no keys both sides are one-row
    aggregates and are joined on a constant key."""
    keys = list(keys)
    if keys:
        same = F.lit(True)
        for k in keys:                       # a NULL key is a key
            same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        key = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys]
        rest = [F.col(f"{side}.{c}") for side, df in (("a", a), ("b", b)) for c in df.columns if c not in keys]
        return a.alias("a").join(b.alias("b"), same, how).select(*key, *rest)
    return (a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), on="_one", how=how)
            .drop("_one"))
