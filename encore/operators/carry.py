"""Previous-row values and running sums over a long timeline, in parallel.

A window `LAG(x) OVER (PARTITION BY account ORDER BY t)` puts a whole account
in one task, and with no PARTITION BY the whole table. Here each timeline is
cut into buckets (account, day of t). Within a bucket the window runs as
usual; the first row of a bucket takes its previous value from the last row
of the nearest earlier non-empty bucket, found on a per-bucket summary (one
row per account-day, a tiny fraction of the plays). Running sums get a
per-bucket offset the same way. The result equals the single global window
row for row, while no task holds more than one account-day.

The plays are hash-partitioned and sorted once on (keys, bucket), through key
columns that are never NULL (a sentinel, and a flag beside it), so that the window,
the summary and the join back share one partitioning: the summary is the last row
of each bucket, read from the plays' own shuffle, and the join with it moves
only the summary. Whether that is broadcast is left to AQE, which converts the
join only when the measured size is under its threshold. Rows without an account
or a time keep their place: they come first, like NULLs in a window's order.

The summary is carried by one window per key: a row per day, hour or minute that
has plays. Without a key, hours and minutes are carried in two levels (bucket, era), so
that no task holds more than one era's buckets, or one row per era. The unit is one
fixed parameter: "day" suits play histories, "hour" or "minute" timelines with
extreme volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encore.config import PipelineConfig
from encore.functions import timeutil as TU

BUCKET = "_bucket"
LEAST_HASH = -(1 << 31)
FIRST_DAY = "0001-01-01"                     # bucket of rows without a time: before all others


def bucket_of(t: Column, cfg: PipelineConfig) -> Column:
    """The unit bounds the largest task: one key's plays within one bucket.
    "day" suits play histories; "hour" / "minute" for keys with extreme volume."""
    if cfg.carry_bucket in ("hour", "minute"):
        return TU.trunc_ntz(t, cfg.carry_bucket)
    if cfg.carry_bucket == "day":
        return F.to_date(t)
    raise ValueError(f"unknown carry_bucket {cfg.carry_bucket!r}")


def with_bucket(df: DataFrame, keys, t: str, cfg: PipelineConfig) -> tuple[DataFrame, list[str]]:
    """Add the carry bucket of column `t` (one fixed unit for all rows) and the keys
    as columns without NULL; returns their names too."""
    on, cols = [], {}
    for i, k in enumerate(keys):
        kind = df.schema[k].dataType
        whole = isinstance(kind, T.NumericType)
        cols[f"_k{i}"] = F.coalesce(F.col(k) if whole else F.col(k).cast("string"), F.lit(0).cast(kind) if whole else F.lit(""))
        on.append(f"_k{i}")
        if df.schema[k].nullable:
            cols[f"_null{i}"] = F.col(k).isNull()
            on.append(f"_null{i}")
    bucket = bucket_of(F.col(t), cfg)
    first = F.lit(FIRST_DAY).cast("date" if cfg.carry_bucket == "day" else "timestamp_ntz")
    return df.withColumns({**cols, BUCKET: F.coalesce(bucket, first)}), on


def _eras(on, cfg: PipelineConfig) -> Column | None:
    """The unit above the buckets, where many of them would meet in one task."""
    unit = None if on else {"hour": "month", "minute": "day"}.get(cfg.carry_bucket)
    return F.date_trunc(unit, F.col(BUCKET).cast("timestamp")).cast("string") if unit else None


def _summary(x: DataFrame, w, on, cols: dict[str, Column]) -> DataFrame:
    """One row per bucket: `cols` on its last row. A hash of all columns of these rows
    (any will do) keeps this branch from being pruned below the exchange, so that Spark
    shuffles the plays once and reads that shuffle for both branches (ReusedExchange)."""
    every = [c for c in x.columns if not c.startswith("_")]
    return (x.withColumn("_next", F.lead(F.lit(1)).over(w)).filter(F.col("_next").isNull())
            .filter(F.hash(*every) >= LEAST_HASH).select(*on, BUCKET, *[c.alias(n) for n, c in cols.items()]))


def _last_before(s: DataFrame, on, cols, cfg: PipelineConfig, prefix: str) -> DataFrame:
    """For each bucket row, prefix+c = last non-NULL c of the earlier buckets of the key."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    era = _eras(on, cfg)
    if era is None:
        w = before(Window.partitionBy(*on).orderBy(BUCKET))
        return s.withColumns({prefix + c: F.last(c, ignorenulls=True).over(w) for c in cols})
    s = s.withColumn("_era", era)
    inside = before(Window.partitionBy(*on, "_era").orderBy(BUCKET))
    over_eras = before(Window.partitionBy(*on).orderBy("_era"))
    eras = s.groupBy(*on, "_era").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(BUCKET))).alias(f"_e_{c}") for c in cols])
    eras = eras.select(*on, "_era", *[F.last(f"_e_{c}", ignorenulls=True).over(over_eras).alias(f"_b_{c}") for c in cols])
    x = s.withColumns({f"_i_{c}": F.last(c, ignorenulls=True).over(inside) for c in cols}).join(eras, "_era")
    return x.withColumns({prefix + c: F.coalesce(f"_i_{c}", f"_b_{c}") for c in cols}) \
        .drop("_era", *[f"_i_{c}" for c in cols], *[f"_b_{c}" for c in cols])


def _sum_before(s: DataFrame, on, col: str, cfg: PipelineConfig, name: str) -> DataFrame:
    """For each bucket row, the sum of `col` over the key's earlier buckets."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, w: F.coalesce(F.sum(c).over(before(w)), F.lit(0))
    era = _eras(on, cfg)
    if era is None:
        return s.withColumn(name, total(col, Window.partitionBy(*on).orderBy(BUCKET)))
    s = s.withColumn("_era", era)
    eras = s.groupBy(*on, "_era").agg(F.sum(col).alias("_e"))
    eras = eras.select(*on, "_era", total("_e", Window.partitionBy(*on).orderBy("_era")).alias("_b"))
    return (s.withColumn("_i", total(col, Window.partitionBy(*on, "_era").orderBy(BUCKET))).join(eras, "_era")
            .withColumn(name, F.col("_i") + F.col("_b")).drop("_era", "_i", "_b"))


def _join_buckets(x: DataFrame, s: DataFrame, on) -> DataFrame:
    """`x` with the other columns of their bucket's summary, and without the keys' copies."""
    return x.join(s, [*on, BUCKET]).drop(*on, BUCKET)


def _order_struct(order) -> Column:
    return F.struct(*[F.col(c) for c in order])


def lag_carry(df: DataFrame, keys, order, cols, cfg: PipelineConfig,
              prefix: str = "prev_") -> DataFrame:
    """Add prefix+c = LAG(c) OVER (PARTITION BY keys ORDER BY order) for c in cols.

    `order[0]` must be a timestamp (it defines the bucket). Rows that tie on
    the whole order key must agree on `cols`, else LAG itself is ambiguous.
    """
    order, cols = list(order), list(cols)
    x, on = with_bucket(df, keys, order[0], cfg)
    w = Window.partitionBy(*on, BUCKET).orderBy(*order)
    x = x.withColumns({"_rn": F.row_number().over(w), **{f"_in_{c}": F.lag(c).over(w) for c in cols}})
    s = _last_before(_summary(x, w, on, {"_last": F.struct(*cols)}), on, ["_last"], cfg, "_carry")
    out = _join_buckets(x, s.select(*on, BUCKET, "_carry_last"), on)
    for c in cols:
        out = out.withColumn(prefix + c, F.when(F.col("_rn") == 1, F.col(f"_carry_last.{c}")).otherwise(F.col(f"_in_{c}")))
    return out.drop("_rn", "_carry_last", *[f"_in_{c}" for c in cols])


def gap_flag(gap: Column, cfg: PipelineConfig) -> Column:
    """1 = new session: first play, gap over the limit, or a severe overlap."""
    return (F.when(gap.isNull(), 1).when(gap > cfg.gap_seconds, 1)
            .when(gap < -cfg.overlap_seconds, 1).otherwise(0))


def sessionize(plays: DataFrame, cfg: PipelineConfig, order) -> DataFrame:
    """Add seconds_since_last_play, new_session_flag and session_id.

    gap = start - previous row's end (not a running max of ends);
    session_id = running sum of flags, from 1 per key.
    """
    order = list(order)
    start, end = F.col(order[0]), F.col(order[1])
    x, on = with_bucket(plays, cfg.keys, order[0], cfg)
    w = Window.partitionBy(*on, BUCKET).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"_rn": F.row_number().over(w), "_first": F.first(start).over(so_far),
                       "_gap_in": TU.seconds_between(F.lag(end).over(w), start)})
    x = x.withColumn("_flag_in", F.when(F.col("_rn") == 1, 0).otherwise(gap_flag(F.col("_gap_in"), cfg)))
    x = x.withColumn("_run_in", F.sum("_flag_in").over(so_far))

    # the end as a struct, so that the carry takes the last row's end even where it is NULL
    s = _summary(x, w, on, {"_first_start": F.col("_first"), "_last": F.struct(end.alias("end")), "_inner": F.col("_run_in")})
    s = _last_before(s, on, ["_last"], cfg, "_prev")
    s = s.withColumn("_gap0", TU.seconds_between(F.col("_prev_last.end"), F.col("_first_start")))
    s = s.withColumn("_flag0", gap_flag(F.col("_gap0"), cfg)).withColumn("_here", F.col("_flag0") + F.col("_inner"))
    s = _sum_before(s, on, "_here", cfg, "_offset").select(*on, BUCKET, "_gap0", "_flag0", "_offset")

    first = F.col("_rn") == 1
    return (_join_buckets(x, s, on)
            .withColumn("seconds_since_last_play", F.when(first, F.col("_gap0")).otherwise(F.col("_gap_in")))
            .withColumn("new_session_flag", F.when(first, F.col("_flag0")).otherwise(F.col("_flag_in")))
            .withColumn("session_id", (F.col("_offset") + F.col("_flag0") + F.col("_run_in")).cast("long"))
            .drop("_rn", "_first", "_gap_in", "_flag_in", "_run_in", "_gap0", "_flag0", "_offset"))


def sessionize_window(plays: DataFrame, cfg: PipelineConfig, order) -> DataFrame:
    """Same result with one plain window per key (the textbook form). Kept as
    the reference the carry is tested against; one task per key."""
    keys, order = list(cfg.keys), list(order)
    w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    x = plays.withColumn("seconds_since_last_play",
                         TU.seconds_between(F.lag(order[1]).over(w), F.col(order[0])))
    x = x.withColumn("new_session_flag", gap_flag(F.col("seconds_since_last_play"), cfg))
    return x.withColumn("session_id", F.sum("new_session_flag").over(
        w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def lag_carry_where(df: DataFrame, keys, order, cols, conds: dict, cfg: PipelineConfig) -> DataFrame:
    """For each (name, condition): add struct `prev_<name>` holding `cols` of
    the last earlier row (in `order`, within keys) on which the condition
    holds - LAG over the qualifying rows only - for all conditions in one
    pass (one shuffle, one sort), with the same per-bucket carry as
    `lag_carry`."""
    order = list(order)
    val = F.struct(*[F.col(c) for c in cols])
    x, on = with_bucket(df, keys, order[0], cfg)
    w = Window.partitionBy(*on, BUCKET).orderBy(*order)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumns({f"_in_{name}": F.last(F.when(cond, val), ignorenulls=True).over(earlier) for name, cond in conds.items()})
    s = _summary(x, w, on, {f"_last_{name}": F.coalesce(F.when(cond, val), F.col(f"_in_{name}")) for name, cond in conds.items()})
    s = _last_before(s, on, [f"_last_{name}" for name in conds], cfg, "_carry")
    j = _join_buckets(x, s.select(*on, BUCKET, *[f"_carry_last_{name}" for name in conds]), on)
    return j.withColumns({f"prev_{name}": F.coalesce(f"_in_{name}", f"_carry_last_{name}") for name in conds}) \
        .drop(*[f"_in_{n}" for n in conds], *[f"_carry_last_{n}" for n in conds])
