"""Mergeable sketches: distinct counts and quantiles of any period from small tables.

A day's plays are kept as one row per key with HyperLogLog sketches of their artists and
tracks, a month's sessions as one row per key with KLL sketches of their measures. A
period's figures are the union of its rows, so a year (or a history that grows by a
day) costs its days, and no play is read again. Exact counts and quantiles stay beside
them, and two queries hold the sketches against these within their stated error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore import labels as LB
from encore.operators.rollup import summarise
from encore.operators.shares import join_on_keys
from encore.plans.quality import QUANTILE_METRICS
from encore.plans.stages import Stages

#: HyperLogLog with 2^LG_K registers: a relative error of 1.04 / sqrt(2^LG_K), 1.6 %; the bound is three times that.
LG_K = 12
DISTINCT_ERROR = 3 * 1.04 / 2 ** (LG_K / 2)
#: KLL: ranks within 1.65 % of the number of values, for this size of its compactors.
KLL_K, RANK_ERROR = 200, 0.0165
SKETCHED = {"artists": "artist_name", "tracks": "track_name"}


def daily_distinct(st: Stages) -> DataFrame:
    """keys, play_date: plays and a sketch of each day's artists and tracks."""
    return st.silver.groupBy(*st.keys, "play_date").agg(
        F.count(F.lit(1)).alias("plays"), *[F.hll_sketch_agg(c, F.lit(LG_K)).alias(f"{n}_hll") for n, c in SKETCHED.items()])


def distinct_in(daily: DataFrame, by: Sequence[Column | str]) -> DataFrame:
    """Estimates for groups of days: plays (exact), approx_artists, approx_tracks."""
    return daily.groupBy(*by).agg(
        F.sum("plays").alias("plays"),
        *[F.hll_sketch_estimate(F.hll_union_agg(f"{n}_hll")).alias(f"approx_{n}") for n in SKETCHED])


def distinct_by_year(st: Stages, daily: DataFrame | None = None) -> DataFrame:
    """Exact distinct artists and tracks of each year, and whether the union of the
    year's daily sketches is within DISTINCT_ERROR of them."""
    keys = [*st.keys, "play_year"]
    daily = daily_distinct(st) if daily is None else daily
    approx = distinct_in(daily, [*st.keys, F.year("play_date").cast("long").alias("play_year")])
    exact = summarise(st.silver, keys, {}, distinct={f"unique_{n}": c for n, c in SKETCHED.items()})
    x = join_on_keys(exact, approx, keys, "full")
    near = [(F.abs(F.col(f"approx_{n}") - F.col(f"unique_{n}")) <= F.col(f"unique_{n}") * DISTINCT_ERROR).alias(f"{n}_in_bound")
            for n in SKETCHED]
    return x.select(*keys, "plays", *[f"unique_{n}" for n in SKETCHED], *near)


def monthly_measures(st: Stages) -> DataFrame:
    """keys, session_year, session_month: sessions and a sketch of each measure."""
    return st.sessions.groupBy(*st.keys, "session_year", "session_month").agg(
        F.count(F.lit(1)).alias("sessions"),
        *[F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(KLL_K)).alias(f"{n}_kll") for c, n in QUANTILE_METRICS])


def quantiles_in(monthly: DataFrame, by: Sequence[Column | str]) -> DataFrame:
    """Quantiles of groups of months: <measure>_p10 ... <measure>_p90."""
    merged = monthly.groupBy(*by).agg(*[F.kll_merge_agg_double(f"{n}_kll").alias(n) for _, n in QUANTILE_METRICS])
    names = [b if isinstance(b, str) else merged.columns[i] for i, b in enumerate(by)]
    return merged.select(*names, *[F.kll_sketch_get_quantile_double(F.col(n), F.lit(q)).alias(_name(n, q))
                                   for _, n in QUANTILE_METRICS for q in LB.QUANTILE_LEVELS])


def _name(measure: str, level: float) -> str:
    return f"{measure}_p{int(round(level * 100))}"


def quantiles_in_bound(st: Stages, monthly: DataFrame | None = None) -> DataFrame:
    """Per key, measure and level: whether the merged months' quantile has a rank within
    RANK_ERROR of the level among all sessions, and the number of values."""
    monthly = monthly_measures(st) if monthly is None else monthly
    approx = quantiles_in(monthly, st.keys)
    values = st.sessions.select(*st.keys, *[F.col(c).cast("double").alias(f"_{n}") for c, n in QUANTILE_METRICS])
    x = join_on_keys(values, approx, st.keys)
    counts = []
    for _, n in QUANTILE_METRICS:
        counts.append(F.count(f"_{n}").alias(f"_n_{n}"))
        for q in LB.QUANTILE_LEVELS:
            counts += [F.count_if(F.col(f"_{n}") < F.col(_name(n, q))).alias(f"_below_{_name(n, q)}"),
                       F.count_if(F.col(f"_{n}") <= F.col(_name(n, q))).alias(f"_upto_{_name(n, q)}")]
    g = x.groupBy(*st.keys).agg(*counts)
    rows = []
    for _, n in QUANTILE_METRICS:
        total = F.col(f"_n_{n}")
        for q in LB.QUANTILE_LEVELS:
            ok = (F.col(f"_below_{_name(n, q)}") <= total * (q + RANK_ERROR)) & (F.col(f"_upto_{_name(n, q)}") >= total * (q - RANK_ERROR))
            rows.append(F.struct(F.lit(n).alias("measure"), F.lit(int(round(q * 100))).cast("long").alias("percentile"),
                                 total.alias("values"), ok.alias("in_bound")))
    return g.select(*st.keys, F.inline(F.array(*rows)))


def session_quantiles_exact(st: Stages) -> DataFrame:
    """The same quantiles by percentile_disc, a map of each measure's values (rates of
    two decimals) to their numbers."""
    return st.sessions.groupBy(*st.keys).agg(
        *[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {c})").alias(_name(n, q))
          for c, n in QUANTILE_METRICS for q in LB.QUANTILE_LEVELS])


NAMES = ["distinct_by_year", "quantiles_in_bound", "session_quantiles_exact"]
