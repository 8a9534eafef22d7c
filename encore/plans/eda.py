"""Profiling queries on the raw plays table (per account).

Raw times are UTC; profiling shows them on a fixed-offset clock
(cfg.eda_offset_hours), while "days of data" counts UTC dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore import labels as LB
from encore.functions import rounding as R
from encore.functions import timeutil as TU
from encore.functions.aggregates import count_all, count_true
from encore.operators.carry import lag_carry
from encore.operators.rollup import summarise, surplus
from encore.operators.shares import top_n, with_share
from encore.plans.profile import distribution
from encore.plans.stages import Stages
from encore.schemas import EXPORT_FIELDS

def _ms() -> Column:
    return F.col("ms_played")


def _track() -> Column:
    return F.col("master_metadata_track_name")


def _artist() -> Column:
    return F.col("master_metadata_album_artist_name")


def _clock(st: Stages) -> Column:
    return TU.eda_clock(F.col("ts"), st.cfg)


def _avg_minutes(digits: int = 2) -> Column:
    """ROUND(AVG(ms_played) / 60000, digits)."""
    return R.rround(F.sum(_ms()), F.count(_ms()) * 60000, digits)


def _hours(digits: int = 1) -> Column:
    """ROUND(SUM(ms_played) / 60000 / 60, digits)."""
    return R.rround(F.sum(_ms()), 3600000, digits)


def _unpivot(df: DataFrame, keys, label_col: str, value_col: str, pairs) -> DataFrame:
    """Turn one row of named counts into one row per (label, count)."""
    rows = F.array(*[F.struct(F.lit(lbl).alias(label_col), c.alias(value_col)) for lbl, c in pairs])
    return df.select(*keys, F.inline(rows))


def _share_by(st: Stages, df: DataFrame, group: list[Column], count_name: str = "plays",
              extra: list[Column] | None = None) -> DataFrame:
    g = df.groupBy(*st.keys, *group).agg(count_all().alias(count_name), *(extra or []))
    return with_share(g, st.keys, count_name)


def _from_dist(st: Stages, name: str, cols: list[str], share: bool = True, extra=()) -> DataFrame:
    """A distribution from the one-pass profile (or a focused aggregate), with
    its share of the key's total and duration figures from sum / count of ms."""
    d = distribution(st, name)
    if share:
        d = with_share(d, st.keys, "plays")
    out = [*st.keys, *cols, "plays"] + (["pct_of_total"] if share else [])
    return d.select(*out, *[e(F.col("_sum_ms"), F.col("_n_ms")) for e in extra])


def _minutes0_of(s: Column, n: Column) -> Column:
    return R.rround(s, 60000, 0).alias("total_minutes")


def _avg_minutes_of(s: Column, n: Column) -> Column:
    return R.rround(s, n * 60000, 2).alias("avg_minutes_per_play")


def _hours1_of(s: Column, n: Column) -> Column:
    return R.rround(s, 3600000, 1).alias("total_hours")


def eda_overview(st: Stages) -> DataFrame:
    ts = F.col("ts")
    days = F.datediff(F.to_date(F.max(ts)), F.to_date(F.min(ts)))
    return st.raw.groupBy(*st.keys).agg(
        count_all().alias("total_records"),
        TU.eda_clock(F.min(ts), st.cfg).alias("earliest_play"),
        TU.eda_clock(F.max(ts), st.cfg).alias("latest_play"),
        days.cast("long").alias("days_of_data"),
        R.rround(count_all(), days, 1).alias("avg_plays_per_day"))


def eda_null_profile(st: Stages) -> DataFrame:
    nulls = [F.count_if(F.col(n).isNull()).alias(f"null_{n}") for n, _ in EXPORT_FIELDS]
    return st.raw.groupBy(*st.keys).agg(
        *nulls,
        R.pct(F.count_if(_track().isNull()), count_all()).alias("pct_null_track_name"),
        R.pct(F.count_if(F.col("episode_name").isNull()), count_all()).alias("pct_null_episode_name"))


def eda_content_type(st: Stages) -> DataFrame:
    return _from_dist(st, "content_type", ["content_type"], extra=[_minutes0_of, _avg_minutes_of])


def eda_duplicates(st: Stages) -> DataFrame:
    """COUNT(*) - COUNT(DISTINCT ...) of two keys, from one row per key value and
    its number of plays; a play with a NULL in the key counts as surplus."""
    ts = F.col("ts")
    g = surplus(st.raw, st.keys, {"_a": [ts, _track(), _ms()], "_b": [ts, F.col("spotify_track_uri")]})
    a, b = LB.DUPLICATE_LABELS
    return _unpivot(g, st.keys, "check_type", "duplicate_count", [(a, F.col("_a")), (b, F.col("_b"))])


def eda_by_month(st: Stages) -> DataFrame:
    c = _clock(st)
    days = st.raw.select(*st.keys, TU.year(c).alias("year"), TU.month(c).alias("month"), F.to_date(c).alias("_day"),
                         F.to_date("ts").alias("_utc_day"), "ms_played")
    g = summarise(days, [*st.keys, "year", "month"], {"plays": ("count", F.lit(1)), "_ms": ("sum", _ms())},
                  distinct={"active_days": "_day", "_utc": "_utc_day"})
    return g.select(*st.keys, "year", "month", "plays", "active_days",
                    R.rround(F.col("plays"), F.col("_utc"), 1).alias("avg_plays_per_day"),
                    R.rround(F.col("_ms"), 3600000, 1).alias("total_hours"))


def eda_by_weekday(st: Stages) -> DataFrame:
    return _from_dist(st, "weekday", ["day_of_week", "day_num"], share=False, extra=[_avg_minutes_of])


def eda_by_hour(st: Stages) -> DataFrame:
    return _from_dist(st, "hour", ["hour"], extra=[_minutes0_of])


def eda_heatmap(st: Stages) -> DataFrame:
    return _from_dist(st, "heatmap", ["day_num", "hour"], share=False)


def eda_top_artists(st: Stages, n: int = 20) -> DataFrame:
    g = st.raw.filter(_artist().isNotNull()).groupBy(*st.keys, _artist().alias("artist")).agg(
        count_all().alias("plays"),
        F.countDistinct(_track()).alias("unique_tracks"),
        _hours(1).alias("total_hours"),
        _avg_minutes().alias("avg_minutes_per_play"),
        R.pct(count_true(F.col("skipped")), count_all(), 1).alias("skip_rate_pct"))
    return top_n(g, st.keys, [F.desc("plays"), F.asc("artist")], n)


def eda_top_tracks(st: Stages, n: int = 20) -> DataFrame:
    ts = F.col("ts")
    g = st.raw.filter(_track().isNotNull()).groupBy(*st.keys, _track().alias("track"), _artist().alias("artist")).agg(
        count_all().alias("plays"),
        _avg_minutes().alias("avg_minutes_per_play"),
        TU.eda_clock(F.min(ts), st.cfg).alias("first_played"),
        TU.eda_clock(F.max(ts), st.cfg).alias("last_played"),
        F.datediff(F.to_date(F.max(ts)), F.to_date(F.min(ts))).cast("long").alias("days_span"))
    return top_n(g, st.keys, [F.desc("plays"), F.asc("track"), F.asc_nulls_first("artist")], n)


def eda_artist_discovery(st: Stages, n: int = 20) -> DataFrame:
    d = F.to_date(_clock(st))
    g = st.raw.filter(_artist().isNotNull()).groupBy(*st.keys, _artist().alias("artist")).agg(
        F.min(d).alias("first_discovered"), count_all().alias("total_plays"),
        F.countDistinct(d).alias("days_played"))
    return top_n(g, st.keys, [F.asc("first_discovered"), F.asc("artist")], n)


def eda_platform(st: Stages) -> DataFrame:
    return _from_dist(st, "platform", ["platform"], extra=[_hours1_of, _avg_minutes_of])


def eda_platform_daypart(st: Stages) -> DataFrame:
    return _from_dist(st, "platform_daypart", ["platform", "time_of_day"], share=False)


def eda_country(st: Stages) -> DataFrame:
    return _from_dist(st, "country", ["country"])


def eda_duration_buckets(st: Stages) -> DataFrame:
    return _from_dist(st, "duration_bucket", ["duration_bucket"])


def _flag_share(st: Stages, col: str, extra=None) -> DataFrame:
    return _share_by(st, st.raw.filter(F.col(col).isNotNull()), [F.col(col)], extra=extra)


def eda_skip(st: Stages) -> DataFrame:
    return _from_dist(st, "skipped", ["skipped"], extra=[_avg_minutes_of])


def eda_shuffle(st: Stages) -> DataFrame:
    return _flag_share(st, "shuffle", [F.countDistinct(_artist()).alias("unique_artists")])


def eda_offline(st: Stages) -> DataFrame:
    return _from_dist(st, "offline", ["offline"])


def eda_incognito(st: Stages) -> DataFrame:
    return _from_dist(st, "incognito_mode", ["incognito_mode"])


def eda_reason_start(st: Stages) -> DataFrame:
    return _from_dist(st, "reason_start", ["reason_start"])


def eda_reason_end(st: Stages) -> DataFrame:
    return _from_dist(st, "reason_end", ["reason_end"])


def eda_binge_days(st: Stages, n: int = 20) -> DataFrame:
    g = st.raw.groupBy(*st.keys, F.to_date(_clock(st)).alias("date")).agg(
        count_all().alias("plays"), _hours(2).alias("hours_listened"),
        F.countDistinct(_artist()).alias("unique_artists"))
    return top_n(g, st.keys, [F.desc("hours_listened"), F.asc("date")], n)


def eda_loyalty(st: Stages, n: int = 30) -> DataFrame:
    g = st.raw.filter(_artist().isNotNull()).groupBy(*st.keys, _artist().alias("artist")).agg(
        count_all().alias("total_plays"), F.countDistinct(_track()).alias("unique_tracks"))
    g = g.filter(F.col("total_plays") >= LB.LOYALTY_MIN_PLAYS)
    p, u = F.col("total_plays"), F.col("unique_tracks")
    hi, med, var = LB.LOYALTY_LABELS
    pattern = (F.when((u > 0) & (p > u * LB.LOYALTY_HIGH), hi)
               .when((u > 0) & (p > u * LB.LOYALTY_MEDIUM), med).otherwise(var))
    g = g.select(*st.keys, "artist", "total_plays", "unique_tracks",
                 R.rround(p, u, 2).alias("loyalty_score"), pattern.alias("listening_pattern"))
    return top_n(g, st.keys, [F.desc_nulls_last("loyalty_score"), F.asc("artist")], n)


def eda_gap_buckets(st: Stages) -> DataFrame:
    x = lag_carry(st.raw.select(*st.keys, "ts"), st.keys, ["ts"], ["ts"], st.cfg)
    m = TU.minutes_between(F.col("prev_ts"), F.col("ts"))
    b = F.when(m.isNull(), LB.GAP_FIRST)
    for lim, lbl in zip(LB.GAP_LIMITS_MIN, LB.GAP_LABELS):
        b = b.when(m <= lim, lbl)
    b = b.otherwise(LB.GAP_LABELS[-1])
    return _share_by(st, x, [b.alias("gap_bucket")], count_name="occurrences")


def eda_completion(st: Stages) -> DataFrame:
    return _from_dist(st, "completion_category", ["completion_category"])


def eda_impossible_values(st: Stages) -> DataFrame:
    ts = F.col("ts")
    g = st.raw.groupBy(*st.keys).agg(
        F.count_if(_ms() < 0).alias("_neg"),
        F.count_if((_ms() > LB.IMPOSSIBLE_MAX_MS) & _track().isNotNull()).alias("_long"),
        F.count_if(ts > TU.now_utc()).alias("_future"),
        F.count_if(ts < F.lit(LB.IMPOSSIBLE_OLDEST).cast("timestamp_ntz")).alias("_old"))
    labels = LB.IMPOSSIBLE_LABELS
    return _unpivot(g, st.keys, "issue", "count",
                    list(zip(labels, [F.col("_neg"), F.col("_long"), F.col("_future"), F.col("_old")])))


def eda_missing_critical(st: Stages) -> DataFrame:
    return st.raw.groupBy(*st.keys).agg(
        F.lit(LB.MISSING_CRITICAL_LABEL).alias("issue"),
        F.count_if(_track().isNull() & F.col("episode_name").isNull()).alias("count"))


NAMES = ["eda_overview", "eda_null_profile", "eda_content_type", "eda_duplicates", "eda_by_month",
         "eda_by_weekday", "eda_by_hour", "eda_heatmap", "eda_top_artists", "eda_top_tracks",
         "eda_artist_discovery", "eda_platform", "eda_platform_daypart", "eda_country",
         "eda_duration_buckets", "eda_skip", "eda_shuffle", "eda_offline", "eda_incognito",
         "eda_reason_start", "eda_reason_end", "eda_binge_days", "eda_loyalty", "eda_gap_buckets",
         "eda_completion", "eda_impossible_values", "eda_missing_critical"]
