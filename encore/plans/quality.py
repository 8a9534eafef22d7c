"""Data-quality checks of the silver and session tables, and the diagnostics
used to choose the session thresholds. All are per key (account)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore import labels as LB
from encore.functions import rounding as R
from encore.functions import timeutil as TU
from encore.functions.aggregates import count_all
from encore.operators.carry import lag_carry, lag_carry_where
from encore.operators.rollup import surplus
from encore.operators.shares import join_on_keys, top_n, with_share
from encore.operators.silver import silver
from encore.plans.stages import Stages
from encore.schemas import PLAY_ORDER


# ------------------------------------------------------------------ silver
def dq_silver_duplicates(st: Stages) -> DataFrame:
    g = surplus(st.silver, st.keys, {"remaining_duplicates": [F.col("play_end_MST"), F.col("track_uri"), F.col("ms_played")]})
    return g.select(*st.keys, F.lit(LB.CHECK_DUPLICATES).alias("check_type"), "remaining_duplicates")


def dq_silver_podcast_leak(st: Stages) -> DataFrame:
    leak = F.col("track_name").isNull() | F.col("track_uri").isNull()
    return st.silver.groupBy(*st.keys).agg(
        F.lit(LB.CHECK_PODCAST).alias("check_type"), F.count_if(leak).alias("podcast_count"))


def dq_silver_date_range(st: Stages) -> DataFrame:
    s = F.col("play_start_MST")
    return st.silver.groupBy(*st.keys).agg(
        F.lit(LB.CHECK_DATE_RANGE).alias("metric"),
        F.min(s).alias("earliest_play"), F.max(s).alias("latest_play"),
        F.datediff(F.to_date(F.max(s)), F.to_date(F.min(s))).cast("long").alias("days_span"),
        F.countDistinct(F.to_date(s)).alias("active_days"))


def dq_silver_top_artists(st: Stages, n: int = 10) -> DataFrame:
    g = st.silver.groupBy(*st.keys, "artist_name").agg(
        count_all().alias("plays"), F.sum(R.minutes_c(F.col("ms_played"))).alias("_c"))
    g = g.select(F.lit(LB.SECTION_TOP_ARTISTS).alias("section"), *st.keys, "artist_name", "plays",
                 R.rround(F.col("_c"), 100, 1).alias("total_minutes"),
                 R.rround(F.col("_c"), F.col("plays") * 100, 2).alias("avg_minutes_per_play"))
    return top_n(g, st.keys, [F.desc("plays"), F.asc_nulls_first("artist_name")], n)


def _share_of(st: Stages, df: DataFrame, col: str) -> DataFrame:
    g = df.groupBy(*st.keys, col).agg(count_all().alias("plays"))
    return with_share(g, st.keys, "plays")


def dq_silver_completion(st: Stages) -> DataFrame:
    return _share_of(st, st.silver, "completion_category")


def dq_silver_daypart(st: Stages) -> DataFrame:
    return _share_of(st, st.silver, "time_of_day")


def dq_silver_removed(st: Stages) -> DataFrame:
    raw_music = (st.raw.filter(F.col("episode_name").isNull()).groupBy(*st.keys)
                 .agg(count_all().alias("raw_music_plays")))
    clean = st.silver.groupBy(*st.keys).agg(count_all().alias("clean_plays"))
    j = join_on_keys(raw_music, clean, st.keys, "left")
    j = j.withColumn("clean_plays", F.coalesce("clean_plays", F.lit(0)))
    removed = F.col("raw_music_plays") - F.col("clean_plays")
    return j.select(F.lit(LB.CHECK_CLEANING).alias("metric"), *st.keys, "raw_music_plays", "clean_plays",
                    removed.alias("plays_removed"), R.pct(removed, F.col("raw_music_plays")).alias("pct_removed"))


def _with_prev(st: Stages, df: DataFrame, cols) -> DataFrame:
    out = lag_carry(df, st.keys, PLAY_ORDER, cols, st.cfg)
    return out.withColumn("gap_seconds", TU.seconds_between(F.col("prev_play_end_MST"), F.col("play_start_MST")))


def overlap_counts(st: Stages, df: DataFrame) -> DataFrame:
    x = _with_prev(st, df.select(*st.keys, *PLAY_ORDER, "device"), ["play_end_MST", "device"])
    x = x.filter(F.col("prev_play_end_MST").isNotNull())
    gap, dev, pdev = F.col("gap_seconds"), F.col("device"), F.col("prev_device")
    sev = -st.cfg.overlap_seconds
    return x.groupBy(*st.keys).agg(
        count_all().alias("total_transitions"),
        F.count_if(gap < 0).alias("total_overlaps"),
        F.count_if((gap < 0) & (dev != pdev)).alias("cross_device_overlaps"),
        F.count_if((gap < 0) & (dev == pdev)).alias("same_device_overlaps"),
        F.count_if((gap < sev) & (dev == pdev)).alias("severe_same_device_overlaps"))


def dq_silver_overlaps(st: Stages) -> DataFrame:
    c = overlap_counts(st, st.silver)
    t = F.col("total_transitions")
    return c.select(
        F.lit(LB.CHECK_OVERLAPS).alias("check_type"), *st.keys, "total_transitions", "total_overlaps",
        "cross_device_overlaps", "same_device_overlaps", "severe_same_device_overlaps",
        R.pct(F.col("total_overlaps"), t).alias("pct_general_overlap"),
        R.pct(F.col("cross_device_overlaps"), t).alias("pct_cross_overlaps"),
        R.pct(F.col("same_device_overlaps"), t).alias("pct_same_overlaps"),
        R.pct(F.col("severe_same_device_overlaps"), t).alias("pct_severe_same_overlaps"))


def dq_silver_overlap_samples(st: Stages, n: int = 20) -> DataFrame:
    base = st.silver.select(*st.keys, *PLAY_ORDER, "device", "track_name")
    x = _with_prev(st, base, ["play_start_MST", "play_end_MST", "device", "track_name"])
    x = x.filter((F.col("gap_seconds") < -st.cfg.overlap_seconds) & (F.col("device") == F.col("prev_device")))
    x = x.select(*st.keys, "play_start_MST", "play_end_MST", "device", "track_name",
                 F.col("prev_play_start_MST").alias("prev_start"), F.col("prev_play_end_MST").alias("prev_end"),
                 "prev_device", F.col("prev_track_name").alias("prev_track"), "gap_seconds",
                 "track_uri", "ms_played")
    order = [F.asc("gap_seconds")] + [F.asc(c) for c in PLAY_ORDER]
    return top_n(x, st.keys, order, n).drop("track_uri", "ms_played")


def dq_silver_devices(st: Stages, n: int = 10) -> DataFrame:
    s = _share_of(st, st.silver, "device")
    return top_n(s, st.keys, [F.desc("plays"), F.asc_nulls_first("device")], n)


# ------------------------------------------------------------------ sessions
def dq_sessions_total(st: Stages) -> DataFrame:
    return st.sessions.groupBy(*st.keys).agg(
        F.lit(LB.CHECK_TOTAL_SESSIONS).alias("metric"), count_all().alias("value"))


def dq_sessions_by_length(st: Stages) -> DataFrame:
    g = st.sessions.groupBy(*st.keys, "session_length_category").agg(
        count_all().alias("session_count"), F.sum("tracks_played").alias("_t"),
        F.sum(R.to_cents(F.col("total_minutes_played"))).alias("_m"))
    g = with_share(g, st.keys, "session_count")
    n = F.col("session_count")
    return g.select(*st.keys, "session_length_category", "session_count", "pct_of_total",
                    R.rround(F.col("_t"), n, 1).alias("avg_tracks"),
                    R.rround(F.col("_m"), n * 100, 1).alias("avg_minutes"))


def dq_sessions_by_type(st: Stages) -> DataFrame:
    g = st.sessions.groupBy(*st.keys, "session_type").agg(
        count_all().alias("session_count"),
        F.sum(R.to_cents(F.col("diversity_score"))).alias("_d"),
        F.sum(R.to_cents(F.col("skip_rate"))).alias("_s"))
    g = with_share(g, st.keys, "session_count")
    n = F.col("session_count")
    return g.select(*st.keys, "session_type", "session_count", "pct_of_total",
                    R.rround(F.col("_d"), n * 100, 3).alias("avg_diversity"),
                    R.rround(F.col("_s"), n * 100, 2).alias("avg_skip_rate"))


def dq_sessions_by_engagement(st: Stages) -> DataFrame:
    g = st.sessions.groupBy(*st.keys, "engagement_level").agg(
        count_all().alias("session_count"),
        F.sum(R.to_cents(F.col("completion_rate"))).alias("_c"),
        F.sum(R.to_cents(F.col("skip_rate"))).alias("_s"),
        F.sum("tracks_played").alias("_t"))
    n = F.col("session_count")
    return g.select(*st.keys, "engagement_level", "session_count",
                    R.rround(F.col("_c"), n * 100, 2).alias("avg_completion_rate"),
                    R.rround(F.col("_s"), n * 100, 2).alias("avg_skip_rate"),
                    R.rround(F.col("_t"), n, 1).alias("avg_tracks"))


def dq_sessions_by_month(st: Stages) -> DataFrame:
    g = st.sessions.groupBy(*st.keys, "session_year", "session_month").agg(
        count_all().alias("sessions"), F.sum("tracks_played").alias("_t"),
        F.sum(R.to_cents(F.col("session_duration_minutes"))).alias("_d"))
    n = F.col("sessions")
    return g.select(*st.keys, "session_year", "session_month", "sessions",
                    R.rround(F.col("_t"), n, 1).alias("avg_tracks_per_session"),
                    R.rround(F.col("_d"), n * 100, 1).alias("avg_duration_minutes"))


def dq_sessions_extremes(st: Stages) -> DataFrame:
    s = st.sessions
    cols = [*st.keys, "session_id", "session_start", "tracks_played", "session_duration_minutes",
            R.rround(R.to_cents(F.col("session_duration_minutes")), 6000, 1).alias("session_duration_hours"),
            "unique_artists"]
    sid = F.asc("session_id")
    parts = [
        top_n(s, st.keys, [F.desc("session_duration_minutes"), sid], 1)
        .select(F.lit(LB.EXTREME_LONGEST).alias("metric"), *cols),
        top_n(s, st.keys, [F.desc("tracks_played"), sid], 3)
        .select(F.lit(LB.EXTREME_TRACKS).alias("metric"), *cols),
        top_n(s.filter(F.col("tracks_played") >= LB.EXTREME_DIVERSE_MIN_TRACKS), st.keys,
              [F.desc("weighted_diversity_score"), sid], 3)
        .select(F.lit(LB.EXTREME_DIVERSE).alias("metric"), *cols),
    ]
    return reduce(DataFrame.unionByName, parts)


def dq_sessions_orphans(st: Stages) -> DataFrame:
    clean = st.silver.groupBy(*st.keys).agg(count_all().alias("total_plays_in_clean_table"))
    ses = st.sessions.groupBy(*st.keys).agg(F.sum("tracks_played").alias("total_plays_in_sessions"))
    j = join_on_keys(clean, ses, st.keys, "full")
    a = F.coalesce(F.col("total_plays_in_clean_table"), F.lit(0))
    b = F.coalesce(F.col("total_plays_in_sessions"), F.lit(0)).cast("long")
    return j.select(F.lit(LB.CHECK_PLAY_COUNT).alias("check_type"), *st.keys,
                    a.alias("total_plays_in_clean_table"), b.alias("total_plays_in_sessions"),
                    (a - b).alias("difference"))


# ------------------------------------------------------------------ diagnostics
def dq_negative_durations(st: Stages, n: int = 10) -> DataFrame:
    s = st.sessions.filter(F.col("session_duration_minutes") < 0).select(
        *st.keys, "session_id", "session_start", "session_end", "session_duration_minutes")
    return top_n(s, st.keys, [F.asc("session_duration_minutes"), F.asc("session_id")], n)


def dq_intra_session_gaps(st: Stages) -> DataFrame:
    inner = st.plays_sid.filter(F.col("new_session_flag") == 0)
    g = F.col("seconds_since_last_play")
    return inner.groupBy(*st.keys).agg(
        count_all().alias("inner_transitions"),
        F.max(g).alias("max_inner_gap_seconds"),
        F.count_if(g > st.cfg.gap_seconds).alias("inner_gaps_over_limit"),
        F.count_if(g < -st.cfg.overlap_seconds).alias("inner_overlaps_over_limit"))


QUANTILE_METRICS = [("skip_rate", "skip_rate"), ("shuffle_usage_pct", "shuffle"),
                    ("diversity_score", "diversity"), ("weighted_diversity_score", "weighted_div"),
                    ("completion_rate", "completion")]


def session_quantiles(st: Stages) -> DataFrame:
    """p10/25/50/75/90 of five session measures (accuracy high enough to be
    exact at these sizes; percentile_approx is a mergeable sketch)."""
    levels = list(LB.QUANTILE_LEVELS)
    aggs = [F.percentile_approx(col, levels, 10000).alias(f"_{name}") for col, name in QUANTILE_METRICS]
    g = st.sessions.groupBy(*st.keys).agg(*aggs)
    out = [F.col(f"_{name}")[i].alias(f"{name}_p{int(round(q * 100))}")
           for _, name in QUANTILE_METRICS for i, q in enumerate(levels)]
    return g.select(*st.keys, *out)


def dq_min_ms_sweep(st: Stages) -> DataFrame:
    """Rows kept and severe same-device overlaps for each candidate min_ms.

    Silver is built once at the lowest threshold (the dedup key contains
    ms_played, so keeping ms_played >= t afterwards equals cleaning at t).
    Each play then finds, for every threshold t it passes, the previous play
    that also passes t - all thresholds in one carry pass - and the counts
    come out of one aggregate, unpivoted to one row per threshold.
    """
    lowest = int(min(LB.MIN_MS_SWEEP_SECONDS) * 1000)
    base = silver(st.raw, st.cfg.with_(min_ms=lowest)).select(*st.keys, *PLAY_ORDER, "device")
    ms_list = [int(sec * 1000) for sec in LB.MIN_MS_SWEEP_SECONDS]
    ms = F.col("ms_played")
    conds = {f"t{m}": ms >= m for m in ms_list}
    x = lag_carry_where(base, st.keys, PLAY_ORDER, ["play_end_MST", "device"], conds, st.cfg)
    aggs = []
    for m in ms_list:
        prev = F.col(f"prev_t{m}")
        gap = TU.seconds_between(prev["play_end_MST"], F.col("play_start_MST"))
        kept = ms >= m
        aggs += [F.count_if(kept).alias(f"_k{m}"),
                 F.count_if(kept & prev.isNotNull() & (gap < 0)).alias(f"_o{m}"),
                 F.count_if(kept & (gap < -st.cfg.overlap_seconds)
                            & (F.col("device") == prev["device"])).alias(f"_s{m}")]
    g = x.groupBy(*st.keys).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(m).cast("long").alias("min_ms"), F.col(f"_k{m}").alias("rows_kept"),
                              F.col(f"_o{m}").alias("total_overlaps"),
                              F.col(f"_s{m}").alias("severe_same_device_overlaps")) for m in ms_list])
    return g.select(*st.keys, F.inline(rows)).filter(F.col("rows_kept") > 0)


# ------------------------------------------------------------------ expectations
def expectations(st: Stages) -> DataFrame:
    """Checks whose expected value the source pipeline states, one row per
    (check, key): observed value, expected value, passed. All per-key
    aggregates (small), unioned."""
    def row(df: DataFrame, name: str, col: str) -> DataFrame:
        return df.select(F.lit(name).alias("expectation"), *st.keys,
                         F.col(col).cast("long").alias("observed"), F.lit(0).cast("long").alias("expected"))

    gaps = dq_intra_session_gaps(st)
    gaps = gaps.select(*st.keys, F.inline(F.array(*[F.struct(F.lit(n).alias("expectation"), F.col(c).cast("long").alias("observed"))
                                                    for n, c in (("no gap over the limit inside a session", "inner_gaps_over_limit"),
                                                                 ("no severe overlap inside a session", "inner_overlaps_over_limit"))]))) \
        .select("expectation", *st.keys, "observed", F.lit(0).cast("long").alias("expected"))
    neg = (st.sessions.groupBy(*st.keys)
           .agg(F.count_if(F.col("session_duration_minutes") < 0).alias("negative_durations")))
    parts = [
        row(dq_silver_duplicates(st), "no remaining duplicates", "remaining_duplicates"),
        row(dq_silver_podcast_leak(st), "no podcasts in silver", "podcast_count"),
        row(dq_sessions_orphans(st), "every clean play in one session", "difference"),
        gaps,
        row(neg, "no negative session duration", "negative_durations"),
    ]
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("passed", F.col("observed") == F.col("expected"))
