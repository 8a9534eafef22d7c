"""Gold views over the silver and session tables (per account)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore import labels as LB
from encore.functions import rounding as R
from encore.functions import timeutil as TU
from encore.functions.aggregates import count_all, flag
from encore.operators.ranking import with_tile
from encore.operators.rollup import summarise
from encore.operators.shares import top_n
from encore.plans.stages import Stages


def _min_c() -> Column:
    return R.minutes_c(F.col("ms_played"))


def _hours_c() -> Column:
    return R.hours_c(F.col("ms_played"))


#: Counters of a group of plays, from which `_rates` makes percentages.
def _counters() -> dict[str, tuple[str, Column]]:
    return {"_skip": ("sum", flag(F.col("skipped_flag"))),
            "_complete": ("sum", flag(F.col("completion_category") == LB.COMPLETION_COMPLETE)),
            "_shuffle": ("sum", flag(F.col("shuffle_flag"))), "_c": ("sum", _min_c())}


def _rates(n: str) -> list[Column]:
    """skip / completion / shuffle percentages of a group of plays."""
    return [R.pct(F.col("_skip"), F.col(n)).alias("skip_rate"), R.pct(F.col("_complete"), F.col(n)).alias("completion_rate"),
            R.pct(F.col("_shuffle"), F.col(n)).alias("shuffle_usage_pct")]


def _dates() -> dict[str, tuple[str, Column]]:
    return {"_first": ("min", F.col("play_date")), "_last": ("max", F.col("play_date"))}


def _span() -> Column:
    return F.datediff("_last", "_first").cast("long")


def _since(st: Stages) -> Column:
    return F.datediff(TU.as_of_date(st.cfg), F.col("_last")).cast("long")


def _average(n: str) -> Column:
    return R.rround(F.col("_c"), F.col(n) * 100, 2)


def _plays(st: Stages) -> DataFrame:
    """Silver, or - with the session-count opt-in - the same plays with their session id."""
    return st.plays_sid if st.cfg.session_counts else st.silver


def _sessions_count(st: Stages, alias: str) -> dict[str, str]:
    return {alias: "session_id"} if st.cfg.session_counts else {}


def view_artist_stats(st: Stages) -> DataFrame:
    sessions = _sessions_count(st, "sessions_featured")
    g = summarise(_plays(st), [*st.keys, "artist_name"],
                  {"total_plays": ("count", F.lit(1)), "_h": ("sum", _hours_c()), **_counters(), **_dates()},
                  distinct={"unique_tracks": "track_name", "devices_used": "device", **sessions},
                  frequent={"preferred_time": "time_of_day", "primary_device": "device"})
    return g.filter(F.col("total_plays") >= st.cfg.min_artist_plays).select(
        *st.keys, "artist_name", "total_plays", "unique_tracks", *sessions,
        R.from_cents(F.col("_c")).alias("total_minutes"), R.from_cents(F.col("_h")).alias("total_hours"),
        _average("total_plays").alias("avg_track_duration"),
        F.col("_first").alias("first_play_date"), F.col("_last").alias("last_play_date"), _span().alias("days_span"),
        "preferred_time", *_rates("total_plays"), "primary_device", "devices_used", _since(st).alias("days_since_last_play"))


def view_track_stats(st: Stages, approximate: bool = False) -> DataFrame:
    """`approximate`: most_common_time from a sketch (approx_top_k) in one aggregate."""
    sessions = _sessions_count(st, "sessions_played_in")
    names = ["track_name", "artist_name", "album_name"]
    g = summarise(_plays(st), [*st.keys, *names], {"play_count": ("count", F.lit(1)), **_counters(), **_dates()},
                  distinct=sessions, frequent={"most_common_time": "time_of_day"}, approximate=approximate)
    return g.filter(F.col("play_count") >= st.cfg.min_track_plays).select(
        *st.keys, *names, "play_count", *sessions,
        R.rround(F.col("_c"), 6000, 2).alias("total_hours_listened"), _average("play_count").alias("avg_play_duration"),
        F.col("_first").alias("first_played"), F.col("_last").alias("last_played"), _span().alias("listening_span_days"),
        "most_common_time", *_rates("play_count"), _since(st).alias("days_since_last_play"))


def view_temporal_patterns(st: Stages) -> DataFrame:
    dims = ["play_year", "play_month", "play_day_week", "play_hour", "time_of_day"]
    sessions = _sessions_count(st, "total_sessions")
    g = summarise(_plays(st), [*st.keys, *dims], {"total_plays": ("count", F.lit(1)), **_counters()},
                  distinct={"unique_artists": "artist_name", "unique_tracks": "track_name", **sessions})
    # AVG(COUNT(*)) OVER (year, month, weekday), computed on the aggregated rows
    w = Window.partitionBy(*st.keys, "play_year", "play_month", "play_day_week")
    avg = R.rround(F.sum("total_plays").over(w), F.count(F.lit(1)).over(w), 1)
    return g.select(*st.keys, *dims, "total_plays", *sessions, "unique_artists", "unique_tracks",
                    R.from_cents(F.col("_c")).alias("total_minutes"), _average("total_plays").alias("avg_track_duration"),
                    avg.alias("avg_plays_per_hour"), *_rates("total_plays"))


def view_session_behavior(st: Stages) -> DataFrame:
    dims = ["session_year", "session_month", "session_day_of_week", "session_start_hour",
            "session_length_category", "session_type", "engagement_level"]
    n = F.col("session_count")
    cents = ["session_duration_minutes", "diversity_score", "weighted_diversity_score", "skip_rate", "completion_rate",
             "shuffle_usage_pct"]
    g = summarise(st.sessions, [*st.keys, *dims], {
        "session_count": ("count", F.lit(1)), "total_tracks": ("sum", F.col("tracks_played")),
        "_artists": ("sum", F.col("unique_artists")), **{f"_{c}": ("sum", R.to_cents(F.col(c))) for c in cents},
    }, frequent={"most_common_device": "primary_device"})

    def avg_c(col: str, digits: int) -> Column:
        return R.rround(F.col(f"_{col}"), n * 100, digits)

    return g.select(
        *st.keys, *dims, "session_count", "total_tracks",
        R.rround(F.col("total_tracks"), n, 1).alias("avg_tracks_per_session"),
        avg_c("session_duration_minutes", 1).alias("avg_duration_minutes"),
        R.rround(F.col("_artists"), n, 1).alias("avg_unique_artists"),
        avg_c("diversity_score", 3).alias("avg_diversity"),
        avg_c("weighted_diversity_score", 3).alias("avg_weighted_diversity"),
        avg_c("skip_rate", 2).alias("avg_skip_rate"),
        avg_c("completion_rate", 2).alias("avg_completion_rate"),
        avg_c("shuffle_usage_pct", 2).alias("avg_shuffle_usage"),
        "most_common_device")


def view_yearly_trends(st: Stages) -> DataFrame:
    sessions = _sessions_count(st, "total_sessions")
    g = summarise(_plays(st), [*st.keys, "play_year"],
                  {"total_plays": ("count", F.lit(1)), "_h": ("sum", _hours_c()), **_counters()},
                  distinct={"unique_artists": "artist_name", "unique_tracks": "track_name", **sessions})
    w = Window.partitionBy(*st.keys).orderBy("play_year") if st.keys else Window.orderBy("play_year")
    prev_n, prev_h = F.lag("total_plays").over(w), F.lag("_h").over(w)
    return g.select(
        *st.keys, "play_year", "total_plays", "unique_artists", "unique_tracks",
        *sessions, R.from_cents(F.col("_h")).alias("total_hours"), _average("total_plays").alias("avg_track_duration"),
        *_rates("total_plays"),
        R.rround((F.col("total_plays") - prev_n) * 100, prev_n, 2).alias("pct_yoy_play_count"),
        R.rround((F.col("_h") - prev_h) * 100, prev_h, 2).alias("pct_yoy_hours_played"))


# ------------------------------------------------------------------ top content
TOP_COLUMNS = ["time_period", "year", "content_type", "artist_name", "track_name", "play_count",
               "total_hours", "rank"]


def _play_counts(st: Stages) -> DataFrame:
    """Plays and hour-hundredths per (keys, year, artist, track): the finest
    grain; the four ranked sets roll it up instead of rescanning silver."""
    return st.silver.groupBy(*st.keys, "play_year", "artist_name", "track_name").agg(
        count_all().alias("play_count"), F.sum(_hours_c()).alias("_h"))


def ranked_sets(st: Stages, method: str = "row_number", with_lead: bool = False) -> DataFrame:
    base = _play_counts(st)
    cfg = st.cfg
    null_year, null_track = F.lit(None).cast("long"), F.lit(None).cast("string")
    specs = [  # period, content, year column, group columns, n
        (LB.PERIOD_ALL, LB.CONTENT_ARTIST, None, ["artist_name"], cfg.top_all_time),
        (LB.PERIOD_YEARLY, LB.CONTENT_ARTIST, "play_year", ["artist_name"], cfg.top_yearly),
        (LB.PERIOD_ALL, LB.CONTENT_TRACK, None, ["artist_name", "track_name"], cfg.top_all_time),
        (LB.PERIOD_YEARLY, LB.CONTENT_TRACK, "play_year", ["artist_name", "track_name"], cfg.top_yearly),
    ]
    parts = []
    for period, content, ycol, group, n in specs:
        gcols = ([ycol] if ycol else []) + group
        g = base.groupBy(*st.keys, *gcols).agg(F.sum("play_count").alias("play_count"), F.sum("_h").alias("_h"))
        part_keys = list(st.keys) + ([ycol] if ycol else [])
        order = [F.desc("play_count")]
        if method == "row_number":  # unique order: ties broken by name
            order += [F.asc_nulls_first(c) for c in group]
        r = top_n(g, part_keys, order, n + with_lead, rank_col="rank", method=method)
        if with_lead:                        # over the first n + 1 only, so that the group limit holds
            w = (Window.partitionBy(*part_keys) if part_keys else Window.partitionBy()).orderBy("rank")
            r = r.withColumn("next_play_count", F.lead("play_count").over(w)).filter(F.col("rank") <= n)
        cols = [F.lit(period).alias("time_period"),
                (F.col(ycol) if ycol else null_year).alias("year"),
                F.lit(content).alias("content_type"), "artist_name",
                (F.col("track_name") if "track_name" in group else null_track).alias("track_name"),
                "play_count", R.from_cents(F.col("_h")).alias("total_hours"), "rank"]
        if with_lead:
            cols.append((F.col("play_count") - F.col("next_play_count")).alias("lead_over_next"))
        parts.append(r.select(*st.keys, *cols))
    return reduce(DataFrame.unionByName, parts)


def view_top_content(st: Stages) -> DataFrame:
    return ranked_sets(st, "row_number")


def view_top_content_rank(st: Stages) -> DataFrame:
    """Same sets with RANK(): ties on play count share a rank and all are kept."""
    return ranked_sets(st, "rank")


def view_top_content_dense_rank(st: Stages) -> DataFrame:
    return ranked_sets(st, "dense_rank")


def view_top_content_lead(st: Stages) -> DataFrame:
    """Top sets with LEAD(): how many plays each entry is ahead of the next one."""
    return ranked_sets(st, "row_number", with_lead=True)


def view_artist_tiers(st: Stages, tiles: int = 4) -> DataFrame:
    """NTILE(4) of every artist by plays (1 = most played quarter)."""
    g = st.silver.groupBy(*st.keys, "artist_name").agg(count_all().alias("total_plays"))
    return with_tile(g, [F.desc("total_plays"), F.asc_nulls_first("artist_name")], st.keys, tiles, "play_tier")


NAMES = ["view_artist_stats", "view_track_stats", "view_temporal_patterns", "view_session_behavior",
         "view_yearly_trends", "view_top_content", "view_top_content_rank", "view_top_content_dense_rank",
         "view_top_content_lead", "view_artist_tiers"]
