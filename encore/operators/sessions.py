"""Session table: plays chained into sessions, then measured and classified."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore import labels as LB
from encore.config import PipelineConfig
from encore.functions import rounding as R
from encore.functions import timeutil as TU
from encore.functions.aggregates import flag
from encore.operators.carry import sessionize
from encore.operators.rollup import summarise
from encore.schemas import PLAY_ORDER, SESSION_COLUMNS


def plays_with_session_id(silver: DataFrame, cfg: PipelineConfig) -> DataFrame:
    return sessionize(silver, cfg, PLAY_ORDER)


def session_metrics(plays: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """One row per (keys, session_id) with the session measures (unclassified)."""
    keys = list(cfg.keys)
    g = summarise(plays, [*keys, "session_id"], {
        "session_start": ("min", F.col("play_start_MST")),
        "session_end": ("max", F.col("play_end_MST")),
        "tracks_played": ("count", F.lit(1)),
        "_min_c": ("sum", R.minutes_c(F.col("ms_played"))),
        "_shuffle": ("sum", flag(F.col("shuffle_flag"))),
        "_skip": ("sum", flag(F.col("skipped_flag"))),
        "_complete": ("sum", flag(F.col("completion_category") == LB.COMPLETION_COMPLETE)),
        "offline_plays": ("sum", flag(F.col("offline_flag"))),
    }, distinct={"unique_artists": "artist_name", "unique_albums": "album_name", "devices_used": "device"},
        frequent={"primary_device": "device"})
    return finish_metrics(g, keys)


def finish_metrics(g: DataFrame, keys, extra=()) -> DataFrame:
    """Session counters (counts, sums, distinct counts, most used device) ->
    the rounded session measures (+ `extra` columns passed through). Shared by
    the batch and streaming paths."""
    keys = list(keys)
    n = F.col("tracks_played")
    dur = TU.seconds_between(F.col("session_start"), F.col("session_end"))
    ua = F.col("unique_artists")
    return g.select(
        *keys, "session_id", "session_start", "session_end",
        dur.alias("session_duration_seconds"),
        R.rround(dur, 60, 2).alias("session_duration_minutes"),
        "tracks_played", "unique_artists", "unique_albums", "devices_used",
        R.from_cents(F.col("_min_c")).alias("total_minutes_played"),
        R.rround(F.col("_min_c"), n * 100, 2).alias("avg_track_duration"),
        R.pct(F.col("_shuffle"), n).alias("shuffle_usage_pct"),
        R.pct(F.col("_skip"), n).alias("skip_rate"),
        R.pct(F.col("_complete"), n).alias("completion_rate"),
        F.col("offline_plays").cast("long").alias("offline_plays"),
        R.rround(ua, n, 2).alias("diversity_score"),
        # (artists / plays) * least(plays / 10, 1) == artists * least(plays, 10) / (10 * plays)
        R.rround(ua * F.least(n, F.lit(10)), n * 10, 2).alias("weighted_diversity_score"),
        "primary_device", *extra,
    )


def length_category(minutes, bounds=LB.LENGTH_LIMITS_MIN) -> "F.Column":
    a, b, c, d = bounds
    l0, l1, l2, l3, l4 = LB.LENGTH_LABELS
    return (F.when(minutes < a, l0).when(minutes < b, l1).when(minutes < c, l2)
            .when(minutes < d, l3).otherwise(l4))


def session_type(skip, shuffle, weighted, completion, th=None) -> "F.Column":
    """First match wins, on the rounded rates."""
    active_skip, shuffle_gt, variety, focused, album = th or PipelineConfig().type_thresholds
    return (F.when((skip > active_skip) & (shuffle > shuffle_gt), LB.TYPE_ACTIVE)
            .when(shuffle > shuffle_gt, LB.TYPE_DISCOVERY)
            .when(weighted > variety, LB.TYPE_VARIETY)
            .when((weighted < focused) & (completion > album), LB.TYPE_ALBUM)
            .when(weighted < focused, LB.TYPE_DEEP)
            .otherwise(LB.TYPE_BALANCED))


def engagement_level(completion, skip, th=None) -> "F.Column":
    high_c, high_s, medium_c = th or PipelineConfig().engagement_thresholds
    return (F.when((completion > high_c) & (skip < high_s), LB.ENGAGEMENT_HIGH)
            .when(completion > medium_c, LB.ENGAGEMENT_MEDIUM)
            .otherwise(LB.ENGAGEMENT_LOW))


def classify(metrics: DataFrame, cfg: PipelineConfig, extra=()) -> DataFrame:
    st = F.col("session_start")
    out = metrics.select(
        "*",
        F.to_date(st).alias("session_date"),
        TU.year(st).alias("session_year"),
        TU.month(st).alias("session_month"),
        TU.day_name(st).alias("session_day_of_week"),
        TU.hour(st).alias("session_start_hour"),
        length_category(F.col("session_duration_minutes"), cfg.length_bounds).alias("session_length_category"),
        session_type(F.col("skip_rate"), F.col("shuffle_usage_pct"), F.col("weighted_diversity_score"),
                     F.col("completion_rate"), cfg.type_thresholds).alias("session_type"),
        engagement_level(F.col("completion_rate"), F.col("skip_rate"),
                         cfg.engagement_thresholds).alias("engagement_level"),
    )
    cols = [c for c in SESSION_COLUMNS if c != "account_id" or "account_id" in cfg.keys]
    return out.select(*cols, *extra)


def sessions(silver: DataFrame, cfg: PipelineConfig) -> DataFrame:
    return classify(session_metrics(plays_with_session_id(silver, cfg), cfg), cfg)
