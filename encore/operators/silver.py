"""Silver layer: music plays only, deduplicated, on the local clock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore import labels as LB
from encore.config import PipelineConfig
from encore.functions import rounding as R
from encore.functions import timeutil as TU
from encore.schemas import RAW_COLUMNS

DEDUP_KEY = ["ts", "spotify_track_uri", "ms_played"]


def music_filter(raw: DataFrame, cfg: PipelineConfig) -> DataFrame:
    utc_date = F.to_date("ts")
    cond = (F.col("episode_name").isNull() & F.col("episode_show_name").isNull()
            & F.col("master_metadata_track_name").isNotNull() & F.col("spotify_track_uri").isNotNull()
            & F.col("ts").isNotNull() & (F.col("ms_played") >= cfg.min_ms)
            & (utc_date >= F.lit(cfg.first_date).cast("date")))
    for lo, hi in cfg.excluded_date_ranges:
        cond = cond & ~utc_date.between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))
    return raw.filter(cond)


def deduplicate(df: DataFrame, keys) -> DataFrame:
    """One row per (keys, ts, track uri, ms_played).

    The survivor is the smallest remaining record (field by field, NULL
    first), so reruns and recomputed tasks pick the same row. Written as an
    aggregate, it combines copies map-side before the shuffle: a key with
    millions of copies costs one row of shuffle per map task.
    """
    key = list(keys) + DEDUP_KEY
    rest = [c for c in df.columns if c not in key]
    return (df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r"))
            .select(*key, "_r.*"))


def silver(raw: DataFrame, cfg: PipelineConfig) -> DataFrame:
    keys = list(cfg.keys)
    cols = [c for c in RAW_COLUMNS if c != "account_id" or "account_id" in keys]
    return project_silver(deduplicate(music_filter(raw.select(*cols), cfg), keys), cfg)


def project_silver(m: DataFrame, cfg: PipelineConfig, extra=()) -> DataFrame:
    """Raw music plays (one per dedup key) -> the silver columns (+ `extra`)."""
    keys = list(cfg.keys)
    end = TU.local_clock(F.col("ts"), cfg)
    ms = F.col("ms_played")
    h = TU.hour(end)
    c_skip, c_part = LB.COMPLETION_LIMITS_MS
    completion = (F.when(ms < c_skip, LB.COMPLETION_SKIPPED).when(ms < c_part, LB.COMPLETION_PARTIAL)
                  .otherwise(LB.COMPLETION_COMPLETE))
    return m.select(
        *keys,
        TU.minus_ms_to_second(end, ms).alias("play_start_MST"),
        end.alias("play_end_MST"),
        ms.alias("ms_played"),
        F.col("master_metadata_track_name").alias("track_name"),
        F.col("master_metadata_album_artist_name").alias("artist_name"),
        F.col("master_metadata_album_album_name").alias("album_name"),
        F.col("spotify_track_uri").alias("track_uri"),
        F.col("platform").alias("device"),
        "reason_start", "reason_end",
        F.col("shuffle").alias("shuffle_flag"),
        F.col("skipped").alias("skipped_flag"),
        F.col("offline").alias("offline_flag"),
        F.col("offline_timestamp").alias("offline_ts_UTC"),
        F.col("incognito_mode").alias("incognito_flag"),
        F.to_date(end).alias("play_date"),
        TU.year(end).alias("play_year"),
        TU.month(end).alias("play_month"),
        TU.day_name(end).alias("play_day_week"),
        h.alias("play_hour"),
        TU.daypart_silver(h).alias("time_of_day"),
        R.from_cents(R.seconds_c(ms)).alias("seconds_played"),
        R.from_cents(R.minutes_c(ms)).alias("minutes_played"),
        R.from_cents(R.hours_c(ms)).alias("hours_played"),
        completion.alias("completion_category"),
        *extra,
    )
