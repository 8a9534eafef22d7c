"""Presentation order of the report queries (the source queries' ORDER BY).

Only small, aggregated results are sorted; the row tables (silver, plays,
sessions) stay unsorted (an ORDER BY in a table build has no lasting meaning).
Label orders sort on the labels the queries actually emit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore import labels as LB


def _rank(col: str, labels) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(col))


def _desc(c: str) -> Column:
    return F.desc(c)


ORDER = {
    "eda_content_type": lambda: [_desc("plays")],
    "eda_by_month": lambda: ["year", "month"],
    "eda_by_weekday": lambda: ["day_num"],
    "eda_by_hour": lambda: ["hour"],
    "eda_heatmap": lambda: ["day_num", "hour"],
    "eda_top_artists": lambda: [_desc("plays"), "artist"],
    "eda_top_tracks": lambda: [_desc("plays"), "track", "artist"],
    "eda_artist_discovery": lambda: ["first_discovered", "artist"],
    "eda_platform": lambda: [_desc("plays")],
    "eda_platform_daypart": lambda: ["platform", _rank("time_of_day", LB.DAYPART_EDA)],
    "eda_country": lambda: [_desc("plays")],
    "eda_duration_buckets": lambda: [_rank("duration_bucket", LB.DURATION_LABELS)],
    "eda_reason_start": lambda: [_desc("plays")],
    "eda_reason_end": lambda: [_desc("plays")],
    "eda_binge_days": lambda: [_desc("hours_listened"), "date"],
    "eda_loyalty": lambda: [F.desc_nulls_last("loyalty_score"), "artist"],
    "eda_gap_buckets": lambda: [_rank("gap_bucket", (LB.GAP_FIRST,) + LB.GAP_LABELS)],
    "eda_completion": lambda: [_rank("completion_category", LB.EDA_COMPLETION_LABELS)],
    "dq_silver_top_artists": lambda: [_desc("plays"), "artist_name"],
    "dq_silver_completion": lambda: [_rank("completion_category", (LB.COMPLETION_SKIPPED, LB.COMPLETION_PARTIAL,
                                                                   LB.COMPLETION_COMPLETE))],
    "dq_silver_daypart": lambda: [_rank("time_of_day", LB.DAYPART_SILVER)],
    "dq_silver_overlap_samples": lambda: ["gap_seconds", "play_start_MST"],
    "dq_silver_devices": lambda: [_desc("plays"), "device"],
    "dq_sessions_by_length": lambda: [_rank("session_length_category", LB.LENGTH_LABELS)],
    "dq_sessions_by_type": lambda: [_desc("session_count")],
    "dq_sessions_by_engagement": lambda: [_rank("engagement_level", (LB.ENGAGEMENT_HIGH, LB.ENGAGEMENT_MEDIUM,
                                                                     LB.ENGAGEMENT_LOW))],
    "dq_sessions_by_month": lambda: ["session_year", "session_month"],
    "dq_sessions_extremes": lambda: [_rank("metric", (LB.EXTREME_LONGEST, LB.EXTREME_TRACKS, LB.EXTREME_DIVERSE))],
    "dq_negative_durations": lambda: ["session_duration_minutes", "session_id"],
    "dq_min_ms_sweep": lambda: ["min_ms"],
    "view_temporal_patterns": lambda: ["play_year", "play_month", "play_day_week", "play_hour"],
    "view_yearly_trends": lambda: ["play_year"],
    "view_top_content": lambda: ["time_period", "year", "content_type", "rank"],
    "view_top_content_rank": lambda: ["time_period", "year", "content_type", "rank"],
    "view_top_content_dense_rank": lambda: ["time_period", "year", "content_type", "rank"],
    "view_top_content_lead": lambda: ["time_period", "year", "content_type", "rank"],
}


def present(name: str, df: DataFrame, keys) -> DataFrame:
    """Sort a report the way its source query does (per key first)."""
    order = ORDER.get(name)
    if order is None:
        return df
    return df.orderBy(*[k for k in keys if k in df.columns], *order())
