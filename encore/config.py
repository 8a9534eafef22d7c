"""Pipeline parameters. Defaults reproduce the reference pipeline's literals."""

from __future__ import annotations

from dataclasses import dataclass, replace

from encore import labels as LB


@dataclass(frozen=True)
class PipelineConfig:
    # local clock of the silver layer (zone with historical DST)
    tz: str = "America/Mazatlan"
    # fixed clock shift used by the profiling queries on raw data
    eda_offset_hours: int = 7
    # silver filters
    min_ms: int = 1000
    first_date: str = "2013-09-23"
    excluded_date_ranges: tuple[tuple[str, str], ...] = (("2020-12-07", "2020-12-08"),)
    # sessionization: new session when gap > gap_seconds or gap < -overlap_seconds
    gap_seconds: int = 1800
    overlap_seconds: int = 1800
    # bucket used to split each account's timeline for the parallel carry:
    # "day", "hour" or "minute" of play_start (bounds the largest task)
    carry_bucket: str = "day"
    # session classes: length limits (minutes, strict <); type thresholds
    # (active skip >, shuffle >, variety weighted >, focused weighted <, album completion >);
    # engagement thresholds (high completion >, high skip <, medium completion >)
    length_bounds: tuple[float, ...] = LB.LENGTH_LIMITS_MIN
    type_thresholds: tuple[float, ...] = (LB.ACTIVE_SKIP_GT, LB.SHUFFLE_GT, LB.VARIETY_WEIGHTED_GT,
                                          LB.FOCUSED_WEIGHTED_LT, LB.ALBUM_COMPLETION_GT)
    engagement_thresholds: tuple[float, ...] = (LB.HIGH_COMPLETION_GT, LB.HIGH_SKIP_LT, LB.MEDIUM_COMPLETION_GT)
    # gold view thresholds
    min_artist_plays: int = 5
    min_track_plays: int = 3
    top_all_time: int = 50
    top_yearly: int = 20
    # opt-in: session counts in the artist / track / temporal / yearly views
    # (read from plays with session ids instead of silver)
    session_counts: bool = False
    # date used instead of CURRENT_DATE (None = today); "YYYY-MM-DD"
    as_of: str | None = None
    # grouping keys every query is computed per; () = one global timeline
    keys: tuple[str, ...] = ("account_id",)

    def with_(self, **kw) -> "PipelineConfig":
        return replace(self, **kw)


DEFAULT = PipelineConfig()
GLOBAL = PipelineConfig(keys=())
