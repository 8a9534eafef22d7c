"""Parameters change the results the same way on both engines (oracle per config)."""
import pytest

from encore.config import DEFAULT
from encore.plans import oracle
from encore.plans.registry import stage_functions
from encore.plans.stages import Stages
from tests.conftest import SF_MID
from tests.harness import compare, duck

VARIANTS = {
    "small_limits": (DEFAULT.with_(top_all_time=5, top_yearly=3, min_artist_plays=200, min_track_plays=120),
                     ["view_top_content", "view_top_content_rank", "view_artist_stats", "view_track_stats",
                      "dq_silver_top_artists"]),
    "short_gap_hour_buckets": (DEFAULT.with_(gap_seconds=600, overlap_seconds=300, carry_bucket="hour"),
                               ["sessions", "dq_sessions_by_type", "dq_intra_session_gaps", "dq_silver_overlaps",
                                "dq_min_ms_sweep"]),
    "session_counts": (DEFAULT.with_(session_counts=True),
                       ["view_artist_stats", "view_track_stats", "view_temporal_patterns", "view_yearly_trends"]),
    "other_clock_and_filters": (DEFAULT.with_(tz="Europe/Madrid", eda_offset_hours=2, min_ms=30000,
                                              first_date="2021-11-01",
                                              excluded_date_ranges=(("2022-07-10", "2022-07-12"),
                                                                    ("2024-01-05", "2024-01-06")),
                                              as_of="2024-06-30"),
                                ["silver_clean", "sessions", "eda_by_hour", "eda_overview", "view_artist_stats",
                                 "view_yearly_trends", "dq_silver_removed"]),
}


@pytest.fixture(scope="module")
def con():
    return duck(SF_MID)


@pytest.mark.parametrize("variant", sorted(VARIANTS))
def test_variant_matches_oracle(spark, con, variant):
    cfg, names = VARIANTS[variant]
    sql = oracle.build(cfg)
    fns = stage_functions()
    for name in names:
        ok, msg = compare(fns[name](Stages(spark, SF_MID, cfg)), sql[name], con)
        assert ok, f"{variant}/{name}: {msg}"
