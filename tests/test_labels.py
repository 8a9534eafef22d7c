"""Labels and limits that reports are compared by, as literals: the SQL beside the
queries takes them from `encore.labels`, so a slip there would show on neither side."""
from encore import labels as LB
from encore.config import DEFAULT


def test_label_sets():
    assert (LB.COMPLETION_SKIPPED, LB.COMPLETION_PARTIAL, LB.COMPLETION_COMPLETE) == (
        "Skipped (<30s)", "Partial (30s-2.5m)", "Complete (>2.5m)")
    assert LB.DAYPART_SILVER == ("Night", "Morning", "Afternoon", "Evening")
    assert LB.LENGTH_LABELS == ("Single Track (0-2.5 minutes)", "Short (2.5-15 minutes)", "Medium (15-60 minutes)",
                                "Long (1-3 hours)", "Marathon (>3 hours)")
    assert (LB.TYPE_ACTIVE, LB.TYPE_DISCOVERY, LB.TYPE_VARIETY, LB.TYPE_ALBUM, LB.TYPE_DEEP, LB.TYPE_BALANCED) == (
        "Active Search", "Discovery Mode", "Variety Seeker", "Album Listening", "Deep Dive on Artist", "Balanced Session")
    assert (LB.ENGAGEMENT_HIGH, LB.ENGAGEMENT_MEDIUM, LB.ENGAGEMENT_LOW) == (
        "High Engagement", "Medium Engagement", "Low Engagement")
    assert LB.LOYALTY_LABELS == ("High Repetition", "Medium Repetition", "High Variety")


def test_limits():
    assert LB.COMPLETION_LIMITS_MS == (30000, 150000) and LB.EDA_COMPLETION_LIMITS_MS == (30000, 90000, 150000)
    assert LB.LENGTH_LIMITS_MIN == (2.5, 15, 60, 180) and LB.GAP_LIMITS_MIN == (5, 15, 30, 60, 180)
    assert LB.DURATION_LIMITS_MS == (30000, 60000, 120000, 180000, 300000)
    assert (LB.ACTIVE_SKIP_GT, LB.SHUFFLE_GT, LB.VARIETY_WEIGHTED_GT, LB.FOCUSED_WEIGHTED_LT, LB.ALBUM_COMPLETION_GT) == (
        33.33, 90, 0.74, 0.20, 75)
    assert (LB.HIGH_COMPLETION_GT, LB.HIGH_SKIP_LT, LB.MEDIUM_COMPLETION_GT) == (80, 20, 60)
    assert (LB.LOYALTY_HIGH, LB.LOYALTY_MEDIUM, LB.LOYALTY_MIN_PLAYS) == (5, 2, 10)
    assert (DEFAULT.gap_seconds, DEFAULT.overlap_seconds) == (1800, 1800)
