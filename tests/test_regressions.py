"""One test per entry of the source pipeline's data-quality issue log."""
from pyspark.sql import functions as F

from encore import labels as LB
from encore.config import DEFAULT
from encore.operators.sessions import sessions, session_type
from encore.operators.silver import silver
from tests.test_silver import raw_row


def _sessions(spark, rows):
    from encore.schemas import RAW
    return sessions(silver(spark.createDataFrame(rows, RAW), DEFAULT), DEFAULT)


def test_dq001_duration_sign(spark):
    """Duration is end - start of the session, never negative."""
    rows = [raw_row(f"2022-01-01T10:{m:02d}:00", ms=240000, uri=f"track:{m}") for m in range(0, 40, 4)]
    s = _sessions(spark, rows).first()
    assert s.session_duration_seconds == 36 * 60 + 240 and s.session_duration_minutes == 40.0
    assert s.session_length_category == "Medium (15-60 minutes)"


def test_dq002_completion_label_matches(spark):
    """completion_rate counts the exact silver label, so High/Medium appear."""
    rows = [raw_row(f"2022-01-01T10:{m:02d}:00", ms=200000, uri=f"track:{m}", skipped=False) for m in range(0, 20, 4)]
    s = _sessions(spark, rows).first()
    assert s.completion_rate == 100.0 and s.engagement_level == LB.ENGAGEMENT_HIGH


def test_dq003_weighted_diversity_penalises_short(spark):
    """One track: diversity 1.0 but weighted 0.1; ten tracks, ten artists: 1.0."""
    one = _sessions(spark, [raw_row("2022-01-01T10:00:00")]).first()
    assert (one.diversity_score, one.weighted_diversity_score) == (1.0, 0.1)
    rows = [raw_row(f"2022-01-01T10:{m:02d}:00", ms=100000, uri=f"track:{m}",
                    master_metadata_album_artist_name=f"A{m}") for m in range(0, 30, 3)]
    ten = _sessions(spark, rows).first()
    assert (ten.tracks_played, ten.diversity_score, ten.weighted_diversity_score) == (10, 1.0, 1.0)


def test_dq004_tiebreak_and_strict_threshold(spark):
    """Same-second starts are ordered by end then uri; a gap of exactly 1800 s
    stays in the session, 1801 s starts a new one; sub-second plays are dropped."""
    rows = [raw_row("2022-01-01T10:00:00", ms=60000, uri="track:b"),
            raw_row("2022-01-01T10:00:00", ms=60000, uri="track:a"),
            raw_row("2022-01-01T10:30:30", ms=30000, uri="track:c"),     # starts 1800 s after 10:00:00
            raw_row("2022-01-01T11:01:01", ms=30000, uri="track:d"),     # starts 1801 s after 10:30:30
            raw_row("2022-01-01T11:01:02", ms=999, uri="track:e")]       # dropped by min_ms
    s = _sessions(spark, rows).orderBy("session_id").collect()
    assert [r.tracks_played for r in s] == [3, 1]


def test_dq005_type_thresholds(spark):
    df = spark.createDataFrame(
        [(40.0, 95.0, 0.5, 50.0), (33.33, 95.0, 0.5, 50.0), (10.0, 90.0, 0.75, 50.0), (10.0, 50.0, 0.74, 80.0),
         (10.0, 50.0, 0.19, 76.0), (10.0, 50.0, 0.19, 75.0), (10.0, 50.0, 0.2, 75.0)],
        "skip double, shuffle double, weighted double, completion double")
    got = [r[0] for r in df.select(session_type(F.col("skip"), F.col("shuffle"), F.col("weighted"),
                                                F.col("completion"))).collect()]
    assert got == [LB.TYPE_ACTIVE, LB.TYPE_DISCOVERY, LB.TYPE_VARIETY, LB.TYPE_BALANCED,
                   LB.TYPE_ALBUM, LB.TYPE_DEEP, LB.TYPE_BALANCED]


def test_primary_device_counts_null(spark):
    """Most frequent device counts NULL as a value; ties go to NULL, then the smallest name."""
    rows = [raw_row("2022-01-01T10:00:00", uri="track:1", platform=None),
            raw_row("2022-01-01T10:04:00", uri="track:2", platform="web"),
            raw_row("2022-01-01T10:08:00", uri="track:3", platform="ios"),
            raw_row("2022-01-01T10:12:00", uri="track:4", platform="web")]
    assert _sessions(spark, rows).first().primary_device == "web"
    assert _sessions(spark, rows[:3]).first().primary_device is None
    assert _sessions(spark, rows[1:3]).first().primary_device == "ios"
