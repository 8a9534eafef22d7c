"""Silver edges from FIXTURES.md section 4."""
import datetime as dt

from encore.config import DEFAULT
from encore.operators.silver import silver
from encore.schemas import RAW, RAW_COLUMNS


def raw_row(ts, ms=200000, uri="track:1", track="Song", platform="ios", **kw):
    r = {c: None for c in RAW_COLUMNS}
    r.update(account_id=1, ts=dt.datetime.fromisoformat(ts), ms_played=ms, platform=platform,
             master_metadata_track_name=track, master_metadata_album_artist_name="Artist",
             master_metadata_album_album_name="Album", spotify_track_uri=uri, shuffle=True,
             skipped=False, offline=False, incognito_mode=False, reason_start="clickrow",
             reason_end="trackdone")
    r.update(kw)
    return tuple(r[c] for c in RAW_COLUMNS)


def run(spark, rows):
    return silver(spark.createDataFrame(rows, RAW), DEFAULT)


def test_min_ms_and_completion(spark):
    rows = [raw_row(f"2022-01-01T10:00:{i:02d}", ms=ms, uri=f"track:{i}")
            for i, ms in enumerate([999, 1000, 29999, 30000, 149999, 150000])]
    out = {r.ms_played: r.completion_category for r in run(spark, rows).collect()}
    assert 999 not in out
    assert [out[m] for m in (1000, 29999, 30000, 149999, 150000)] == [
        "Skipped (<30s)", "Skipped (<30s)", "Partial (30s-2.5m)", "Partial (30s-2.5m)", "Complete (>2.5m)"]


def test_date_filters(spark):
    ts = ["2013-09-22T23:59:59", "2013-09-23T00:00:00", "2020-12-06T23:59:59", "2020-12-07T00:00:00",
          "2020-12-08T23:59:59", "2020-12-09T00:00:00"]
    rows = [raw_row(t, uri=f"track:{i}") for i, t in enumerate(ts)]
    kept = sorted(r.track_uri for r in run(spark, rows).collect())
    assert kept == ["track:1", "track:2", "track:5"]


def test_podcasts_and_missing_dropped(spark):
    rows = [raw_row("2022-01-01T10:00:00", uri="track:1", episode_show_name="show"),
            raw_row("2022-01-01T10:00:01", uri="track:2", track=None),
            raw_row("2022-01-01T10:00:02", uri=None),
            raw_row("2022-01-01T10:00:03", uri="track:4")]
    assert [r.track_uri for r in run(spark, rows).collect()] == ["track:4"]


def test_dedup_deterministic(spark):
    rows = [raw_row("2022-01-01T10:00:00", platform="web"), raw_row("2022-01-01T10:00:00", platform="android"),
            raw_row("2022-01-01T10:00:00", platform=None),
            raw_row("2022-01-01T11:00:00", ms=100000), raw_row("2022-01-01T11:00:00", ms=100001)]
    out = run(spark, rows).collect()
    assert len(out) == 3
    first = [r for r in out if r.ms_played == 200000]
    assert len(first) == 1 and first[0].device is None  # smallest record wins, NULL first


def test_local_clock_and_start(spark):
    rows = [raw_row("2020-07-01T12:00:00", uri="track:a"), raw_row("2024-07-01T12:00:00", uri="track:b"),
            raw_row("2020-01-01T00:00:02", ms=1500, uri="track:c")]
    out = {r.track_uri: r for r in run(spark, rows).collect()}
    assert out["track:a"].play_end_MST == dt.datetime(2020, 7, 1, 6, 0, 0)
    assert out["track:b"].play_end_MST == dt.datetime(2024, 7, 1, 5, 0, 0)
    c = out["track:c"]
    assert c.play_end_MST == dt.datetime(2019, 12, 31, 17, 0, 2)
    assert c.play_start_MST == dt.datetime(2019, 12, 31, 17, 0, 0)
    assert (c.play_date, c.play_year, c.play_day_week, c.time_of_day) == (dt.date(2019, 12, 31), 2019, "Tuesday", "Afternoon")
    assert (c.seconds_played, c.minutes_played, c.hours_played) == (1.5, 0.03, 0.0)
