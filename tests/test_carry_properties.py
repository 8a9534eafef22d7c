"""Property: the bucketed carry equals the plain window, on random timelines."""
import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from encore.config import DEFAULT, GLOBAL
from encore.operators.carry import lag_carry, lag_carry_where, sessionize, sessionize_window
from encore.schemas import PLAY_ORDER

T0 = dt.datetime(2023, 3, 1, 0, 0, 0)
# a play: account, start offset (s), duration (s); offsets span a few days with big and small gaps
PLAY = st.tuples(st.integers(0, 2), st.integers(0, 4 * 86400), st.integers(1, 4000))


def _df(spark, plays):
    rows = [(a, T0 + dt.timedelta(seconds=s), T0 + dt.timedelta(seconds=s + d), f"track:{i % 7}", d * 1000, "dev" + str(i % 3))
            for i, (a, s, d) in enumerate(plays)]
    return spark.createDataFrame(rows, "account_id long, play_start_MST timestamp_ntz, play_end_MST timestamp_ntz, "
                                       "track_uri string, ms_played long, device string")


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(plays=st.lists(PLAY, min_size=1, max_size=60), unit=st.sampled_from(["day", "hour", "minute"]),
       keyed=st.booleans())
def test_sessionize_equals_window(spark, plays, unit, keyed):
    base = DEFAULT if keyed else GLOBAL
    cfg = base.with_(carry_bucket=unit)
    df = _df(spark, plays)
    if not keyed:
        df = df.drop("account_id")
    cols = list(cfg.keys) + PLAY_ORDER + ["seconds_since_last_play", "new_session_flag", "session_id"]
    assert _same(sessionize(df, cfg, PLAY_ORDER).select(cols), sessionize_window(df, cfg, PLAY_ORDER).select(cols))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(plays=st.lists(PLAY, min_size=1, max_size=60), unit=st.sampled_from(["day", "hour", "minute"]))
def test_lag_carry_equals_lag(spark, plays, unit):
    cfg = DEFAULT.with_(carry_bucket=unit)
    df = _df(spark, plays)
    w = Window.partitionBy("account_id").orderBy(*PLAY_ORDER)
    want = df.withColumn("prev_play_end_MST", F.lag("play_end_MST").over(w)).withColumn(
        "prev_device", F.lag("device").over(w))
    got = lag_carry(df, ["account_id"], PLAY_ORDER, ["play_end_MST", "device"], cfg)
    assert _same(got.select(want.columns), want)
    # LAG over the rows passing a condition, for two conditions in one pass
    conds = {"long": F.col("ms_played") >= 2000000, "all": F.lit(True)}
    got2 = lag_carry_where(df, ["account_id"], PLAY_ORDER, ["play_end_MST"], conds, cfg)
    longs = df.filter(F.col("ms_played") >= 2000000).withColumn("p", F.lag("play_end_MST").over(w))
    g = got2.filter(F.col("ms_played") >= 2000000).select(*df.columns, F.col("prev_long.play_end_MST").alias("p"))
    assert _same(g, longs)
    a = got2.select(*df.columns, F.col("prev_all.play_end_MST").alias("p"))
    assert _same(a, want.select(*df.columns, F.col("prev_play_end_MST").alias("p")))
