"""Session edges from FIXTURES.md section 4 and properties of the carry."""
import datetime as dt
import random

from pyspark.sql import functions as F

from encore.config import DEFAULT, GLOBAL
from encore.operators.carry import sessionize, sessionize_window
from encore.schemas import PLAY_ORDER

T0 = dt.datetime(2024, 3, 1, 22, 0, 0)  # late evening: the chain crosses midnight
EDGES = [  # start, end offsets (s), expected session id
    (0, 200, 1), (2000, 2100, 1), (3901, 4000, 2), (4001, 9000, 2), (7200, 7300, 2),
    (7301, 12000, 2), (10199, 10300, 3), (12200, 12300, 4)]


def _plays(spark, accounts=(1,), shuffle=False):
    rows = []
    for a in accounts:
        for i, (s, e, _) in enumerate(EDGES):
            rows.append((a, T0 + dt.timedelta(seconds=s), T0 + dt.timedelta(seconds=e), f"track:{i}",
                         (e - s) * 1000, i))
    if shuffle:
        random.Random(7).shuffle(rows)
    return spark.createDataFrame(rows, "account_id long, play_start_MST timestamp_ntz, "
                                       "play_end_MST timestamp_ntz, track_uri string, ms_played long, row int")


def _ids(df):
    return [r.session_id for r in df.orderBy("account_id", "row").collect()]


def test_edges_match_expected(spark):
    for cfg in (DEFAULT, DEFAULT.with_(carry_bucket="hour"), DEFAULT.with_(carry_bucket="minute")):
        out = sessionize(_plays(spark), cfg, PLAY_ORDER)
        assert _ids(out) == [e[2] for e in EDGES]


def test_gap_limit_semantics(spark):
    out = sessionize(_plays(spark), DEFAULT, PLAY_ORDER).orderBy("row").collect()
    gaps = [r.seconds_since_last_play for r in out]
    assert gaps == [None, 1800, 1801, 1, -1800, 1, -1801, 1900]
    assert [r.new_session_flag for r in out] == [1, 0, 1, 0, 0, 0, 1, 1]


def test_accounts_independent_and_order_free(spark):
    out = sessionize(_plays(spark, accounts=(1, 2), shuffle=True), DEFAULT, PLAY_ORDER)
    want = [e[2] for e in EDGES]
    assert _ids(out) == want + want


def test_carry_equals_window_on_data(spark):
    from encore.plans.stages import Stages
    from tests.conftest import SF_MID
    for cfg in (DEFAULT, GLOBAL, DEFAULT.with_(carry_bucket="hour"),
                GLOBAL.with_(carry_bucket="minute")):
        silver = Stages(spark, SF_MID, cfg).silver
        a = sessionize(silver, cfg, PLAY_ORDER)
        b = sessionize_window(silver, cfg, PLAY_ORDER)
        cols = list(cfg.keys) + PLAY_ORDER + ["seconds_since_last_play", "new_session_flag", "session_id"]
        assert a.select(*cols).exceptAll(b.select(*cols)).count() == 0
        assert b.select(*cols).exceptAll(a.select(*cols)).count() == 0


def test_session_ids_contiguous_and_complete(spark):
    from encore.plans.stages import Stages
    from tests.conftest import SF_MID
    st = Stages(spark, SF_MID, DEFAULT)
    per = st.plays_sid.groupBy("account_id").agg(
        F.min("session_id").alias("lo"), F.max("session_id").alias("hi"),
        F.countDistinct("session_id").alias("n")).collect()
    for r in per:
        assert r.lo == 1 and r.hi == r.n
    assert st.sessions.agg(F.sum("tracks_played")).first()[0] == st.silver.count()
