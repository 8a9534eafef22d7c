"""Rows without an account or a time, large numbers, NULL ties, the command
line on plain files, and the submitter's settings."""
import json
import os
import subprocess
import sys

from pyspark.sql import functions as F

from encore.config import DEFAULT, GLOBAL
from encore.functions import rounding as R
from encore.operators.carry import sessionize, sessionize_window
from encore.operators.shares import join_on_keys
from encore.plans.registry import null_accounts
from encore.plans.stages import Stages
from encore.schemas import PLAY_ORDER
from encore.sources.plays import raw_from_events
from tests.conftest import SF_SMALL

COLS = ["account_id", *PLAY_ORDER, "seconds_since_last_play", "new_session_flag", "session_id"]


def test_carry_with_null_accounts_and_times(spark):
    raw = null_accounts(raw_from_events(spark, SF_SMALL))
    plays = Stages(spark, cfg=DEFAULT, raw=raw).silver
    holes = plays.withColumn("play_start_MST", F.when(F.pmod(F.xxhash64(*PLAY_ORDER), F.lit(9)) > 0, F.col("play_start_MST")))
    for df in (plays, holes):
        for unit in ("day", "minute"):
            cfg = DEFAULT.with_(carry_bucket=unit)
            got, want = sessionize(df, cfg, PLAY_ORDER).select(COLS), sessionize_window(df, cfg, PLAY_ORDER).select(COLS)
            assert got.count() == df.count()
            assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_plays_are_shuffled_once(spark, tmp_path):
    """Without broadcasts: one scan, one exchange of the plays that both branches read,
    and no second one for the join; only the summary moves besides."""
    Stages(spark, SF_SMALL, DEFAULT).silver.write.parquet(str(tmp_path / "silver"))
    plays = spark.read.parquet(str(tmp_path / "silver"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for cfg in (DEFAULT, GLOBAL, DEFAULT.with_(carry_bucket="hour")):
            out = sessionize(plays, cfg, PLAY_ORDER)
            out.collect()
            plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            lines = [x.strip(" :+-|") for x in plan.splitlines()]
            assert sum("FileScan" in x for x in lines) == 1, plan
            exchanges = [x for x in lines if x.startswith("Exchange")]
            # of the plays, of the summary by key, of the summary to the join
            assert len(exchanges) == 3 and sum(x.startswith("ReusedExchange") for x in lines) == 1, plan
            assert "SortMergeJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_per_key_join_keeps_null_keys(spark):
    a = spark.createDataFrame([(1, 2), (None, 3)], "account_id long, x long")
    b = spark.createDataFrame([(1, 4), (None, 5)], "account_id long, y long")
    got = sorted(map(tuple, join_on_keys(a, b, ["account_id"]).collect()), key=str)
    assert got == [(1, 2, 4), (None, 3, 5)]


def test_rounding_of_large_numbers(spark):
    rows = [(50_000_000_000_000_000, 1_000_000_000_000), (10**18, 7), (-(10**18), 7), (10**18 + 1, 10**18), (5, 0), (None, 3)]
    got = [r[0] for r in spark.createDataFrame(rows, "a long, b long").select(R.rround("a", "b", 2)).collect()]
    assert got[0] == 50000.0 and abs(got[1] - 10**18 / 7) < 200 and got[2] == -got[1] and got[3:] == [1.0, None, None]
    whole = spark.createDataFrame([(4 * 10**17, 8 * 10**17)], "a long, b long").select(R.pct("a", "b")).first()[0]
    assert whole == 50.0


def test_session_settings_of_the_submitter_survive():
    code = ("from encore.spark import build_session; s = build_session('local[2]'); "
            "print('GOT', s.conf.get('spark.sql.shuffle.partitions'), s.sparkContext.getConf().get('spark.driver.memory'))")
    env = {**os.environ, "PYSPARK_SUBMIT_ARGS": "--driver-memory 1g --conf spark.sql.shuffle.partitions=400 pyspark-shell"}
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, env=env, capture_output=True, text=True, timeout=120)
    assert "GOT 400 1g" in out.stdout, out.stdout + out.stderr[-800:]


def test_command_line_on_plain_files(spark, tmp_path):
    """No account anywhere: one account, or one timeline without a key."""
    from encore.__main__ import main
    files = tmp_path / "in"
    files.mkdir()
    for k in range(3):
        recs = [{"ts": f"2022-01-0{k + 1}T10:{i:02d}:00Z", "ms_played": 50000, "platform": "ios",
                 "master_metadata_track_name": f"s{i}", "master_metadata_album_artist_name": "a",
                 "spotify_track_uri": f"track:{k}-{i}"} for i in range(9)]
        (files / f"h{k}.json").write_text(json.dumps(recs))
    (files / "bad.json").write_text("{}")
    for flag in ([], ["--global"]):
        out = str(tmp_path / f"out{len(flag)}")
        assert main(["run", str(files), out, *flag]) == 0
        assert spark.read.parquet(f"{out}/tables/sessions").count() == 3
        assert spark.read.parquet(f"{out}/reports/ingest").count() == 4
        assert spark.read.parquet(f"{out}/reports/quarantine").count() == 1
        assert spark.read.parquet(f"{out}/reports/eda_gap_buckets").count() > 0


def test_stream_step_never_uses_an_id_twice():
    import pandas as pd

    from encore.streaming.incremental import make_step

    class State:
        exists, hasTimedOut, get = False, False, None

        def update(self, v):
            self.exists, self.get = True, v

        def setTimeoutTimestamp(self, t):
            pass

        def getCurrentWatermarkMs(self):
            return 0

    def play(t):
        t = pd.Timestamp(t)
        return pd.DataFrame([{"account_id": 1, "play_start_MST": t, "play_end_MST": t + pd.Timedelta(minutes=1), "track_uri": "u",
                              "ms_played": 60000, "artist_name": "a", "album_name": "b", "device": "d", "_min_c": 100, "_shuffle_b": False,
                              "_skip_b": False, "_complete_b": True, "_offline_b": False, "_ev": int(t.value // 10**6)}])

    step, state, ids = make_step(DEFAULT), State(), []
    for day in ("2022-01-01", "2022-01-03", "2022-01-05"):
        list(step((1,), [play(f"{day} 10:00:00")], state))
        state.hasTimedOut = True
        ids += [i for out in step((1,), [], state) for i in out["session_id"]]
        state.hasTimedOut = False
    assert ids == [1, 2, 3]
