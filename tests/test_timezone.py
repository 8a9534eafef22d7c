"""Results do not depend on the session time zone (clusters need not run in UTC)."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from encore.functions.timeutil import trunc_ntz
from tests.conftest import SF_MID

NAMES = ["silver_clean", "plays_with_session_id", "sessions", "eda_by_weekday", "eda_gap_buckets",
         "eda_impossible_values", "view_artist_stats", "dq_silver_overlaps"]


@pytest.fixture
def new_york(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_trunc_in_dst_gap(new_york):
    r = new_york.sql("SELECT timestamp_ntz'2024-03-10 02:30:07.5' AS t").select(
        trunc_ntz(F.col("t"), "SECOND").alias("s"), trunc_ntz(F.col("t"), "MINUTE").alias("m"),
        trunc_ntz(F.col("t"), "HOUR").alias("h")).first()
    assert (r.s, r.m, r.h) == (dt.datetime(2024, 3, 10, 2, 30, 7), dt.datetime(2024, 3, 10, 2, 30),
                               dt.datetime(2024, 3, 10, 2, 0))


def test_queries_same_in_any_session_zone(spark):
    qs = E.queries()
    utc = {n: sorted(map(tuple, qs[n](spark, SF_MID).collect()), key=repr) for n in NAMES}
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for n in NAMES:
            got = sorted(map(tuple, qs[n](spark, SF_MID).collect()), key=repr)
            assert got == utc[n], n
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
