"""Sketches against exact figures, on groups larger than the sketches."""
from pyspark.sql import functions as F

from encore.config import DEFAULT
from encore.plans import sketches as K
from encore.plans.stages import Stages


def test_distinct_of_many_days(spark):
    days = spark.range(200_000).select(
        F.lit(1).cast("long").alias("account_id"), F.date_add(F.lit("2021-01-01").cast("date"), (F.col("id") % 700).cast("int")).alias("play_date"),
        F.concat(F.lit("a"), F.pmod(F.xxhash64("id"), F.lit(30_000))).alias("artist_name"), F.col("id").cast("string").alias("track_name"))
    silver = days.withColumn("play_year", F.year("play_date").cast("long"))
    rows = K.distinct_by_year(Stages(spark, cfg=DEFAULT, raw=silver, silver=silver)).collect()
    assert len(rows) == 2 and all(r.artists_in_bound and r.tracks_in_bound and r.unique_tracks > 90_000 for r in rows)
    assert sum(r.plays for r in rows) == 200_000
    whole = K.distinct_in(K.daily_distinct(Stages(spark, cfg=DEFAULT, raw=silver, silver=silver)), ["account_id"]).first()
    assert abs(whole.approx_tracks - 200_000) <= 200_000 * K.DISTINCT_ERROR and whole.approx_tracks != 200_000


def test_quantiles_of_merged_months(spark):
    measures = {c: F.round(F.rand(i) * 100, 2) for i, (c, _) in enumerate(K.QUANTILE_METRICS)}
    sessions = spark.range(40_000).select(
        F.when(F.col("id") % 2 == 0, 1).cast("long").alias("account_id"), F.lit(2021).cast("long").alias("session_year"),
        (F.col("id") % 12).cast("long").alias("session_month"), *[c.alias(n) for n, c in measures.items()]).cache()
    rows = K.quantiles_in_bound(Stages(spark, cfg=DEFAULT, raw=sessions, sessions=sessions)).collect()
    assert len(rows) == 2 * 5 * 5 and all(r.in_bound for r in rows) and {r["values"] for r in rows} == {20_000}
    assert {r.account_id for r in rows} == {1, None}
