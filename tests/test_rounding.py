import duckdb
from pyspark.sql import functions as F

from encore.functions import rounding as R


def test_half_away_from_zero_exact(spark):
    rows = [(1005, 1000, 2, 1.01), (1, 40, 2, 0.03), (-1, 40, 2, -0.03), (5, 10, 0, 1.0),
            (-5, 10, 0, -1.0), (1, 3, 2, 0.33), (2, 3, 2, 0.67), (7, 0, 2, None), (0, 5, 2, 0.0)]
    df = spark.createDataFrame([r[:3] for r in rows], "n long, d long, k int")
    got = [df.filter((F.col("n") == n) & (F.col("d") == d)).select(R.rround(F.col("n"), F.col("d"), k)).first()[0]
           for n, d, k, _ in rows]
    assert got == [r[3] for r in rows]
    con = duckdb.connect()
    for n, d, k, want in rows:
        assert con.execute(f"SELECT {R.sql_rround(str(n), str(d), k)}").fetchone()[0] == want


def test_duration_units(spark):
    # FIXTURES: ms 1005 -> 1.01 s; 300 -> 0.01 min; 18000 -> 0.01 h
    r = spark.createDataFrame([(1005, 300, 18000)], "a long, b long, c long").select(
        R.from_cents(R.seconds_c(F.col("a"))), R.from_cents(R.minutes_c(F.col("b"))),
        R.from_cents(R.hours_c(F.col("c")))).first()
    assert tuple(r) == (1.01, 0.01, 0.01)


def test_to_cents_roundtrip(spark):
    vals = [k / 100.0 for k in range(0, 20001, 7)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(R.to_cents(F.col("x"))).collect()]
    assert got == list(range(0, 20001, 7))
