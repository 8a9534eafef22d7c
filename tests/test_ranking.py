"""Positions and tiles against plain windows."""
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from encore.operators.ranking import with_position, with_tile


@pytest.fixture(scope="module")
def rows(spark):
    data = [(None if i % 7 == 0 else i % 3, (i * 37) % 50, i) for i in range(500)]
    return spark.createDataFrame(data, "k int, v long, id long").repartition(7)


@pytest.mark.parametrize("keys", [(), ("k",)])
@pytest.mark.parametrize("tiles", [1, 4, 7, 600])
def test_matches_window(rows, keys, tiles):
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(F.desc("v"), "id")
    want = {r.id: (r.p, r.t) for r in rows.withColumns({"p": F.row_number().over(w), "t": F.ntile(tiles).over(w)}).collect()}
    x = with_tile(rows, [F.desc("v"), "id"], keys, tiles, "t")
    got = {r.id: (r.p, r.t) for r in with_position(x, [F.desc("v"), "id"], keys, "p").collect()}
    assert got == want


def test_ties_are_spread_and_numbered_once(spark):
    same = spark.range(1000).select(F.lit(1).alias("v"), F.lit(None).cast("int").alias("k")).repartition(5)
    got = with_position(same, ["v"], ("k",), "p", "n")
    assert sorted(r.p for r in got.collect()) == list(range(1, 1001)) and got.first().n == 1000


def test_no_window_holds_the_table(rows):
    plan = with_position(rows, ["v"], (), "p")._jdf.queryExecution().executedPlan().toString()
    assert "Scan" in plan and "__before" in plan
    assert with_position(rows.limit(0), ["v"], ("k",), "p").count() == 0
