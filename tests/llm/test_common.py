from pyspark.sql import functions as F

from encore.llm.common import bounded_sample, cut, once
from tests.llm.helpers import settled, shuffles


def test_all_rows_where_they_are_few(spark):
    df = spark.range(50).withColumn("k", F.col("id") % 2)
    assert bounded_sample(df, ["id"], 50, 1, by="k").count() == 50
    assert bounded_sample(df.limit(0), ["id"], 50, 1, by="k").count() == 0


def test_bound_and_reruns(spark):
    df = spark.range(20_000)
    got = {r.id for r in bounded_sample(df, ["id"], 1000, 1).collect()}
    assert 800 < len(got) < 1200
    assert got == {r.id for r in bounded_sample(df.repartition(7), ["id"], 1000, 1).collect()}
    assert got != {r.id for r in bounded_sample(df, ["id"], 1000, 2).collect()}


def test_rare_values_have_rows(spark):
    df = spark.range(20_000).withColumn("k", F.when(F.col("id") % 1000 == 0, "rare").when(F.col("id") % 3 > 0, "usual"))
    got = {r.k: r["count"] for r in bounded_sample(df, ["id"], 1000, 1, by="k").groupBy("k").count().collect()}
    assert got["rare"] == 20 and 500 < got["usual"] < 800 and 250 < got[None] < 420


def test_hot_null_and_repeated_ids(spark):
    """A third of the rows without an id, a third with one: both in part, equal rows once."""
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")).alias("doc_id"),
                                  (F.col("id") % 4500).cast("string").alias("text"))
    kinds = F.when(F.col("doc_id").isNull(), "null").when(F.col("doc_id") == 7, "one").otherwise("many")
    got = {r.kind: r["count"] for r in bounded_sample(df, ["doc_id", "text"], 900, 1).groupBy(kinds.alias("kind")).count().collect()}
    assert set(got) == {"null", "one", "many"} and sum(got.values()) < 1200 and min(got.values()) > 100


def test_a_finished_step_keeps_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(key), shuffles(spark)
    df = spark.range(2000).groupBy((F.col("id") % 700).alias("k")).count()
    step = cut(df)
    assert len(once(df).collect()) == 700
    assert settled(lambda: shuffles(spark) <= before)
    assert spark.conf.get(key) == setting
    # what was cut can be read again, and so can the frame itself, whose files then stay
    assert {step.count(), step.count(), len(df.collect()), len(df.collect())} == {700}
    assert not shuffles(spark) <= before
