"""Mixing sources to target weights.

Sizes (words) are summed per source; the weights share out a number of words;
a source gets at most `max_repeat` times its own size, and what it can't take
goes to the others by their weights. A source's rate is target / size: each of
its documents is taken floor(rate) times, and once more when its hash-seeded
draw falls below the fraction, so a rerun takes the same documents.

The draw is seeded by the id, the text and, among rows that agree in id, source and text,
the row's number, so null and repeated ids do not go together. Such rows are found
by one aggregate of digests, and only they are numbered, by ranges of their order.

Cases: a null or empty text has size 0, whatever its length it is only counted; a null
source is a source, sorted last; sources of size 0 and empty tables have target 0;
equal rows each have a draw; ties of the filling order go by name. Columns of the
input are kept whatever their names. Everything is built-in expressions: aggregates with
partial sums, so a source with most rows is no single task's work; the plan, a row
per source, is one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.llm.common import cut, free_name
from encore.operators.ranking import with_position

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
#: The plan has a row per source; up to so many rows it is broadcast, beyond that joined by shuffle.
BROADCAST_SOURCES = 100_000
#: Groups of rows that agree in id, source and text: beyond so many they are joined by shuffle.
BROADCAST_GROUPS = 100_000


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(df: DataFrame, source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS,
            share: float = 1.0, max_repeat: int = 3) -> DataFrame:
    """source, source_size, target and rate; one row per source. The windows run
    over these rows only."""
    per = df.select(F.col(source).alias("source"), size_of(text).alias("s")) \
        .groupBy("source").agg(F.sum("s").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("rank", F.row_number().over(by_name)) \
        .withColumn("weight", weight.cast("double")) \
        .withColumn("cap", (F.lit(max_repeat) * F.col("source_size")).cast("double")) \
        .withColumn("total", (F.sum("source_size").over(Window.partitionBy())).cast("double") * F.lit(share))
    # the sources that are small for their weight are filled first
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    later = filling.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("before", F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) \
        .withColumn("rest", F.sum("weight").over(later)) \
        .withColumn("full", F.col("cap") * F.col("rest") <= (F.col("total") - F.col("before")) * F.col("weight"))
    whole = Window.partitionBy()
    given = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(whole)
    open_ = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(whole)
    level = F.when(open_ > 0, (F.col("total") - given) / open_).otherwise(0.0)
    per = per.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.least(level * F.col("weight"), F.col("cap"))))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeat)))).otherwise(0.0)
    return per.select("source", "source_size", "target", rate.alias("rate"))


def _digest(text: str) -> Column:
    return F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary"))


def draw(doc_id: str, text: str, number: Column, seed: str) -> Column:
    """52 bits of an MD5 as a number in [0, 1)."""
    name = F.concat_ws(":", F.lit(seed), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), _digest(text), number.cast("string"))
    bits = F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double")
    return bits / F.lit(float(1 << 52))


def numbered(df: DataFrame, name: str, doc_id: str, source: str, text: str) -> DataFrame:
    """`df` and the number of each row among those of equal id, source and text."""
    digest = free_name(df, "digest")
    rows = df.withColumn(digest, _digest(text))
    key = [doc_id, source, digest]
    again = cut(rows.groupBy(*[F.col(f"`{c}`") for c in key]).count().filter("count > 1").drop("count").toDF("k0", "k1", "k2"))
    n = again.count()
    if not n:
        return df.withColumn(name, F.lit(1).cast("long"))
    if n <= BROADCAST_GROUPS:
        again = F.broadcast(again)
    same = (rows[digest] == again["k2"]) & rows[f"`{doc_id}`"].eqNullSafe(again["k0"]) & rows[f"`{source}`"].eqNullSafe(again["k1"])
    every = [F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns])]
    repeated = with_position(rows.join(again, same, "left_semi"), every, key, name)
    return rows.join(again, same, "left_anti").withColumn(name, F.lit(1).cast("long")).unionByName(repeated).drop(digest)


def plan(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: str = "mix",
         **params) -> DataFrame:
    """All columns of `df` and a struct `mix` (or `_mix`...) with size,
    source_size, target, copies."""
    per = cut(targets(df, source, text, **params))
    name = free_name(df, "mix")
    per = per.select(F.struct("*").alias(name))
    if per.count() <= BROADCAST_SOURCES:
        per = F.broadcast(per)
    own, number = F.col(f"`{name}`"), free_name(df, "number")
    rows = numbered(df, number, doc_id, source, text)
    joined = rows.join(per, F.col(f"`{source}`").eqNullSafe(own["source"]), "left")
    drawn = draw(doc_id, text, F.col(number), seed)
    copies = F.floor(own["rate"]) + (drawn < own["rate"] - F.floor(own["rate"])).cast("long")
    return joined.withColumn(name, F.struct(size_of(text).alias("size"), own["source_size"].alias("source_size"),
                                            own["target"].alias("target"), copies.cast("long").alias("copies"))).drop(number)


def emit(planned: DataFrame) -> DataFrame:
    """Every document as often as the plan says, with its copy number."""
    name = planned.columns[-1]
    number = free_name(planned, "copy")
    return planned.filter(F.col(name)["copies"] > 0) \
        .withColumn(number, F.explode(F.sequence(F.lit(1), F.col(name)["copies"].cast("int")))).drop(name)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, md5(COALESCE(text, '')) AS digest, row_number() OVER (PARTITION BY doc_id, source, text) AS number, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, CAST((rank - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS cap,
             CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM r),
f AS (SELECT *, COALESCE(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
g AS (SELECT *, cap * rest <= (total - before) * weight AS filled FROM f),
l AS (SELECT *, (total - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ())
               / NULLIF(sum(CASE WHEN filled THEN 0 ELSE weight END) OVER (), 0) AS level FROM g),
t AS (SELECT source, source_size, CASE WHEN filled THEN cap ELSE least(COALESCE(level, 0) * weight, cap) END AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0.0 END AS rate FROM t)
SELECT doc_id, size, source_size, target,
       size * CAST(floor(rate) + CASE WHEN CAST(('0x' || substr(md5('mix:' || COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || digest || ':' || number), 1, 13)) AS BIGINT)
                                           / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
"""
