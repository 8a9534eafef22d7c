"""JSON-array files of any size, split over tasks.

`ingest` loads a file as one value, which must fit in a task. Here a file is
read as text that ends at each `}`, so Spark splits it like lines and no value
is longer than a record. A piece that is an object after its comma (or the file's `[`)
is a record, parsed where it was read, without order or shuffle: inside a string no
piece can be one, as quotes there are escaped. What is left, `}` inside strings and
nested objects, is rare: only these pieces go by file, are joined where they follow
each other, and parsed as the records they make. (So a stretch of neighbouring records
that all have a `}` inside is the largest value.)

A file is valid as a whole, as with `ingest`: its first piece opens the array, every
record but the first follows a comma, and after the last one the array is closed and
nothing comes. Files that are not give no rows, and their status.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from encore.sources.ingest import (
    EMPTY, INVALID, NO_RECORDS, NOT_ARRAY, OK, _TEXT_RECORD, IngestResult, _bad_values, _listed, _norm_col, _typed,
)

_STRUCT = _TEXT_RECORD.elementType
_START, _NEXT, _END, _ODD = "start", "next", "end", "odd"


def pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """source_file, block (where the split begins), place (within the read) and value."""
    text = spark.read.option("lineSep", "}").text(paths)
    return text.select(_norm_col(F.col("_metadata.file_path")).alias("source_file"),
                       F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("place"), "value")


def _object(value: F.Column) -> F.Column:
    """The piece without what stands before its object, closed again."""
    return F.concat(F.regexp_replace(value, r"^\s*[\[,]?\s*", ""), F.lit("}"))


def _parsed(value: F.Column) -> F.Column:
    """A record, where the piece is one with at least a field; else NULL. The frame shows
    that nothing stands after the object."""
    text = _object(value)
    frame = F.from_json(F.concat(F.lit("["), text, F.lit(',"."]')), "array<string>")
    whole = (F.size(frame) == 2) & (F.try_element_at(frame, F.lit(2)) == ".")
    return F.when(text.rlike(r'^\{\s*"') & whole, F.from_json(text, _STRUCT))


def _kind(value: F.Column, record: F.Column) -> F.Column:
    lead = F.regexp_extract(value, r"^\s*([\[,]?)", 1)
    return (F.when(record.isNotNull() & (lead == "["), _START).when(record.isNotNull() & (lead == ","), _NEXT)
            .when(value.rlike(r"^\s*\]\s*$"), _END).otherwise(_ODD))


def _joined(odd: DataFrame, blocks: DataFrame) -> DataFrame:
    """Neighbouring odd pieces as one: source_file, kind, records (NULL if they are none).
    `blocks` has the first and last place of each block."""
    of_file = Window.partitionBy("source_file").orderBy("block")
    last = blocks.withColumn("before", F.lag("last").over(of_file)).select("source_file", "block", F.col("first"), "before")
    x = odd.join(last, ["source_file", "block"])
    w = Window.partitionBy("source_file").orderBy("block", "place")
    earlier = F.lag("place").over(w)
    follows = (earlier == F.col("place") - 1) & (F.lag("block").over(w) == F.col("block")) \
        | (F.col("place") == F.col("first")) & (earlier == F.col("before"))
    x = x.withColumn("_new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1))
    x = x.withColumn("_group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = x.groupBy("source_file", "_group").agg(
        F.array_sort(F.collect_list(F.struct("block", "place", "value"))).alias("parts"))
    value = F.array_join(F.transform("parts", lambda p: p["value"]), "}")
    # the array may be closed in the last of them
    closed = value.rlike(r"\}\s*\]\s*$")
    body = F.regexp_replace(value, r"^\s*[\[,]\s*", "")
    text = F.when(closed, F.concat(F.lit("["), body)).otherwise(F.concat(F.lit("["), body, F.lit("}]")))
    frame = F.from_json(F.concat(F.lit("["), text, F.lit(',"."]')), "array<string>")
    whole = (F.size(frame) == 2) & (F.try_element_at(frame, F.lit(2)) == ".")
    lead = F.regexp_extract(value, r"^\s*([\[,]?)", 1)
    return g.select(
        "source_file", F.element_at("parts", 1)["block"].alias("block"), F.element_at("parts", 1)["place"].alias("place"),
        F.element_at("parts", -1)["block"].alias("last_block"), F.element_at("parts", -1)["place"].alias("last_place"),
        lead.alias("lead"), closed.alias("closed"), F.when(whole, F.from_json(text, _TEXT_RECORD)).alias("records"), value.alias("value"))


def ingest_split(spark: SparkSession, files: list[str] | str, store: str, account_id: int | None = None,
                 pattern: str = "*.json") -> IngestResult:
    """The result of `ingest` for files that are too large for one task each. `store`:
    a folder for the parsed records, written once."""
    paths, listed = _listed(spark, files, pattern)
    read = pieces(spark, paths).withColumn("r", _parsed(F.col("value")))
    read = read.withColumn("kind", _kind(F.col("value"), F.col("r")))
    kept = read.select("source_file", "block", "place", "kind", "r", F.when(F.col("kind") == _ODD, F.col("value")).alias("value"),
                       F.length("value").cast("long").alias("size"))
    kept.write.mode("overwrite").parquet(f"{store}/pieces")
    kept = spark.read.schema(kept.schema).parquet(f"{store}/pieces")
    blocks = kept.groupBy("source_file", "block").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    odd = _joined(kept.filter(F.col("kind") == _ODD).select("source_file", "block", "place", "value"), blocks)
    odd.write.mode("overwrite").parquet(f"{store}/joined")
    odd = spark.read.schema(odd.schema).parquet(f"{store}/joined")

    # one row per file: what comes first and last, and what stands between
    plain = kept.filter(F.col("kind") != _ODD).select(
        "source_file", F.struct("block", "place").alias("from"), F.struct("block", "place").alias("to"),
        (F.col("kind") == _START).alias("opens"), (F.col("kind") == _END).alias("closes"), F.lit(True).alias("good"), F.lit(None).cast("string").alias("value"))
    rest = odd.select(
        "source_file", F.struct("block", "place").alias("from"), F.struct(F.col("last_block").alias("block"), F.col("last_place").alias("place")).alias("to"),
        (F.col("lead") == "[").alias("opens"), F.col("closed").alias("closes"),
        (F.col("records").isNotNull() & F.col("lead").isin("[", ",")).alias("good"), F.substring("value", 1, 1000).alias("value"))
    every = plain.unionByName(rest)
    per = every.groupBy("source_file").agg(
        F.min_by("opens", "from").alias("first_opens"), F.count_if("opens").alias("opens"), F.max_by("closes", "to").alias("last_closes"),
        F.count_if("closes").alias("closes"), F.bool_and("good").alias("good"), F.count(F.lit(1)).alias("n"), F.min_by("value", "from").alias("head"))
    sizes = kept.groupBy("source_file").agg(F.sum(F.col("size") + 1).alias("size_chars"))
    body = F.regexp_replace("head", r"^\s+", "")
    whole = F.col("first_opens") & (F.col("opens") == 1) & F.col("last_closes") & (F.col("closes") == 1) & F.col("good")
    status = (F.when(whole, OK).when((F.col("n") == 1) & body.rlike(r"^\[\s*\]\s*$"), NO_RECORDS).when((F.col("n") == 1) & (body == ""), EMPTY)
              .when(body.isNotNull() & ~body.startswith("["), NOT_ARRAY).when(body.isNull() & ~F.col("first_opens"), NOT_ARRAY).otherwise(INVALID))
    state = per.select("source_file", status.alias("status")).join(sizes, "source_file")
    state.write.mode("overwrite").parquet(f"{store}/files")
    state = spark.read.schema(state.schema).parquet(f"{store}/files")

    records = kept.filter(F.col("r").isNotNull()).select("source_file", "r") \
        .unionByName(odd.select("source_file", F.explode("records").alias("r")))
    good = records.join(state.filter(F.col("status") == OK).select("source_file"), "source_file", "left_semi")
    counts = good.groupBy("source_file").agg(F.count(F.lit(1)).alias("records"), F.sum(_bad_values()).alias("bad_values"))
    report = (listed.join(state.select("source_file", "status"), "source_file", "full").join(counts, "source_file", "left")
              .select("source_file", F.coalesce("status", F.lit(EMPTY)).alias("status"),
                      F.coalesce("records", F.lit(0)).cast("long").alias("records"), F.coalesce("bad_values", F.lit(0)).cast("long").alias("bad_values")))
    return IngestResult(raw=_typed(good, account_id), quarantine=state.filter(F.col("status") != OK).select("source_file", "status", "size_chars"),
                        report=report)
