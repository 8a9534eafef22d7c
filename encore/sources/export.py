"""Sinks: JSONL (A4), tables (A8), views (A9), CSV export (A10)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.schemas import RAW_COLUMNS


def write_jsonl(raw: DataFrame, out_dir: str) -> None:
    """A4: records as JSON lines, NULL fields written out, one folder per
    source file (the converter writes <stem>.jsonl per input); files of the same
    name in different account folders stay apart."""
    stem = F.regexp_extract(F.col("source_file"), r"([^/]+?)(\.[^./]*)?$", 1)
    account = F.regexp_extract(F.col("source_file"), r"account_id=(\d+)/", 1)
    stem = F.when(account != "", F.concat(F.lit("account_"), account, F.lit("_"), stem)).otherwise(stem)
    cols = [c for c in RAW_COLUMNS if c in raw.columns and c != "account_id"]
    # ts holds the UTC wall time; the string cast does not involve the session zone
    iso = F.concat(F.regexp_replace(F.col("ts").cast("string"), " ", "T"), F.lit("Z"))
    out = raw.select(*[iso.alias(c) if c == "ts" else F.col(c) for c in cols], stem.alias("source_stem"))
    (out.write.mode("overwrite").option("ignoreNullFields", False)
     .partitionBy("source_stem").json(out_dir))


def write_export_files(raw: DataFrame, out_dir: str, per_file: int = 5000) -> None:
    """Raw plays as export files: one JSON array of about `per_file` records a
    file, in folders by account and chunk; an account has as many chunks as its
    own rows call for. Records that are equal in all columns share a file."""
    per = raw.groupBy("account_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(per_file)).alias("chunks")) \
        .select(F.col("account_id").alias("of_account"), "chunks")
    iso = F.concat(F.regexp_replace(F.col("ts").cast("string"), " ", "T"), F.lit("Z"))
    rec = F.to_json(F.struct(*[(iso if c == "ts" else F.col(c)).alias(c) for c in RAW_COLUMNS if c != "account_id"]))
    files = (raw.join(per, F.col("account_id").eqNullSafe(F.col("of_account")))
             .select("account_id", F.pmod(F.xxhash64(*RAW_COLUMNS), F.col("chunks")).alias("chunk"), rec.alias("j"))
             .groupBy("account_id", "chunk")
             .agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("j"), ",\n"), F.lit("\n]")).alias("value")))
    files.write.mode("overwrite").partitionBy("account_id", "chunk").text(out_dir)


def write_table(df: DataFrame, path: str | None = None, partition_by: list[str] | None = None,
                name: str | None = None, only_partitions: bool = False) -> None:
    """A8: create or replace a Parquet table at `path`, or the table `name` of
    the session's catalog. Partitioned rows are rebalanced first, so that a
    partition's files follow its size and not the number of tasks.

    At a path the rows are written beside the table and take its place when all of
    them are there: a write that fails leaves the old table as it was, and a table
    may be replaced by what is read from it. `only_partitions` replaces the
    partitions that `df` has rows of and keeps the others. A catalog with atomic
    replacement uses it; the session's own catalog overwrites."""
    rows = df.hint("rebalance", *partition_by) if partition_by else df
    spark = df.sparkSession
    if name and name.count(".") > 1:
        w = rows.writeTo(name).using("parquet")
        (w.partitionedBy(*partition_by) if partition_by else w).createOrReplace()
        return
    w = rows.write.mode("overwrite").format("parquet")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if name:
        w.saveAsTable(name)
    elif only_partitions:
        w.option("partitionOverwriteMode", "dynamic").save(path)
    else:
        folder, _, last = path.rstrip("/").rpartition("/")
        staged = f"{folder}/_staged-{uuid.uuid4().hex}-{last}"
        try:
            w.save(staged)
            _swap(spark, staged, path)
        finally:
            _remove(spark, staged)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    if fs.exists(p):
        fs.delete(p, True)


def _swap(spark: SparkSession, staged: str, path: str) -> None:
    """Put the folder `staged` in the place of `path`; back as it was where that fails."""
    fs, target = _fs(spark, path)
    old = _fs(spark, f"{staged}-old")[1]
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"cannot replace {path}")
    if not fs.rename(_fs(spark, staged)[1], target):
        if had:
            fs.rename(old, target)
        raise OSError(f"cannot put {staged} in the place of {path}")
    if had:
        fs.delete(old, True)


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A10: CSV with header, as many files as the result has partitions."""
    out = df.orderBy(*order) if order else df
    out.write.mode("overwrite").option("header", True).csv(path)
