"""Ingest play-history export files (one JSON array of records per file).

Each file is loaded as a single text value (`wholetext`), validated, then
parsed with `from_json` into an array of records and exploded. Files are never
split, so a file is the unit of validity - exactly the source converter's
behaviour:

  * empty file, `[]`, a bare object, invalid JSON or text after the array ->
    the file contributes no rows and is listed in the report with its status;
  * one bad file does not stop the run (it lands in `quarantine`);
  * a value that does not fit its column (a time that is none, a number with a
    fraction) is NULL and counted as `bad_values` of its file.

With `store`, the parsed records are written once and raw, quarantine and
report are read from there; without it each of them parses the files when used.

Many files are packed into each task by Spark's file-split planning, so the
job parallelises over files. Spark lists them too (local, HDFS and S3 paths all
work); the driver only keeps the names of empty ones. A single file is one value in
one task; `array_files.ingest_split` takes files of any size, and JSON lines
(`read_jsonl`) are split as well.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encore.functions.timeutil import utc_wall
from encore.schemas import EXPORT_FIELDS, RAW, RAW_COLUMNS

OK, EMPTY, NOT_ARRAY, NO_RECORDS, INVALID = "ok", "empty", "not_array", "zero_records", "invalid_json"


@dataclass
class IngestResult:
    raw: DataFrame          # RAW schema (account_id + 23 export columns) + source_file, event_time
    quarantine: DataFrame   # source_file, status, size_chars for files that gave no rows
    report: DataFrame       # source_file, status, records, bad_values (one row per listed file)
    totals: dict | None = None   # records, bad_values, bad_files as the one pass over the files saw them (with `store`)


def discover(spark: SparkSession, path: str, pattern: str = "*.json") -> list[str]:
    """A1: the `pattern` files directly in `path` (not recursive), or `path`
    itself when it is a file, listed through the cluster's file system (local,
    HDFS, S3 ...) - zero-byte files included. Raises when nothing is found."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(hpath) and fs.getFileStatus(hpath).isFile():
        statuses = [fs.getFileStatus(hpath)]
    else:
        statuses = fs.globStatus(jvm.org.apache.hadoop.fs.Path(hpath, pattern)) or []
    files = sorted(_norm(st.getPath().toString()) for st in statuses if st.isFile())
    if not files:
        raise FileNotFoundError(f"no {pattern} files in {path}")
    return files


def _norm(p: str) -> str:
    """One spelling per local file URI ('file:/x', 'file:///x', '/x' -> 'file:///x')."""
    if p.startswith("/"):
        return "file://" + p
    if p.startswith("file:"):
        return "file:///" + p[len("file:"):].lstrip("/")
    return p


def _norm_col(c: F.Column) -> F.Column:
    return F.regexp_replace(c, r"^file:/+", "file:///")


def _instant(ts_str: F.Column) -> F.Column:
    """ISO instant string ('...Z' or with offset); NULL when it is none."""
    return F.try_to_timestamp(ts_str)


# every field as text first, so that a value that does not fit can be counted
_TEXT_RECORD = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n, _ in EXPORT_FIELDS]))
_AFTER = "after the array"


def _listed(spark: SparkSession, files: list[str] | str, pattern: str) -> tuple[list[str], DataFrame]:
    """Paths for Spark's readers, and one row per file (source_file)."""
    if isinstance(files, str):
        jvm = spark.sparkContext._jvm
        hpath = jvm.org.apache.hadoop.fs.Path(files)
        fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        single = fs.exists(hpath) and fs.getFileStatus(hpath).isFile()
        paths = [files if single else f"{files.rstrip('/')}/{pattern}"]
        found = [fs.getFileStatus(hpath)] if single else fs.globStatus(jvm.org.apache.hadoop.fs.Path(paths[0])) or []
        if not single and not any(st.isFile() for st in found):
            raise FileNotFoundError(f"no {pattern} files in {files}")
        # Spark's readers leave out files without a byte; only their names come here
        empty = [_norm(st.getPath().toUri().toString()) for st in found if not st.getLen() and st.isFile()]
    else:
        paths, empty = [_norm(f) for f in files], []
    rows = spark.read.format("binaryFile").load(paths).select(_norm_col(F.col("_metadata.file_path")).alias("source_file"))
    return paths, rows.union(spark.createDataFrame([(f,) for f in empty], "source_file string")).distinct()


def ingest(spark: SparkSession, files: list[str] | str, account_id: int | None = None,
           pattern: str = "*.json", store: str | None = None) -> IngestResult:
    """A2-A6: parse export files into the raw schema.

    `account_id`: fixed key for all files; when None it is taken from an
    `account_id=<n>` folder in each file's path (NULL if absent).
    `store`: a folder for the parsed records; the files are then read once.
    """
    paths, listed = _listed(spark, files, pattern)
    # wholetext must be passed as the keyword: text()'s own default would override an .option()
    text = (spark.read.text(paths, wholetext=True)
            .select(_norm_col(F.col("_metadata.file_path")).alias("source_file"), F.col("value")))
    parsed = classify_files(text).select(
        "source_file", "status", F.length("value").cast("long").alias("size_chars"),
        F.explode_outer(F.when(F.col("status") == OK, F.col("_recs"))).alias("r"))
    seen = None
    if store:
        # the totals come with the write, without another pass
        seen, good = Observation(), F.col("status") == OK
        parsed = parsed.observe(seen, F.count_if(good).alias("records"), F.sum(F.when(good, _bad_values()).otherwise(0)).alias("bad_values"),
                                F.count_if(~good).alias("bad_files"))
        parsed.write.mode("overwrite").parquet(store)
        parsed = spark.read.schema(parsed.schema).parquet(store)
    raw = _typed(parsed.filter(F.col("status") == OK), account_id)
    quarantine = parsed.filter(F.col("status") != OK).select("source_file", "status", "size_chars")
    counts = parsed.groupBy("source_file").agg(
        F.min("status").alias("status"), F.count_if(F.col("status") == OK).alias("records"),
        F.sum(F.when(F.col("status") == OK, _bad_values()).otherwise(0)).alias("bad_values"))
    # files Spark listed but produced no text row (zero-byte files) are reported as empty
    report = (listed.join(counts, on="source_file", how="full")
              .select("source_file", F.coalesce("status", F.lit(EMPTY)).alias("status"),
                      F.coalesce("records", F.lit(0)).cast("long").alias("records"),
                      F.coalesce("bad_values", F.lit(0)).cast("long").alias("bad_values")))
    return IngestResult(raw=raw, quarantine=quarantine, report=report, totals=seen.get if seen else None)


def classify_files(text: DataFrame) -> DataFrame:
    """(source_file, value = whole file) -> + _recs (parsed array) and status.
    Works on batch and streaming DataFrames alike."""
    body = F.regexp_replace(F.col("value"), r"^\s+", "")
    parsed = F.from_json(F.col("value"), _TEXT_RECORD, {"mode": "PERMISSIVE"})
    # the reader stops at the array's end: as the first of exactly two elements, nothing may follow it
    framed = F.from_json(F.concat(F.lit("["), F.col("value"), F.lit(f', "{_AFTER}"]')), T.ArrayType(T.StringType()),
                         {"mode": "PERMISSIVE"})
    whole = F.coalesce((F.size(framed) == 2) & (F.try_element_at(framed, F.lit(2)) == _AFTER), F.lit(False))
    status = (F.when(body == "", EMPTY)
              .when(~body.startswith("["), NOT_ARRAY)
              .when(F.col("_recs").isNull(), INVALID)
              .when(F.size("_recs") == 0, F.when(whole, NO_RECORDS).otherwise(INVALID))
              .when(~whole, INVALID)
              .otherwise(OK))
    return (text.withColumn("_recs", F.when(body.startswith("["), parsed))
            .withColumn("status", status))


def _value(name: str, kind: T.DataType) -> F.Column:
    text = F.col(f"r.{name}")
    return utc_wall(_instant(text)) if name == "ts" else text.try_cast(kind)


def _bad_values() -> F.Column:
    """Fields of a record that had a value which does not fit its column."""
    out = F.lit(0)
    for n, t in EXPORT_FIELDS:
        if not isinstance(t, T.StringType):
            out = out + (F.col(f"r.{n}").isNotNull() & _value(n, t).isNull()).cast("int")
    return out


def records(files_df: DataFrame, account_id: int | None = None) -> DataFrame:
    """Rows of the valid files in the raw schema (+ source_file)."""
    return _typed(files_df.filter(F.col("status") == OK).select("source_file", F.explode("_recs").alias("r")), account_id)


def _typed(recs: DataFrame, account_id: int | None) -> DataFrame:
    if account_id is None:
        acct = F.regexp_extract("source_file", r"account_id=(\d+)", 1)
        acct = F.when(acct == "", F.lit(None)).otherwise(acct).cast("long")
    else:
        acct = F.lit(account_id).cast("long")
    cols = {n: _value(n, t) for n, t in EXPORT_FIELDS}
    cols["account_id"] = acct
    return recs.select(*[cols[n].cast(RAW[n].dataType).alias(n) for n in RAW_COLUMNS], "source_file",
                       _instant(F.col("r.ts")).alias("event_time"))


def summary(report: DataFrame) -> DataFrame:
    """A5: files ok / total and records converted."""
    return report.agg(
        F.count_if(F.col("status") == OK).alias("files_ok"),
        F.count(F.lit(1)).alias("files_total"),
        F.sum("records").cast("long").alias("records_total"))


def read_jsonl(spark: SparkSession, path: str, account_id: int | F.Column | None = None, bad_lines: str | None = None,
               infer: bool = False) -> DataFrame:
    """A6: one record per line (the converter's output) into the raw schema.
    `account_id`: a number, or a column over the lines' `_metadata`.
    A line that is no JSON gives no row; with `bad_lines`, such lines are
    written there as text. `infer`: let Spark find the columns (and return
    those) instead of the export's."""
    if infer:
        return spark.read.json(path)
    as_text = T.StructType([*_TEXT_RECORD.elementType.fields, T.StructField("_bad", T.StringType())])
    acct = account_id if isinstance(account_id, F.Column) else F.lit(account_id)
    lines = spark.read.text(path).select(acct.cast("long").alias("account_id"), F.from_json("value", as_text, {"columnNameOfCorruptRecord": "_bad"}).alias("r"), "value")
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    if bad_lines:
        lines.filter(bad & (F.trim("value") != "")).select("value").write.mode("overwrite").text(bad_lines)
    cols = {n: _value(n, t) for n, t in EXPORT_FIELDS} | {"account_id": F.col("account_id")}
    return lines.filter(~bad).select(*[cols[n].cast(RAW[n].dataType).alias(n) for n in RAW_COLUMNS])
