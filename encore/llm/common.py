"""Shared by the operators of this package: session folders, bounded samples,
and appending computed columns whose names may clash with the caller's."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir. One is made only
    where the session has none (local tests)."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="encore-llm-"))
    return sc.getCheckpointDir()


ROWS_PER_BATCH = 2000


def prepare(spark: SparkSession) -> None:
    """What every query of this package does first. Texts are long: Python gets
    ROWS_PER_BATCH of them at a time, unless the session has its own number."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":       # Spark's default
        spark.conf.set(key, ROWS_PER_BATCH)
    ship_code(spark)


def ship_code(spark: SparkSession) -> None:
    """Let the executors import this package where only the driver's sys.path
    names its folder: no PYTHONPATH, not the working directory, no --py-files."""
    root = Path(__file__).resolve().parent.parent.parent
    known = {Path(p).resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p}
    sc = spark.sparkContext
    if not root.is_dir() or root in known or getattr(sc, "_encore_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="encore-code-")) / "encore-code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "encore").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(archive))
    sc._encore_shipped = True


def once(df: DataFrame) -> DataFrame:
    """`df` for a single action, whose shuffle files are deleted as soon as that ends.
    Spark otherwise keeps them until the driver happens to collect its garbage, so
    that a query of many steps holds the files of all of them."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return df.select("*")                # the setting is read where a frame is made
    finally:
        conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and go on from there, so that a lost
    executor costs a re-read and not the work before; its shuffle files go."""
    shared_folder(df.sparkSession)
    return once(df).checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(df: DataFrame, key: list[str], rows: int, seed: int, by: str | None = None, least: float = 0.1) -> DataFrame:
    """About `rows` rows at most, chosen by a hash of the columns `key`: the same
    rows on every run, by whichever tasks hold them. Rows alike in all of `key` are
    one. All rows when there are no more. With `by`, a column of few values, each
    value gets its part of `rows`, and a rare one a part `least` of them."""
    df = df.dropDuplicates(key)
    sizes = df.groupBy(F.col(by) if by else F.lit(0).alias("all")).count().collect()
    n = sum(r[1] for r in sizes)
    if n <= rows:
        return df
    u = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in key], F.lit(seed)), F.lit(1 << 30))
    share = F.lit(0)
    for value, size in sizes:
        part = int(min(1.0, rows * max(size / n, least if by else 0) / size) * (1 << 30))
        share = F.when(F.col(by).eqNullSafe(F.lit(value)), part).otherwise(share) if by else F.lit(part)
    return df.filter(u < share)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or with underscores before it until no column has it (Spark
    compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
