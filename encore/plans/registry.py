"""Named queries: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.config import DEFAULT, PipelineConfig
from encore.plans import eda as EDA
from encore.plans import quality as Q
from encore.plans import sketches as K
from encore.plans import views as V
from encore.plans.presentation import present
from encore.plans.stages import Stages
from encore.schemas import RAW_COLUMNS
from encore.sources.array_files import ingest_split
from encore.sources.export import write_csv, write_export_files, write_jsonl, write_table
from encore.sources.ingest import ingest, read_jsonl
from encore.sources.plays import raw_from_events, read_raw
from encore.spark import ensure_checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]

def _stage_fns() -> dict[str, Callable[[Stages], DataFrame]]:
    def gaps(st):
        return st.plays_sid.select(*st.silver.columns, "seconds_since_last_play")

    def flags(st):
        return st.plays_sid.select(*st.silver.columns, "seconds_since_last_play", "new_session_flag")

    def sid(st):
        return st.plays_sid.select(*st.silver.columns, "seconds_since_last_play", "new_session_flag",
                                   "session_id")

    return {
        "raw_plays": lambda st: st.raw,
        "silver_clean": lambda st: st.silver,
        "play_gaps": gaps,
        "session_flags": flags,
        "plays_with_session_id": sid,
        "session_metrics": lambda st: st.metrics,
        "sessions": lambda st: st.sessions,
    }


def _quality_fns() -> dict[str, Callable[[Stages], DataFrame]]:
    names = ["dq_silver_duplicates", "dq_silver_podcast_leak", "dq_silver_date_range",
             "dq_silver_top_artists", "dq_silver_completion", "dq_silver_daypart", "dq_silver_removed",
             "dq_silver_overlaps", "dq_silver_overlap_samples", "dq_silver_devices",
             "dq_sessions_total", "dq_sessions_by_length", "dq_sessions_by_type",
             "dq_sessions_by_engagement", "dq_sessions_by_month", "dq_sessions_extremes",
             "dq_sessions_orphans", "dq_negative_durations", "dq_intra_session_gaps",
             "session_quantiles", "dq_min_ms_sweep"]
    return {n: getattr(Q, n) for n in names}


def stage_functions() -> dict[str, Callable[[Stages], DataFrame]]:
    fns: dict[str, Callable[[Stages], DataFrame]] = {}
    fns.update(_stage_fns())
    fns.update({n: getattr(EDA, n) for n in EDA.NAMES})
    fns.update(_quality_fns())
    fns.update({n: getattr(V, n) for n in V.NAMES})
    fns.update({n: getattr(K, n) for n in K.NAMES})
    return fns


def null_accounts(raw: DataFrame) -> DataFrame:
    """Every other account without its number: one timeline of a NULL account."""
    return raw.withColumn("account_id", F.when(F.col("account_id") % 2 == 0, F.col("account_id")))


def _scratch(spark: SparkSession, name: str) -> str:
    folder = ensure_checkpoint_dir(spark)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def raw_from_export_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1-A3, A5, A6: raw plays written as export files and ingested again."""
    out = _scratch(spark, "exports")
    write_export_files(raw_from_events(spark, sf_dir), out)
    raw = ingest(spark, f"{out}/account_id=*/chunk=*", pattern="part-*", store=f"{out}/ingested").raw
    return raw.select(*RAW_COLUMNS)


def raw_from_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, A6: raw plays through the JSON lines sink and load, keyed by file."""
    out = _scratch(spark, "jsonl")
    raw = raw_from_events(spark, sf_dir)
    path = F.concat(F.lit("file:///x/account_id="), F.col("account_id"), F.lit("/history.json"))
    write_jsonl(raw.withColumn("source_file", path), out)
    account = F.regexp_extract(F.col("_metadata.file_path"), r"account_(\d+)_", 1).cast("long")
    return read_jsonl(spark, out, account_id=account).select(*RAW_COLUMNS)


def raw_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8: raw plays written as a table, replaced, and read back."""
    out = _scratch(spark, "table")
    raw = raw_from_events(spark, sf_dir)
    write_table(raw.limit(0), out)
    write_table(raw, out)
    return read_raw(spark, out)


#: Files that are no list of records, or hold a value that does not fit, put beside the exports.
BAD_FILES = ["{}", "[]", "not json", '[{"ts":', " ", '[{"ms_played":"x"}]']


def raw_from_split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A3: raw plays written as one export file per account, split over tasks."""
    out = _scratch(spark, "large")
    write_export_files(raw_from_events(spark, sf_dir), out, per_file=10**9)
    return ingest_split(spark, f"{out}/account_id=*/chunk=*", f"{out}/ingested", pattern="part-*").raw.select(*RAW_COLUMNS)


def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, A5: files, records and values that do not fit by status, of the plays'
    export files and of bad ones beside them."""
    out = _scratch(spark, "report")
    write_export_files(raw_from_events(spark, sf_dir), out, per_file=10**9)
    bad = spark.createDataFrame([(900_000 + i, 0, t) for i, t in enumerate(BAD_FILES)], "account_id long, chunk long, value string")
    bad.write.mode("append").partitionBy("account_id", "chunk").text(out)
    report = ingest(spark, f"{out}/account_id=*/chunk=*", pattern="part-*", store=f"{out}/ingested").report
    return report.groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.sum("records").alias("records"),
                                        F.sum("bad_values").alias("bad_values"))


def view_yearly_trends_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: a view written as CSV and read back."""
    out = _scratch(spark, "csv")
    view = V.view_yearly_trends(Stages(spark, sf_dir, DEFAULT))
    write_csv(view, out)
    return spark.read.schema(view.schema).option("header", True).csv(out)


def queries(cfg: PipelineConfig = DEFAULT) -> dict[str, Query]:
    """Each query sorted for presentation like its source query (reports only)."""
    def bind(fn, c=cfg, name=None):
        return lambda spark, sf_dir: present(name, fn(Stages(spark, sf_dir, c)), c.keys)
    out = {name: bind(fn, name=name) for name, fn in stage_functions().items()}
    if cfg.keys:
        # one timeline over all plays, as in a single-user export: exercises the
        # bucketed carry with no account key
        out["sessions_global"] = bind(lambda st: st.sessions, cfg.with_(keys=()))
        out["eda_gap_buckets_global"] = bind(EDA.eda_gap_buckets, cfg.with_(keys=()), "eda_gap_buckets")
        out["sessions_null_account"] = lambda spark, sf_dir: Stages(
            spark, cfg=cfg, raw=null_accounts(raw_from_events(spark, sf_dir))).sessions
        out["raw_from_export_files"] = raw_from_export_files
        out["raw_from_jsonl"] = raw_from_jsonl
        out["raw_from_table"] = raw_from_table
        out["raw_from_split_files"] = raw_from_split_files
        out["ingest_report"] = ingest_report
        out["view_yearly_trends_from_csv"] = view_yearly_trends_from_csv
    return out


__all__ = ["queries", "stage_functions"]
