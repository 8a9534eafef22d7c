"""Batch pipeline: raw -> silver -> sessions -> views, each stage written as
a Parquet table and read back before the next one.

Writing each stage cuts the lineage on shared storage: a lost executor only
recomputes work since the last written table, and every later query scans
the compact table instead of re-running the stages before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from encore.config import DEFAULT, PipelineConfig
from encore.plans import eda as EDA
from encore.plans import quality as Q
from encore.plans import sketches as K
from encore.plans import views as V
from encore.plans.presentation import present
from encore.plans.profile import profile as raw_profile
from encore.plans.stages import Stages
from encore.schemas import SESSION_COLUMNS, SILVER_COLUMNS
from encore.sources.export import write_csv, write_table

VIEWS = ["view_artist_stats", "view_track_stats", "view_temporal_patterns", "view_session_behavior",
         "view_yearly_trends", "view_top_content"]


def materialize(spark: SparkSession, raw: DataFrame, out_dir: str, cfg: PipelineConfig = DEFAULT) -> Stages:
    """Write raw, the one-pass raw profile, silver, plays-with-session-id and
    sessions tables, and the daily and monthly sketches; return Stages that read
    from them."""
    keys = list(cfg.keys)

    def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Written and read back with its schema: an empty stage is a table too."""
        write_table(df, f"{out_dir}/{name}", partition_by)
        return spark.read.schema(df.schema).parquet(f"{out_dir}/{name}").select(*df.columns)

    raw = stored(raw, "raw")
    prof = stored(raw_profile(raw, cfg), "raw_profile")
    silver = stored(Stages(spark, cfg=cfg, raw=raw).silver, "silver", ["play_year"]).select(
        *[c for c in SILVER_COLUMNS if c != "account_id" or c in keys])
    plays_sid = stored(Stages(spark, cfg=cfg, raw=raw, silver=silver).plays_sid, "plays_with_session_id")
    st = Stages(spark, cfg=cfg, raw=raw, silver=silver, plays_sid=plays_sid)
    sessions = stored(st.sessions, "sessions", ["session_year"]).select(
        *[c for c in SESSION_COLUMNS if c != "account_id" or c in keys])
    done = Stages(spark, cfg=cfg, raw=raw, silver=silver, plays_sid=plays_sid, sessions=sessions, profile=prof)
    stored(K.daily_distinct(done), "distinct_daily")
    stored(K.monthly_measures(done), "measures_monthly")
    return done


def register_views(st: Stages) -> dict[str, DataFrame]:
    """A9: the gold views and the stage tables as temp views by name, so SQL
    written against the source tables runs on them with `spark.sql`."""
    out = {"streaming_history_raw": st.raw, "streaming_history_clean": st.silver, "sessions": st.sessions,
           "plays_with_session_id": st.plays_sid}
    for name in V.NAMES:
        out[name] = getattr(V, name)(st)
    for name, df in out.items():
        df.createOrReplaceTempView(name)
    return out


def export_csv(st: Stages, out_dir: str) -> None:
    """A10: the two tables and six views to CSV folders."""
    write_csv(st.silver, f"{out_dir}/csv/streaming_history_clean")
    write_csv(st.sessions, f"{out_dir}/csv/sessions")
    for name in VIEWS:
        write_csv(present(name, getattr(V, name)(st), st.keys), f"{out_dir}/csv/{name}")


def reports(st: Stages) -> dict[str, DataFrame]:
    """Every profiling and check query over a Stages object, by name."""
    from encore.plans.registry import _quality_fns
    out = {n: getattr(EDA, n)(st) for n in EDA.NAMES}
    out.update({n: fn(st) for n, fn in _quality_fns().items()})
    out["expectations"] = Q.expectations(st)
    return out


def write_reports(st: Stages, out_dir: str) -> None:
    """The reports as Parquet tables, one folder each."""
    for name, df in reports(st).items():
        write_table(df, f"{out_dir}/{name}")
