"""Lazily built stage DataFrames for one input folder and one config."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from encore.config import DEFAULT, PipelineConfig
from encore.operators import sessions as SS
from encore.operators.silver import silver
from encore.sources.plays import raw_from_events


class Stages:
    """raw -> silver -> plays with session ids -> sessions, each built once.

    By default the raw table comes from the shared `events`/`part` tables
    through the plays adapter; pass `raw` to run on an ingested table.
    """

    def __init__(self, spark: SparkSession, sf_dir: str | None = None,
                 cfg: PipelineConfig = DEFAULT, raw: DataFrame | None = None, **tables: DataFrame):
        self.spark, self.sf_dir, self.cfg = spark, sf_dir, cfg
        self._raw = raw
        self.profile_table = tables.pop("profile", None)   # materialized one-pass raw profile
        # materialized stages (silver, plays_sid, metrics, sessions) replace the lazy ones
        for name, df in tables.items():
            if name not in ("silver", "plays_sid", "metrics", "sessions"):
                raise ValueError(f"unknown stage {name}")
            self.__dict__[name] = df

    @property
    def keys(self) -> list[str]:
        return list(self.cfg.keys)

    @cached_property
    def raw(self) -> DataFrame:
        if self._raw is not None:
            return self._raw
        df = raw_from_events(self.spark, self.sf_dir)
        return df if "account_id" in self.cfg.keys else df.drop("account_id")

    @cached_property
    def silver(self) -> DataFrame:
        return silver(self.raw, self.cfg)

    @cached_property
    def plays_sid(self) -> DataFrame:
        return SS.plays_with_session_id(self.silver, self.cfg)

    @cached_property
    def metrics(self) -> DataFrame:
        return SS.session_metrics(self.plays_sid, self.cfg)

    @cached_property
    def sessions(self) -> DataFrame:
        return SS.classify(self.metrics, self.cfg)
