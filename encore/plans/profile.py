"""One-pass raw profile: the count / duration distributions of the profiling
queries from a single scan.

`profile(st)` groups raw once with GROUPING SETS (one set per distribution,
all per key); Spark expands each row once per set and aggregates map-side,
so the shuffle carries one row per (key, set, value) instead of plays. The
pipeline writes it as a table; the distribution queries in `eda.py` then read
their set from it instead of rescanning raw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore import labels as LB
from encore.functions import timeutil as TU

# set name -> grouping columns (besides the keys)
SETS = {
    "content_type": ["content_type"],
    "hour": ["hour"],
    "weekday": ["day_of_week", "day_num"],
    "heatmap": ["day_num", "hour"],
    "platform": ["platform"],
    "platform_daypart": ["platform", "time_of_day"],
    "country": ["country"],
    "duration_bucket": ["duration_bucket"],
    "skipped": ["skipped"],
    "offline": ["offline"],
    "incognito_mode": ["incognito_mode"],
    "reason_start": ["reason_start"],
    "reason_end": ["reason_end"],
    "completion_category": ["completion_category"],
}
DIMS = ["content_type", "hour", "day_of_week", "day_num", "platform", "time_of_day", "country",
        "duration_bucket", "skipped", "offline", "incognito_mode", "reason_start", "reason_end",
        "completion_category"]
# rows a distribution leaves out, as a condition on its grouping values
KEEP = {
    "platform": ["platform"], "platform_daypart": ["platform"], "country": ["country"],
    "duration_bucket": ["duration_bucket"], "skipped": ["skipped"], "offline": ["offline"],
    "incognito_mode": ["incognito_mode"], "reason_start": ["reason_start"], "reason_end": ["reason_end"],
    "completion_category": ["completion_category"],
}


def _bucket(v: Column, limits, labels) -> Column:
    out = F.when(v < limits[0], labels[0])
    for lim, lbl in zip(limits[1:], labels[1:]):
        out = out.when(v < lim, lbl)
    return out.otherwise(labels[len(limits)])


def dimension_columns(cfg) -> dict[str, Column]:
    clock = TU.eda_clock(F.col("ts"), cfg)
    ms, track = F.col("ms_played"), F.col("master_metadata_track_name")
    a, b, c = LB.EDA_COMPLETION_LIMITS_MS
    l0, l1, l2, l3 = LB.EDA_COMPLETION_LABELS
    completion = F.when(ms < a, l0).when(ms < b, l1).when(ms < c, l2).when(ms >= c, l3)
    return {
        "content_type": (F.when(F.col("episode_name").isNotNull(), LB.CONTENT_PODCAST)
                         .when(track.isNotNull(), LB.CONTENT_MUSIC).otherwise(LB.CONTENT_UNKNOWN)),
        "hour": TU.hour(clock),
        "day_of_week": TU.day_name(clock),
        "day_num": TU.day_num(clock),
        "platform": F.col("platform"),
        "time_of_day": TU.daypart_eda(TU.hour(clock)),
        "country": F.col("conn_country"),
        "duration_bucket": F.when(ms > 0, _bucket(ms, LB.DURATION_LIMITS_MS, LB.DURATION_LABELS)),
        "skipped": F.col("skipped"),
        "offline": F.col("offline"),
        "incognito_mode": F.col("incognito_mode"),
        "reason_start": F.col("reason_start"),
        "reason_end": F.col("reason_end"),
        "completion_category": F.when(track.isNotNull() & (ms > 0), completion),
    }


def _aggs() -> list[Column]:
    ms = F.col("ms_played")
    return [F.count(F.lit(1)).alias("plays"), F.sum(ms).alias("_sum_ms"), F.count(ms).alias("_n_ms")]


def grouping_id_of(keys, name: str) -> int:
    """grouping_id() of a set: bit = 1 for every column aggregated away (first column = highest bit)."""
    cols = list(keys) + DIMS
    member = set(keys) | set(SETS[name])
    n = len(cols)
    return sum(1 << (n - 1 - i) for i, c in enumerate(cols) if c not in member)


def profile(raw: DataFrame, cfg) -> DataFrame:
    keys = list(cfg.keys)
    dims = dimension_columns(cfg)
    x = raw.select(*keys, *[dims[d].alias(d) for d in DIMS], "ms_played")
    sets = [keys + SETS[name] for name in SETS]
    return x.groupingSets(sets, *keys, *DIMS).agg(*_aggs(), F.grouping_id().alias("_gid"))


def distribution(st, name: str) -> DataFrame:
    """keys + the set's columns + plays, _sum_ms, _n_ms, for one distribution:
    read from the materialized profile when the stages have one, else one
    focused aggregate over raw."""
    cols = SETS[name]
    if st.profile_table is not None:
        out = (st.profile_table.filter(F.col("_gid") == grouping_id_of(st.keys, name))
               .select(*st.keys, *cols, "plays", "_sum_ms", "_n_ms"))
    else:
        dims = dimension_columns(st.cfg)
        out = st.raw.groupBy(*st.keys, *[dims[c].alias(c) for c in cols]).agg(*_aggs())
    for c in KEEP.get(name, []):
        out = out.filter(F.col(c).isNotNull())
    return out
