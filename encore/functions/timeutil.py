"""Clocks and calendar fields.

Two clocks exist on purpose: profiling shifts UTC by a fixed number of hours,
while the silver layer converts to a named zone (which has had DST).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from encore import labels as LB
from encore.config import PipelineConfig


def eda_clock(ts: Column, cfg: PipelineConfig) -> Column:
    return F.timestamp_add("HOUR", F.lit(-cfg.eda_offset_hours), ts)


def local_clock(ts: Column, cfg: PipelineConfig) -> Column:
    """UTC wall time (timestamp_ntz) -> local wall time in cfg.tz."""
    return F.convert_timezone(F.lit("UTC"), F.lit(cfg.tz), ts)


# Wall-clock (timestamp_ntz) arithmetic below never goes through the session
# time zone: date_trunc / date_format / current_timestamp would, and shift wall
# times that fall in that zone's DST gap on a cluster not running in UTC.
EPOCH_NTZ = "1970-01-01 00:00:00"
DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def trunc_ntz(t: Column, unit: str) -> Column:
    """Truncate a timestamp_ntz to SECOND, MINUTE or HOUR."""
    us_in_minute = (F.date_part(F.lit("SECOND"), t) * 1_000_000).cast("long")   # seconds + fraction
    drop = {"SECOND": us_in_minute % 1_000_000,
            "MINUTE": us_in_minute,
            "HOUR": us_in_minute + F.minute(t).cast("long") * 60_000_000}[unit.upper()]
    return F.timestamp_add("MICROSECOND", -drop, t)


def minus_ms_to_second(end: Column, ms: Column) -> Column:
    """end - ms, truncated to the second, kept as timestamp_ntz."""
    return trunc_ntz(F.timestamp_add("MILLISECOND", -ms, end), "SECOND")


def utc_wall(instant: Column) -> Column:
    """An instant (TIMESTAMP) as the UTC wall time (timestamp_ntz)."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.lit(EPOCH_NTZ).cast("timestamp_ntz"))


def year(c: Column) -> Column:
    return F.year(c).cast("long")


def month(c: Column) -> Column:
    return F.month(c).cast("long")


def hour(c: Column) -> Column:
    return F.hour(c).cast("long")


def day_num(c: Column) -> Column:
    """1 = Sunday ... 7 = Saturday."""
    return F.dayofweek(c).cast("long")


def day_name(c: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in DAY_NAMES]), F.dayofweek(F.to_date(c)))


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def minutes_between(start: Column, end: Column) -> Column:
    """Whole minutes, truncated toward zero."""
    return F.timestamp_diff("MINUTE", start, end)


def daypart_silver(h: Column) -> Column:
    night, morning, afternoon, evening = LB.DAYPART_SILVER
    return (F.when(h.between(0, 5), night).when(h.between(6, 11), morning)
            .when(h.between(12, 17), afternoon).otherwise(evening))


def daypart_eda(h: Column) -> Column:
    morning, afternoon, evening, night = LB.DAYPART_EDA
    return (F.when(h.between(6, 11), morning).when(h.between(12, 17), afternoon)
            .when(h.between(18, 23), evening).otherwise(night))


def now_utc() -> Column:
    return utc_wall(F.current_timestamp())


def as_of_date(cfg: PipelineConfig) -> Column:
    """cfg.as_of, else today's UTC date."""
    return F.lit(cfg.as_of).cast("date") if cfg.as_of else F.to_date(now_utc())


# ---------------------------------------------------------------- SQL text (DuckDB)
def sql_eda_clock(ts: str, cfg: PipelineConfig) -> str:
    return f"({ts} - INTERVAL {cfg.eda_offset_hours} HOUR)"


def sql_local_clock(ts: str, cfg: PipelineConfig) -> str:
    return f"(({ts} AT TIME ZONE 'UTC') AT TIME ZONE '{cfg.tz}')"


def sql_day_num(c: str) -> str:
    return f"(dayofweek({c}) + 1)"


def sql_daypart_silver(h: str) -> str:
    n, m, a, e = LB.DAYPART_SILVER
    return (f"(CASE WHEN {h} BETWEEN 0 AND 5 THEN '{n}' WHEN {h} BETWEEN 6 AND 11 THEN '{m}' "
            f"WHEN {h} BETWEEN 12 AND 17 THEN '{a}' ELSE '{e}' END)")


def sql_daypart_eda(h: str) -> str:
    m, a, e, n = LB.DAYPART_EDA
    return (f"(CASE WHEN {h} BETWEEN 6 AND 11 THEN '{m}' WHEN {h} BETWEEN 12 AND 17 THEN '{a}' "
            f"WHEN {h} BETWEEN 18 AND 23 THEN '{e}' ELSE '{n}' END)")


def sql_as_of(cfg: PipelineConfig) -> str:
    return f"DATE '{cfg.as_of}'" if cfg.as_of else "current_date"
