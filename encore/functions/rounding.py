"""Exact decimal rounding.

ROUND(x, n) in the source pipeline is half away from zero. Doing it on a
double that came out of a division makes ties depend on binary error (1.005
rounds down in one engine and up in another). Every rounded figure here is
instead ROUND(num / den, n) over *integers*, computed as

    sign * ((|num| * 2 * 10^n + |den|) div (2 * |den|)) / 10^n

which is exact, and gives NULL when den = 0 (no division-by-zero error).
Durations are kept as integer hundredths (centi-units) so that sums of
rounded values, as the pipeline defines them, stay exact too.

Each helper has a Spark form (Column) and an SQL-text form for the DuckDB
oracle, so the two engines apply the same rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def idiv(a, b) -> Column:
    """Integral division (truncates toward zero)."""
    return F.call_function("div", _c(a), _c(b))


def rround_int(num, den, digits: int, as_double: bool = False) -> Column:
    """round(num/den, digits) * 10^digits as BIGINT; NULL when den = 0.
    `as_double`: the rounded quotient itself, which may exceed a BIGINT in units of 10^-digits."""
    num, den = _c(num), _c(den).cast("long")
    scale = 10 ** digits
    sign = F.when((num < 0) != (den < 0), F.lit(-1)).otherwise(F.lit(1))
    # the fraction of num / den rounded on its own: its products fit decimals for any BIGINT
    whole, rest = idiv(F.abs(num), F.abs(den)), F.abs(num) % F.abs(den)
    limit = (1 << 61) // (2 * scale)
    fits = F.abs(den) < limit
    small = F.when(fits, rest).otherwise(0).cast("long")
    wide, wide_den = rest.cast("decimal(20,0)"), F.abs(den).cast("decimal(20,0)")
    part = F.when(fits, idiv(small * (2 * scale) + F.abs(den), F.abs(den) * 2)).otherwise(
        idiv(wide * F.lit(2 * scale).cast("decimal(9,0)") + wide_den, wide_den * F.lit(2).cast("decimal(1,0)")))
    if as_double:
        mag = whole.cast("double") + part.cast("double") / F.lit(float(scale))
        return F.when((den == 0) | den.isNull(), F.lit(None).cast("double")).otherwise(
            F.when(num == 0, F.lit(0.0)).when(whole < (1 << 40), (sign * (whole * scale + part)).cast("double") / F.lit(float(scale)))
            .otherwise(sign * mag))
    mag = whole * scale + part
    return F.when((den == 0) | den.isNull(), F.lit(None).cast("long")).otherwise(
        F.when(num == 0, F.lit(0).cast("long")).otherwise(sign * mag))


def rround(num, den, digits: int) -> Column:
    """ROUND(num/den, digits) as DOUBLE, exact half away from zero."""
    return rround_int(num, den, digits, as_double=True)


def from_cents(c, digits: int = 2) -> Column:
    return _c(c).cast("double") / F.lit(float(10 ** digits))


def to_cents(x, digits: int = 2) -> Column:
    """Recover the integer behind a double that holds k / 10^digits."""
    return F.round(_c(x) * F.lit(float(10 ** digits))).cast("long")


def pct(part, whole, digits: int = 2) -> Column:
    """ROUND(part * 100 / whole, digits)."""
    return rround(_c(part).cast("decimal(25,0)") * F.lit(100).cast("decimal(3,0)"), whole, digits)


# duration units from ms_played, rounded to hundredths as in the silver table
def seconds_c(ms) -> Column:
    return rround_int(ms, 1000, 2)


def minutes_c(ms) -> Column:
    return rround_int(ms, 60000, 2)


def hours_c(ms) -> Column:
    return rround_int(ms, 3600000, 2)


# ---------------------------------------------------------------- SQL text
def sql_rround_int(num: str, den: str, digits: int) -> str:
    scale = 10 ** digits
    return (f"(CASE WHEN ({den}) = 0 OR ({den}) IS NULL THEN NULL "
            f"WHEN ({num}) = 0 THEN 0 "
            f"ELSE (CASE WHEN (({num}) < 0) <> (({den}) < 0) THEN -1 ELSE 1 END) * "
            f"((abs({num}) * {2 * scale} + abs({den})) // (2 * abs({den}))) END)")


def sql_rround(num: str, den: str, digits: int) -> str:
    return f"(CAST({sql_rround_int(num, den, digits)} AS DOUBLE) / {10 ** digits})"


def sql_pct(part: str, whole: str, digits: int = 2) -> str:
    return sql_rround(f"(({part}) * 100)", whole, digits)


def sql_from_cents(c: str, digits: int = 2) -> str:
    return f"(CAST({c} AS DOUBLE) / {10 ** digits})"


def sql_to_cents(x: str, digits: int = 2) -> str:
    return f"CAST(round(({x}) * {10 ** digits}) AS BIGINT)"


def sql_seconds_c(ms: str) -> str:
    return sql_rround_int(ms, "1000", 2)


def sql_minutes_c(ms: str) -> str:
    return sql_rround_int(ms, "60000", 2)


def sql_hours_c(ms: str) -> str:
    return sql_rround_int(ms, "3600000", 2)
