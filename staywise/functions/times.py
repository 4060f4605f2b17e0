"""Column expressions over timestamps: gaps, ages, day and night (F1-F8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros_between(start: Column | str, end: Column | str) -> Column:
    """Microseconds from ``start`` to ``end``; independent of the session zone for zoneless inputs."""
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end))


def epoch_micros(ts: Column | str) -> Column:
    return micros_between(F.expr(EPOCH), ts)


def days_between(start: Column | str, end: Column | str, places: int | None = 3) -> Column:
    """Fractional days from ``start`` to ``end``, half-even rounded."""
    days = micros_between(start, end) / F.lit(float(DAY_MICROS))
    return days if places is None else F.bround(days, places)


def whole_days(start: Column | str, end: Column | str) -> Column:
    """Whole-day part of the interval, truncated toward zero (F2)."""
    return F.extract(F.lit("DAY"), _col(end) - _col(start)).cast("int")


def minute_part(start: Column | str, end: Column | str) -> Column:
    """Minute *part* of the interval, signed like the interval (F2)."""
    return F.extract(F.lit("MINUTE"), _col(end) - _col(start)).cast("int")


def is_negative_span(start: Column | str, end: Column | str) -> Column:
    """True for any negative span, whole hours included (Q17)."""
    return micros_between(start, end) < 0


def age_in_years(born: Column | str, at: Column | str) -> Column:
    """``floor(days / 365.0)``."""
    return F.floor(F.datediff(_col(at), _col(born)) / F.lit(365.0)).cast("int")


def age_truncated(born: Column | str, at: Column | str) -> Column:
    """``int(days / 365)``: truncation toward zero."""
    return (F.datediff(_col(at), _col(born)) / F.lit(365.0)).cast("int")


def unshift_age(age: Column | str, above: int = 89, shift: int = 210) -> Column:
    """Undo the shift that hides the age of the oldest entities."""
    age = _col(age)
    return F.when(age > above, age - shift).otherwise(age)


def day_flag(ts: Column | str, start: int = 6, end: int = 18) -> Column:
    """1 when the hour is within ``start..end``, both inclusive."""
    return F.hour(_col(ts)).between(start, end).cast("int")


def day_label(ts: Column | str, start: int = 6, end: int = 18) -> Column:
    """``day`` / ``night``, NULL kept."""
    ts = _col(ts)
    return F.when(ts.isNull(), F.lit(None).cast("string")).when(
        F.hour(ts).between(start, end), "day"
    ).otherwise("night")
