"""Display text for durations, numbers and booleans."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from flowspark.functions.scalar import _col


def _half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5)).cast("long")


def _plural(n: Column, unit: str, one: Column) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(one, "").otherwise("s"))


def fmt_duration(c) -> Column:
    """Seconds as ``250ms``, ``2 seconds``, ``1 minute`` or ``3 hours``."""
    c = _col(c)
    minutes, hours = _half_up(c / 60), _half_up(c / 3600)
    return (
        F.when(c < 1, F.concat(_half_up(c * 1000).cast("string"), F.lit("ms")))
        .when(c < 60, _plural(_half_up(c), "second", c == 1))
        .when(c < 3600, _plural(minutes, "minute", minutes == 1))
        .otherwise(_plural(hours, "hour", hours == 1))
    )


def fmt_pct(c) -> Column:
    """Number with thousands separators and four decimals, halves rounded away from zero."""
    return F.format_number(F.round(_col(c).cast("decimal(38,10)"), 4), 4)


def fmt_seconds(c) -> Column:
    """As :func:`fmt_pct`, followed by ``s``."""
    return F.concat(fmt_pct(c), F.lit("s"))


def fmt_compact(c) -> Column:
    """Short form of a non-negative count: two significant digits below 100 of a unit."""
    c = _col(c).cast("double")

    def short(scale: float) -> Column:
        tenths = _half_up(c / F.lit(scale) * 10)
        whole = _half_up(c / F.lit(scale))
        return F.when(
            (tenths < 100) & (tenths % 10 != 0),
            F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string")),
        ).otherwise(whole.cast("string"))

    def below(scale: float) -> Column:
        return _half_up(c / F.lit(scale)) < 1000

    return (
        F.when(below(1.0), short(1.0))
        .when(below(1e3), F.concat(short(1e3), F.lit("K")))
        .when(below(1e6), F.concat(short(1e6), F.lit("M")))
        .when(below(1e9), F.concat(short(1e9), F.lit("B")))
        .otherwise(F.concat(short(1e12), F.lit("T")))
    )


def fmt_bool(c) -> Column:
    return F.when(_col(c), "True").otherwise("False")
