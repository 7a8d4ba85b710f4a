"""Calendars of named months without leap days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_date(day: Column, months: Sequence[tuple[str, int]]) -> Column:
    """struct(year from 0, month name, day from 1) of a day number (floored)."""
    length = sum(n for _, n in months)
    d = F.floor(day)
    rem = F.pmod(d, F.lit(length))
    out, before = F.lit(None).cast("struct<year:bigint,month:string,day:bigint>"), 0
    for name, n in months:
        date = F.struct(F.floor(d / length).alias("year"), F.lit(name).alias("month"), (rem - before + 1).alias("day"))
        out = F.when((rem >= before) & (rem < before + n), date).otherwise(out)
        before += n
    return out


def to_day(year: Column, month: Column, day: Column, months: Sequence[tuple[str, int]]) -> Column:
    """Day number of a date; null for an unknown month."""
    length, before, start = sum(n for _, n in months), 0, F.lit(None).cast("long")
    for name, n in months:
        start = F.when(month == name, F.lit(before)).otherwise(start)
        before += n
    return year * length + start + day - 1
