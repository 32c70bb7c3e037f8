"""Rounding, progress and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 0) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: the same in every engine, unlike round()."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def progress_percent(done: Column, total: Column) -> Column:
    """Two digits; a job without chunks has none."""
    return round_half_up(F.try_divide(done, total) * F.lit(100.0), 2)


def upload_percent(index: Column, parts: Column) -> Column:
    """Whole percent up to 90 while parts arrive."""
    return F.floor((index + F.lit(1)) / parts * F.lit(90.0) + F.lit(0.5)).cast("int")


def show_percent(share: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(share * 100, digits), F.lit("%"))


def show_area(area: Column) -> Column:
    return F.concat(F.format_number(area, 0), F.lit(" px"))
