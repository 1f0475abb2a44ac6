"""Percentages, floors and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percentage(covered: Column, total: Column) -> Column:
    """Two decimals, half away from zero; an empty denominator is complete."""
    return F.when(total == 0, F.lit(100.0)).otherwise(F.round(covered / total * 10000) / 100)


def parse_percentage(text: Column) -> Column:
    """A percentage as parts per million, null where it is not one of 0..100
    with at most four decimals."""
    trimmed = F.trim(text)
    well_formed = trimmed.rlike(r"^([0-9]+(\.[0-9]{0,4})?|\.[0-9]{1,4})$")
    padded = F.concat(F.lit("0"), F.regexp_replace(trimmed, r"\.$", ""))
    ppm = (padded.try_cast("decimal(30,4)") * 10000).cast("decimal(38,0)")
    return F.when(well_formed & (ppm <= 1_000_000), ppm.cast("long"))


def meets(covered: Column, eligible: Column, ppm: Column) -> Column:
    """Whether a share reaches a floor, compared in integers."""
    wide = "decimal(38,0)"
    return covered.cast(wide) * F.lit(1_000_000).cast("decimal(10,0)") >= ppm.cast("decimal(18,0)") * eligible.cast("decimal(18,0)")


def band(health: Column) -> Column:
    """The word for a health of 0..10, read at one decimal."""
    shown = F.round(health, 1)
    return F.when(shown >= 8, "good").when(shown >= 5, "fair").otherwise("weak")
