"""Severity ladders and number rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventlens.functions.arrays import col


def _ladder(key: Column, steps: dict) -> Column:
    out = F.lit(0)
    for k, v in steps.items():
        out = F.when(key == k, v).otherwise(out)
    return out.cast("int")


def severity_from_magnitude(c: Column | str) -> Column:
    m = finite_between(c, -5, 15)
    return F.when(m >= 7, 4).when(m >= 5.5, 3).when(m >= 4, 2).when(m.isNotNull(), 1).otherwise(0)


def severity_from_alert(c: Column | str) -> Column:
    return _ladder(F.lower(F.trim(col(c))), {"green": 1, "yellow": 2, "orange": 3, "red": 4})


def severity_from_degree(c: Column | str) -> Column:
    """Flood degree; drought (-1) has none."""
    return _ladder(col(c).try_cast("int"), {1: 2, 2: 3, 3: 4})


def severity_from_impact(c: Column | str) -> Column:
    return _ladder(F.lower(F.trim(col(c))), {"none": 1, "minor": 2, "major": 3, "critical": 4})


def severity_from_cap(c: Column | str) -> Column:
    return _ladder(F.lower(F.trim(col(c))), {"minor": 1, "moderate": 2, "severe": 3, "extreme": 4})


def finite_between(c: Column | str, low: float, high: float) -> Column:
    x = col(c).try_cast("double")
    return F.when(~F.isnan(x) & x.between(low, high), x)


def window_hours(since: Column | str, until: Column | str) -> Column:
    """Width in whole hours, rounded up, within 1 to 720."""
    seconds = F.unix_micros(col(until)) - F.unix_micros(col(since))
    return F.greatest(F.lit(1), F.least(F.lit(720), F.ceil(seconds / 3.6e9))).cast("int")
