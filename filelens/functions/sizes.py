"""Byte weights and their renderings. Byte counts stay integral throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filelens.functions import classify


def survey_bytes(residency: Column, allocated: Column, logical: Column) -> Column:
    """Here: what the disk gave it. In the cloud: what bringing it down takes."""
    return F.when(
        classify.survey_local(residency), F.coalesce(allocated, logical)
    ).otherwise(logical)


def summary_bytes(allocated: Column, logical: Column) -> Column:
    """Allocated or logical, whatever the residency."""
    return F.coalesce(allocated, logical)


# Decimal units of the two renderings.
REPORT_UNITS = (("TB", 10**12), ("GB", 10**9), ("MB", 10**6), ("kB", 10**3))
WINDOW_UNITS = (("PB", 10**15), ("TB", 10**12), ("GB", 10**9), ("MB", 10**6), ("KB", 10**3))


def _div(value: Column, by: int) -> Column:
    return F.call_function("div", value, F.lit(by).cast("long"))


def human_bytes(value: Column) -> Column:
    """Truncated tenths in decimal units up to TB, in integer arithmetic."""
    text = F.concat(value.cast("string"), F.lit(" bytes"))
    chain = None
    for unit, scale in REPORT_UNITS:
        rest = F.pmod(value, F.lit(scale))
        whole, tenths = _div(value, scale), _div(rest * 10, scale)
        shown = F.concat(whole.cast("string"), F.lit("."), tenths.cast("string"), F.lit(f" {unit}"))
        chain = (F if chain is None else chain).when(value >= scale, shown)
    return chain.otherwise(text)


def window_bytes(value: Column) -> Column:
    """One truncated decimal below ten, none above; units up to PB."""
    chain = F.when(value < 1000, F.concat(value.cast("string"), F.lit(" bytes")))
    for unit, scale in WINDOW_UNITS:
        tenths, whole = _div(value, scale // 10), _div(value, scale)
        digit = F.pmod(tenths, F.lit(10)).cast("string")
        small = F.concat(
            whole.cast("string"),
            F.when(digit == "0", F.lit("")).otherwise(F.concat(F.lit("."), digit)),
        )
        shown = F.when(whole < 10, small).otherwise(whole.cast("string"))
        chain = chain.when(value >= scale, F.concat(shown, F.lit(f" {unit}")))
    return chain
