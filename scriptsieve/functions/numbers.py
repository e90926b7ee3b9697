"""Arithmetic on doubles with the results of the SQL, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int) -> Column:
    """x times a power of ten, to the nearest whole number (halves away from zero), divided again, all as doubles; F.round goes by decimal digits, which differs in the last bit. What overflows stays as it is."""
    unit = F.lit(10.0**digits)
    scaled = x * unit
    part = scaled % F.lit(1.0)
    whole = scaled - part + F.when(part >= 0.5, 1.0).when(part <= -0.5, -1.0).otherwise(0.0)
    return F.when(F.abs(scaled) < float("inf"), whole / unit).otherwise(x)
