"""Numeric rules that differ between array code and Spark, said once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = "double('NaN')"


def ratio(num: Column, den: Column) -> Column:
    """num / den, NaN where the denominator is zero (ANSI division would raise)."""
    return F.when(den != 0, num.cast("double") / den.cast("double")).otherwise(F.lit(float("nan")))


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    d = x.cast("double")
    return F.coalesce(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), F.lit(False))


def at_least(x: Column, threshold: Column | float) -> Column:
    """x >= threshold as array code has it: NaN is never at least anything, while Spark sorts it above all numbers."""
    bound = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.coalesce(~F.isnan(x.cast("double")) & (x >= bound), F.lit(False))


def between_f32(x: Column, low: Column | float, high: Column | float) -> Column:
    """low <= x <= high with value and bounds as 32-bit floats; false for NaN and null."""
    as32 = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("float")
    return F.coalesce(~F.isnan(x.cast("float")) & (x.cast("float") >= as32(low)) & (x.cast("float") <= as32(high)), F.lit(False))


def quantile_higher(values: Column, q: float) -> Column:
    """Element at ceil(q * (n - 1)) of the sorted array: the 'higher' rule, which percentile_disc does not follow."""
    at = F.ceil(F.lit(q) * (F.size(values) - 1)).cast("int") + 1
    return F.when(F.size(values) > 0, F.element_at(F.sort_array(values), at))


def clamp(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; null stays null (``greatest`` alone would take the bound)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))
