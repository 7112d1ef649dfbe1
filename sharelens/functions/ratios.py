from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den as double; null on a zero or null denominator."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def ratio6(num, den) -> Column:
    return F.round(ratio(num, den), 6)


def percent3(num, den) -> Column:
    return F.round(100 * ratio(num, den), 3)


def count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    x = x if low is None else F.greatest(x, F.lit(low))
    return x if high is None else F.least(x, F.lit(high))
