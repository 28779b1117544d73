"""Column helpers shared by the operators.

Spark 4 runs in ANSI mode, where ``x / 0`` and ``corr`` on a constant group
raise.  Every ratio here goes through ``try_divide`` so that an undefined
statistic is null, never NaN and never an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: str | Column, b: str | Column) -> Column:
    """``a / b``; null where b is zero or either side is null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def missing(c: str | Column) -> Column:
    """Null or NaN."""
    c = col(c).cast("double")
    return c.isNull() | F.isnan(c)


def infinite(c: str | Column) -> Column:
    return F.coalesce(F.abs(col(c).cast("double")) == F.lit(float("inf")), F.lit(False))


def average_rank(value: str | Column, by: Sequence[str]) -> Column:
    """Rank from 1 within ``by``; tied values share the mean of their ranks."""
    value = col(value)
    ordered = Window.partitionBy(*by).orderBy(value)
    ties = Window.partitionBy(*by, value)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)




def pearson(x: str | Column, y: str | Column) -> Column:
    """Aggregate: correlation, null for fewer than two rows or a constant side, within [-1, 1]."""
    x, y = col(x).cast("double"), col(y).cast("double")
    r = F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))
    # A constant side can have a variance of rounding errors.
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when((F.count(x) >= 2) & varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def sharpe(x: str | Column, annualization: float = 1.0) -> Column:
    """Aggregate: mean over sample deviation, scaled; null when undefined."""
    return F.try_divide(F.avg(x), F.stddev_samp(x)) * F.lit(float(annualization) ** 0.5)


def herfindahl(share: str | Column) -> Column:
    return F.sum(F.pow(col(share), 2))
