"""Numeric column helpers that never raise and never leak NaN."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c) -> Column:
    """Lenient double: text that is no number, and NaN, become NULL."""
    value = col(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def whole(c) -> Column:
    return F.trim(col(c)).try_cast("int")


def ratio(num, den) -> Column:
    """``num / den`` where the denominator is positive, else NULL."""
    den = col(den)
    return F.when(den > 0, col(num) / den)


def log_cost(c) -> Column:
    return F.log1p(col(c))


def gap_to_progress(share, progress) -> Column:
    """A share in percentage points less the reported progress."""
    return col(share) * F.lit(100.0) - col(progress)


def clip(c, low, high) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def logit(p, eps=1e-6) -> Column:
    p = clip(p, eps, 1.0 - eps)
    return F.log(p / (F.lit(1.0) - p))


def sigmoid(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(z)))


def flag(condition) -> Column:
    """1 where true, 0 where false, NULL where unknown."""
    return condition.cast("int")
