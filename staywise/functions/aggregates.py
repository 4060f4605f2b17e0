"""Aggregate expressions the built-in set lacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation over rows with both values; a constant column gives NULL.

    The built-in ``corr`` divides by zero there, an error in ANSI mode.
    """
    a = (F.col(a) if isinstance(a, str) else a).cast("double")
    b = (F.col(b) if isinstance(b, str) else b).cast("double")
    spread = F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b))
    return F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0))
