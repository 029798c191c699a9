"""Interval and test statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval of a share ``p`` of ``n``."""
    zz = z * z
    d = 1 + F.lit(zz) / n
    centre = (p + F.lit(zz) / (2 * n)) / d
    half = F.sqrt(p * (1 - p) / n + F.lit(zz) / (4 * n * n)) * z / d
    return centre - half, centre + half


def sign_p(a: Column, b: Column) -> Column:
    """Exact two-sided sign test of ``a`` wins against ``b`` wins; 1 when there are none.

    The tail is summed from the smaller count downwards in relative terms: term(i-1) = term(i) * i / (n-i+1), so
    thousands of discordant pairs neither overflow nor lose precision. The leading term comes from a log sum."""
    n = (a + b).cast("long")
    k = F.least(a, b).cast("long")
    log_top = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))), F.lit(0.0),
        lambda acc, i: acc + F.when(i <= k, F.log((n - k + i).cast("double")) - F.log(i.cast("double"))).otherwise(0.0))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("acc"))
    relative = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))), start,
        lambda s, j: F.struct(
            F.when(j <= k, s["term"] * (k - j + 1) / (n - k + j)).otherwise(0.0).alias("term"),
            (s["acc"] + F.when(j <= k, s["term"] * (k - j + 1) / (n - k + j)).otherwise(0.0)).alias("acc")))
    tail = F.exp(log_top + F.log(relative["acc"]) - n * F.log(F.lit(2.0)) + F.log(F.lit(2.0)))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), tail))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, NULL where the denominator is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))
