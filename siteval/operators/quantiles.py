"""Exact quantiles that never gather a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_ACCURACY = 100_000
_MARGIN = 3 / _ACCURACY
#: tasks that the rows of one group are dealt to, at most, where they meet their brackets
_SALTS = 8


def exact_quantiles(df: DataFrame, value: Column, qs, by=(), names=None) -> DataFrame:
    """Linear-interpolation quantiles of ``value`` per group: (by…, n, names…). NULL values are left out.

    Pass 1 sketches a narrow bracket around every wanted rank. Pass 2 counts rows: one counter per distinct value inside a
    bracket, one counter with minimum and maximum for each stretch between brackets. Only those counters are ordered, so a
    group of any size costs a partial aggregation plus a window over a few counters. Rows meet the brackets of their group in a hash join
    over salted groups: no task sorts a group."""
    names = names or [f"q{round(q * 1000):03d}" for q in qs]
    by = list(by)
    base = df.select(*by, value.cast("double").alias("_v")).filter("_v IS NOT NULL")
    marks = sorted({max(0.0, q - _MARGIN) for q in qs} | {min(1.0, q + _MARGIN) for q in qs})
    at = {m: i for i, m in enumerate(marks)}
    sketch = F.percentile_approx("_v", [float(m) for m in marks], _ACCURACY)
    if by:
        keys = [f"_k{i}" for i in range(len(by))]
        brackets = base.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys)]).agg(sketch.alias("_b"))
        brackets = brackets.withColumn("_part", F.explode(F.array(*[F.lit(i) for i in range(_SALTS)])))
        base = base.withColumn("_salt", F.spark_partition_id() % _SALTS)
        on = base["_salt"] == brackets["_part"]
        for c, k in zip(by, keys):
            on = on & base[c].eqNullSafe(brackets[k])
        rows = base.join(brackets.hint("shuffle_hash"), on)
        b = F.col("_b")
    else:
        rows = base.select("_v", base.agg(sketch).scalar().alias("_b"))
        b = F.col("_b")
    pairs = [(b[at[max(0.0, q - _MARGIN)]], b[at[min(1.0, q + _MARGIN)]]) for q in qs]
    inside, below = F.lit(False), []
    for lo, hi in pairs:
        inside = inside | ((F.col("_v") >= lo) & (F.col("_v") <= hi))
        below.append(F.when(hi < F.col("_v"), hi))
    last = below[0] if len(below) == 1 else F.greatest(*below)
    counted = rows.select(*by, "_v", inside.alias("_in"), F.when(inside, F.col("_v")).otherwise(last).alias("_key"))
    counters = counted.groupBy(*by, "_key", (~F.col("_in")).alias("_gap")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    ordered = W.partitionBy(*by).orderBy(F.col("_key").asc_nulls_first(), "_gap")
    ranked = counters.withColumn("_end", F.sum("_c").over(ordered)).withColumn("_n", F.sum("_c").over(W.partitionBy(*by)))
    start = F.col("_end") - F.col("_c")

    def at_rank(r: Column) -> Column:
        here = (r >= start) & (r < F.col("_end"))
        exact = F.when(~F.col("_gap") | (r == start), F.col("_min")).when(r == F.col("_end") - 1, F.col("_max"))
        return F.max(F.when(here, exact))

    aggs = [F.first("_n").alias("n")]
    for i, q in enumerate(qs):
        k = F.floor((F.col("_n") - 1) * F.lit(float(q)))
        aggs += [at_rank(k).alias(f"_lo{i}"), at_rank(F.least(k + 1, F.col("_n") - 1)).alias(f"_hi{i}")]
    picked = ranked.groupBy(*by).agg(*aggs)
    out = []
    for i, (q, name) in enumerate(zip(qs, names)):
        h = (F.col("n") - 1) * F.lit(float(q))
        out.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (h - F.floor(h))).alias(name))
    return picked.select(*by, "n", *out)


def exact_median(df: DataFrame, value: Column, by=(), name: str = "median") -> DataFrame:
    return exact_quantiles(df, value, [0.5], by, [name])


def with_scalars(df: DataFrame, one_row: DataFrame, names=None) -> DataFrame:
    """``df`` with the columns of a one-row table added as constants; one subquery serves them all."""
    names = names or one_row.columns
    row = one_row.select(F.struct(*names).alias("_r")).scalar()
    return df.withColumn("_r", row).select(*df.columns, *[F.col("_r")[n].alias(n) for n in names])
