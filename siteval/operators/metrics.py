"""Aggregates over a site table with a true class ``y`` and a predicted class ``pred`` (class indices).

Everything derives from per-class counts, so each function is one partial-then-final hash aggregation whatever the skew of
the grouping keys; zero cells come from literal arrays, never from a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteval.constants import AMPUTATION, CLASSES, COST, NOT_TESTABLE, WOUND
from siteval.functions.stats import safe_ratio
from siteval.runtime import case, total


def count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def share_if(cond: Column, among: Column | None = None) -> Column:
    """Share of rows meeting ``cond`` among those meeting ``among``; NULL when there are none."""
    if among is None:
        return safe_ratio(count_if(cond), F.count(F.lit(1)))
    return safe_ratio(count_if(among & cond), count_if(among))


def confusion(df: DataFrame, y: str = "y", pred: str = "pred", by=(), k: int = 4) -> DataFrame:
    """K x K counts, zero cells included."""
    cells = [(i, j) for i in range(k) for j in range(k)]
    wide = df.groupBy(*by).agg(*[count_if((F.col(y) == i) & (F.col(pred) == j)).alias(f"c{i}_{j}") for i, j in cells])
    long = F.array(*[F.struct(F.lit(i).alias("truth"), F.lit(j).alias("pred"), F.col(f"c{i}_{j}").alias("n")) for i, j in cells])
    return wide.select(*by, F.explode(long).alias("_c")).select(*by, "_c.truth", "_c.pred", "_c.n")


def _class_counts(df: DataFrame, y: str, pred: str, by, k: int) -> DataFrame:
    """One row per group: n, correct, and per class support s, predicted m, hits t; plus false-call counts."""
    yy, pp = F.col(y), F.col(pred)
    seen = (yy != NOT_TESTABLE)
    aggs = [F.count(F.lit(1)).alias("n"), count_if(yy == pp).alias("correct"),
            count_if((yy != WOUND) & seen).alias("not_wound"), count_if((yy != WOUND) & seen & (pp == WOUND)).alias("called_wound"),
            count_if((yy != AMPUTATION) & seen).alias("not_amp"),
            count_if((yy != AMPUTATION) & seen & (pp == AMPUTATION)).alias("called_amp")]
    for c in range(k):
        aggs += [count_if(yy == c).alias(f"s{c}"), count_if(pp == c).alias(f"m{c}"), count_if((yy == c) & (pp == c)).alias(f"t{c}")]
    return df.groupBy(*by).agg(*aggs)


def _recall(c: int) -> Column:
    return safe_ratio(F.col(f"t{c}"), F.col(f"s{c}"))


def _f1(c: int) -> Column:
    return safe_ratio(F.col(f"t{c}") * 2, F.col(f"s{c}") + F.col(f"m{c}"))


def _macro(k: int, over: str) -> Column:
    """Mean F1 over labels in truth or prediction ('either') or over labels in truth ('truth', 'support')."""
    if over not in ("either", "truth", "support"):
        raise ValueError(f"unknown macro-F1 variant {over!r}")
    kept = [F.when(F.col(f"s{c}") > 0, _f1(c)) if over != "either" else _f1(c) for c in range(k)]
    return safe_ratio(total([F.coalesce(v, F.lit(0.0)) for v in kept]), total([v.isNotNull().cast("int") for v in kept]))


def class_metrics(df: DataFrame, y: str = "y", pred: str = "pred", by=(), k: int = 4) -> DataFrame:
    """Precision, recall, F1 and support per class. Undefined ratios are NULL; F1 is then 0."""
    wide = _class_counts(df, y, pred, by, k)
    rows = F.array(*[F.struct(
        F.lit(c).alias("class"), F.col(f"s{c}").alias("support"), safe_ratio(F.col(f"t{c}"), F.col(f"m{c}")).alias("precision"),
        _recall(c).alias("recall"), F.coalesce(_f1(c), F.lit(0.0)).alias("f1")) for c in range(k)])
    return wide.select(*by, F.explode(rows).alias("_c")).select(*by, "_c.*")


def score_metrics(df: DataFrame, y: str = "y", pred: str = "pred", by=(), k: int = 4, over: str = "either") -> DataFrame:
    """n, accuracy, macro F1, smallest recall of a present class, false-wound and false-amputation rates."""
    recalls = [_recall(c) for c in range(k)]
    return _class_counts(df, y, pred, by, k).select(
        *by, "n", safe_ratio(F.col("correct"), F.col("n")).alias("acc"), _macro(k, over).alias("macro_f1"),
        F.least(*recalls).alias("min_recall"),
        safe_ratio(F.col("called_wound"), F.col("not_wound")).alias("false_wound"),
        safe_ratio(F.col("called_amp"), F.col("not_amp")).alias("false_amp"))


def macro_f1(df: DataFrame, y: str = "y", pred: str = "pred", by=(), k: int = 4) -> DataFrame:
    """All macro-F1 variants side by side."""
    return _class_counts(df, y, pred, by, k).select(
        *by, *[_macro(k, v).alias(f"macro_f1_{v}") for v in ("either", "truth", "support")])


def accuracy(df: DataFrame, keys, y: str = "y", pred: str = "pred") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), share_if(F.col(y) == F.col(pred)).alias("acc"))


def majority_baseline(df: DataFrame, y: str = "y", by=(), k: int = 4) -> DataFrame:
    """Majority class of the truth (lowest index on ties) and the accuracy of always answering it."""
    wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[count_if(F.col(y) == c).alias(f"s{c}") for c in range(k)])
    top = F.greatest(*[F.col(f"s{c}") for c in range(k)])
    return wide.select(*by, case([(F.col(f"s{c}") == top, c) for c in range(k)]).alias("majority"),
                       safe_ratio(top, F.col("n")).alias("majority_acc"))


def cost_per_site(df: DataFrame, y: str = "y", pred: str = "pred", by=(), cost=COST) -> DataFrame:
    """Mean of a cost matrix (truth rows, predicted columns)."""
    cell = case([((F.col(y) == i) & (F.col(pred) == j), int(cost[i][j])) for i in range(len(cost)) for j in range(len(cost[i]))])
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), safe_ratio(F.sum(cell.cast("long")), F.count(F.lit(1))).alias("cost"))


def slice_metrics(df: DataFrame, slices: dict[str, Column], y: str = "y", pred: str = "pred", by=()) -> DataFrame:
    """Accuracy and per-class recall for every value of several slice columns, in one aggregation over stacked slices."""
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("slice"), c.cast("string").alias("value")) for n, c in slices.items()]))
    rows = df.select(*by, F.col(y).alias("_y"), F.col(pred).alias("_p"), stacked.alias("_s")).select(*by, "_y", "_p", "_s.slice", "_s.value")
    yy, pp = F.col("_y"), F.col("_p")
    return rows.groupBy(*by, "slice", "value").agg(
        F.count(F.lit(1)).alias("n"), share_if(yy == pp).alias("acc"),
        *[share_if(pp == c, yy == c).alias(f"recall_{CLASSES[c]}") for c in (WOUND, AMPUTATION)])


def condition_rates(df: DataFrame, conditions: Column, y: str = "y", pred: str = "pred") -> DataFrame:
    """False-wound and false-amputation rates under every condition a row meets."""
    rows = df.select(F.col(y).alias("_y"), F.col(pred).alias("_p"), F.explode(conditions).alias("condition"))
    yy, pp = F.col("_y"), F.col("_p")
    def negatives(c):
        return (yy != c) & (yy != NOT_TESTABLE)
    return rows.groupBy("condition").agg(
        count_if(negatives(WOUND)).alias("n_wound"), share_if(pp == WOUND, negatives(WOUND)).alias("false_wound"),
        count_if(negatives(AMPUTATION)).alias("n_amp"), share_if(pp == AMPUTATION, negatives(AMPUTATION)).alias("false_amp"))


def label_counts(df: DataFrame, label: str, keys) -> DataFrame:
    return df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, label: str, feature: Column, name: str = "feature", by=()) -> DataFrame:
    """Sparse counts of label by a derived feature."""
    return df.select(*by, label, feature.alias(name)).groupBy(*by, label, name).agg(F.count(F.lit(1)).alias("n"))


def binned_recall(df: DataFrame, size: Column, edges, target: int, y: str = "y", pred: str = "pred") -> DataFrame:
    """Recall of one class by half-open size bins [a, b)."""
    label = case([((F.col("_size") >= a) & (F.col("_size") < b), f"{a}-{b}") for a, b in edges])
    rows = df.filter(F.col(y) == target).select(size.alias("_size"), (F.col(pred) == target).alias("_hit"))
    return (rows.withColumn("bin", label).filter(F.col("bin").isNotNull()).groupBy("bin")
            .agg(F.count(F.lit(1)).alias("n"), share_if(F.col("_hit")).alias("recall")))


def class_weights(df: DataFrame, y: str = "y", k: int = 4) -> DataFrame:
    """Inverse square-root frequency with add-one counts, scaled to mean 1."""
    wide = df.agg(*[(count_if(F.col(y) == c) + 1).cast("double").alias(f"f{c}") for c in range(k)])
    s = total([F.col(f"f{c}") for c in range(k)])
    w = [F.sqrt(s / F.col(f"f{c}")) for c in range(k)]
    mean = total(w) / k
    rows = F.array(*[F.struct(F.lit(c).alias("class"), (w[c] / mean).alias("weight")) for c in range(k)])
    return wide.select(F.explode(rows).alias("_w")).select("_w.*")


def aux_metrics(df: DataFrame, pairs: dict[str, tuple[str, str]], vis: str, vis_true: str, threshold: float = 0.1) -> DataFrame:
    """Accuracy of auxiliary labels where present (negative or NULL truth is masked), and error of a visibility estimate."""
    aggs = [share_if(F.col(p) == F.col(t), F.coalesce(F.col(t) >= 0, F.lit(False))).alias(f"{n}_accuracy") for n, (p, t) in pairs.items()]
    known = F.coalesce(F.col(vis_true) >= 0, F.lit(False))
    return df.agg(*aggs, F.avg(F.when(known, F.abs(F.col(vis) - F.col(vis_true)))).alias("visibility_mae"),
                  share_if((F.col(vis) >= threshold) == (F.col(vis_true) >= threshold), known).alias("visibility_threshold_accuracy"))


def cutoff_agreement(df: DataFrame, estimate: str, truth: str, cut: float, by=()) -> DataFrame:
    """Share of rows on the same side of a cut-off, and mean absolute error of the estimate."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), share_if((F.col(estimate) >= cut) == (F.col(truth) >= cut)).alias("agreement"),
                               F.avg(F.abs(F.col(estimate) - F.col(truth))).alias("mae"))


def coverage(df: DataFrame, columns) -> DataFrame:
    """Share of rows where each column is present."""
    return df.agg(*[share_if(F.col(c).isNotNull()).alias(c) for c in columns])


def stage_of_error(y: Column, pred: Column, swapped: Column) -> Column:
    """laterality_swap, then visibility, then state; NULL when right."""
    return F.when(y == pred, None).otherwise(
        F.when(swapped, "laterality_swap").when((y == NOT_TESTABLE) != (pred == NOT_TESTABLE), "visibility").otherwise("state"))
