"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed to cells of source, language and topic. The cells are raked until their sums meet the target
shares of all three or, where temperature targets contradict each other, come as near as they can. The ratio of fitted to
original tokens of a cell is the weight of its documents, and a document is taken that many times on average.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteval.functions.hashing import uniform
from siteval.llm.common import settled, table
from siteval.runtime import case

AXES = ("source", "lang", "topic")
#: target shares follow the token shares to this power: 1 keeps them, 0 makes all values of an axis equal
TEMPERATURE = {"source": 0.7, "lang": 0.8, "topic": 1.0}
#: the relative error of every margin at which raking ends
TOLERANCE = 1e-6
#: rounds in a row in which the error hardly falls (less than a thousandth) after which targets count as contradictory
STALLED = 3
#: cells that the driver rakes by itself; more are raked by Spark, with the same rules
LOCAL = 200_000
NONE = "(none)"


def tokens_of(text: Column) -> Column:
    """Tokens estimated as a quarter of the UTF-8 bytes, rounded up; no text has none."""
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic from the form of a text: tables, markup or code, short notes, prose."""
    return case([(text.isNull(), NONE), (text.contains(" | "), "table"), (text.rlike(r"[{}<>=#$%&*]{2}|://"), "markup"), (F.octet_length(text) < 400, "note")], "prose")


def cells_of(documents: DataFrame, tokens: Column, axes: dict[str, Column]) -> DataFrame:
    """(source, lang, topic, n): tokens by cell, summed in every task before they are dealt out."""
    return documents.select(*[F.coalesce(c.cast("string"), F.lit(NONE)).alias(a) for a, c in axes.items()], tokens.alias("n")).groupBy(*axes).agg(F.sum("n").alias("n"))


def targets_of(cells: DataFrame, axis: str, share: float | dict) -> DataFrame:
    """(axis, target): shares of all tokens that sum to 1. A number is a temperature; a dict gives shares of values, in proportion
    for those that occur; what it does not name gets none."""
    if isinstance(share, dict):
        wanted = cells.select(axis).distinct().withColumn("raw", case([(F.col(axis) == k, float(v)) for k, v in share.items()], 0.0))
    else:
        wanted = cells.groupBy(axis).agg(F.pow(F.sum("n").cast("double"), F.lit(float(share))).alias("raw"))
    whole = wanted.agg(F.sum("raw")).first()[0] or 1.0
    return wanted.select(axis, (F.col("raw") / F.lit(whole)).alias("target"))


class _Local:
    """Weights of cells on the driver."""

    def __init__(self, cells: DataFrame, goal: dict):
        self.cells = cells.toPandas()
        self.n = self.cells.n.to_numpy(float)
        self.codes, self.goal = {}, {}
        for a, g in goal.items():
            names, self.codes[a] = np.unique(self.cells[a].to_numpy(), return_inverse=True)
            self.goal[a] = g.toPandas().set_index(a).target.loc[names].to_numpy()

    def start(self):
        return self.n / self.n.sum()

    def factors(self, w, axis):
        m = np.bincount(self.codes[axis], w)
        return np.divide(self.goal[axis], m, out=np.zeros(len(m)), where=m > 0)[self.codes[axis]], m

    def scaled(self, w, axes, power):
        return w * np.prod([self.factors(w, a)[0] ** power for a in axes], axis=0)

    def off(self, w):
        """The largest relative error of a margin, and the sum over the axes of the divergence of margins from targets."""
        pairs = [(self.factors(w, a)[1], self.goal[a]) for a in self.goal]
        gap = lambda m, t: np.where(m > 0, m * np.log(np.maximum(m, 1e-300) / np.maximum(t, 1e-300)), 0.0) - m + t
        return max(float((np.abs(m - t) / np.maximum(t, 1e-12)).max()) for m, t in pairs), sum(float(gap(m, t).sum()) for m, t in pairs)

    def result(self, w):
        return settled(SparkSession.active().createDataFrame(self.cells[[*AXES, "n"]].assign(w=w), "source string, lang string, topic string, n long, w double"), "raked")


class _Spread:
    """Weights of cells in tables: every step is an aggregation and a join on the axis, so the number of values of an axis is not bounded."""

    def __init__(self, cells: DataFrame, goal: dict):
        self.cells, self.goal = cells, goal

    def start(self):
        return self.cells.withColumn("w", F.col("n") / F.lit(float(self.cells.agg(F.sum("n")).first()[0])))

    def scaled(self, w, axes, power):
        for a in axes:
            m = w.groupBy(a).agg(F.sum("w").alias("m")).join(self.goal[a], a).select(a, F.when(F.col("m") > 0, F.pow(F.col("target") / F.col("m"), F.lit(float(power)))).otherwise(0.0).alias(f"f_{a}"))
            w = w.join(m, a)
        f = F.lit(1.0)
        for a in axes:
            f = f * F.col(f"f_{a}")
        return settled(w.select(*AXES, "n", (F.col("w") * f).alias("w")), "raked")

    def off(self, w):
        worst, total = 0.0, 0.0
        for a, goal in self.goal.items():
            m = w.groupBy(a).agg(F.sum("w").alias("m")).join(goal, a)
            gap = F.when(F.col("m") > 0, F.col("m") * F.log(F.col("m") / F.greatest("target", F.lit(1e-300)))).otherwise(0.0) - F.col("m") + F.col("target")
            r = m.agg(F.max(F.abs(F.col("m") - F.col("target")) / F.greatest("target", F.lit(1e-12))).alias("e"), F.sum(gap).alias("d")).first()
            worst, total = max(worst, r.e), total + r.d
        return worst, total

    def result(self, w):
        return w


def rake(cells: DataFrame, shares: dict, tolerance: float = TOLERANCE, local: int = LOCAL) -> DataFrame:
    """Cells with fitted shares ``w`` whose sums over each axis meet its targets, and ``off``, the largest relative error of a sum.

    Temperature targets may contradict each other, where a source and a language occur only together. They then end with the best
    fit: the sum over the axes of the divergence (Kullback-Leibler) of sums from targets is the least. Where a share is
    given by value, margins that cannot be met raise a ValueError. Raking goes on as long as the error falls."""
    cells = settled(cells.filter("n > 0"), "cells")
    if cells.isEmpty():
        return cells.withColumns({"w": F.lit(0.0), "off": F.lit(0.0)})
    goal = {a: settled(targets_of(cells, a, s), f"target-{a}") for a, s in shares.items()}
    own = (_Local if cells.count() <= local else _Spread)(cells, goal)
    w, last, stalled, done = own.start(), float("inf"), 0, 0
    while stalled < STALLED:
        for axis in shares:
            w = own.scaled(w, [axis], 1.0)
        done += 1
        worst, _ = own.off(w)
        if worst <= tolerance:
            return own.result(w).withColumn("off", F.lit(worst))
        stalled = stalled + 1 if worst >= 0.999 * last else 0
        last = worst
    if any(isinstance(s, dict) for s in shares.values()):
        raise ValueError(f"margins off by {worst:.3g} after {done} rounds: targets and cells contradict each other")
    # All axes at once, each with its part of the exponent: this comes to the best fit also where there is no exact one.
    w, last, stalled = own.start(), float("inf"), 0
    while stalled < STALLED:
        w = own.scaled(w, list(shares), 1.0 / len(shares))
        worst, gap = own.off(w)
        stalled = stalled + 1 if gap >= (1 - 1e-6) * last else 0
        last = gap
    return own.result(w).withColumn("off", F.lit(worst))


def mixed(documents: DataFrame, key: str = "doc_id", text: str = "text", shares: dict | None = None, rate: float = 1.0, seed: int = 0) -> DataFrame:
    """All columns of ``documents`` and _tokens, _topic, _weight (fitted over original share of its cell), _off (error of the margins),
    _copies, _probability, _kept.

    _copies is how often a document is taken: ``rate`` times its weight, the whole part for certain and one more with the remainder as
    probability. The expected tokens are ``rate`` times all tokens and their shares are the fitted ones, and a rare cell repeats
    instead of thinning out the others. _probability and _kept are for a sample without repeats, which the rarest cell bounds.

    The probability is ``rate`` times the weight over the largest weight: the largest sample in which no document is drawn
    more than once and whose expected token shares meet all targets. The draw is a hash of the id, so it repeats. Null
    source, language and topic are a value of their own. Documents without tokens have weight and probability 0: they carry
    none of the shares and are not drawn. Rows that repeat an id are drawn together. An empty table gives an empty result."""
    own = documents.withColumns({"_tokens": tokens_of(F.col(text)), "_topic": topic_of(F.col(text))})
    axes = {"source": F.col("source"), "lang": F.col("lang"), "topic": F.col("_topic")}
    fitted = rake(cells_of(own, F.col("_tokens"), axes), shares or TEMPERATURE)
    whole = fitted.agg(F.sum("n").alias("all"), F.max(F.col("w") / F.col("n")).alias("top"), F.max("off").alias("off")).first()
    weight = fitted.select(*[F.col(a).alias(f"_{a}") for a in ("source", "lang")], F.col("topic").alias("_of"), (F.col("w") / F.col("n") * F.lit(whole["all"])).alias("_weight"), (rate * F.col("w") / F.col("n") / F.lit(whole["top"])).alias("_probability"))
    on = (F.coalesce(F.col("source").cast("string"), F.lit(NONE)) == F.col("_source")) & (F.coalesce(F.col("lang").cast("string"), F.lit(NONE)) == F.col("_lang")) & (F.col("_topic") == F.col("_of")) & (F.col("_tokens") > 0)
    joined = own.join(weight, on, "left").drop("_source", "_lang", "_of").withColumns({"_off": F.lit(whole["off"] or 0.0), "_weight": F.coalesce("_weight", F.lit(0.0)), "_probability": F.coalesce("_probability", F.lit(0.0))})
    draw, times = uniform(seed, F.coalesce(F.col(key).cast("string"), F.lit("null"))), F.lit(rate) * F.col("_weight")
    copies = F.floor(times) + (draw < times - F.floor(times)).cast("long")
    return joined.withColumns({"_copies": copies, "_kept": draw < F.col("_probability")})


def repeated(weighted: DataFrame) -> DataFrame:
    """The rows of ``mixed``, each as often as its _copies say."""
    return weighted.filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).drop("_copy")


def query(spark, sf_dir):
    got = mixed(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "source", "lang", *[F.col(f"_{c}").alias(c) for c in ("topic", "tokens", "weight", "off", "copies", "probability", "kept")])
