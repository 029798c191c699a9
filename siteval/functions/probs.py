"""Functions of one class-probability vector. Unrolled over the classes so that they compile with the stage."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteval.runtime import case, total


def items(p: Column, k: int = 4) -> list[Column]:
    return [p[i] for i in range(k)]


def _first_max(values: list[Column]) -> Column:
    """Index of the first maximum of a list of columns."""
    last = len(values) - 1
    arms = []
    for i, v in enumerate(values[:-1]):
        rest = values[i + 1:]
        arms.append((v >= (F.greatest(*rest) if len(rest) > 1 else rest[0]), i))
    return case(arms, F.lit(last))


def argmax(p: Column, k: int = 4) -> Column:
    """Class index of the first maximum; NULL when the vector is NULL."""
    return F.when(p.isNotNull(), _first_max(items(p, k))).cast("int")


def confidence(p: Column, k: int = 4) -> Column:
    return F.greatest(*items(p, k))


def decide(p: Column, bias=None, k: int = 4) -> Column:
    """argmax(log(clip(p, 1e-9, 1)) + bias), first maximum wins."""
    bias = [0.0] * k if bias is None else list(bias)
    scores = [F.log(F.least(F.greatest(v, F.lit(1e-9)), F.lit(1.0))) + F.lit(float(b)) for v, b in zip(items(p, k), bias)]
    return F.when(p.isNotNull(), _first_max(scores)).cast("int")


def _ordered(p: Column, k: int) -> Column:
    """Entries as (-p, class) structs in ascending order: largest probability first, lower class first on ties."""
    return F.array_sort(F.array(*[F.struct((-v).alias("neg"), F.lit(i).alias("cls")) for i, v in enumerate(items(p, k))]))


def margin(p: Column, k: int = 4) -> Column:
    """Largest minus second largest probability."""
    o = _ordered(p, k)
    return o[1]["neg"] - o[0]["neg"]


def runner_up(p: Column, k: int = 4) -> Column:
    """Class with the second largest probability."""
    return _ordered(p, k)[1]["cls"]


def entropy(p: Column, k: int = 4) -> Column:
    return -total([v * F.log(v + F.lit(1e-9)) for v in items(p, k)])


def check_probs(p: Column, k: int = 4, tol: float = 1e-3) -> Column:
    """True for a finite, non-negative k-vector that sums to 1 within ``tol``; NULL counts as invalid."""
    ok = (F.size(p) == k) & (F.abs(total(items(p, k)) - 1) <= tol)
    for v in items(p, k):
        ok = ok & v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf"))
    return F.coalesce(p.isNotNull() & ok, F.lit(False))


def mean_probs(p: Column, q: Column, k: int = 4) -> Column:
    """Element-wise mean of two vectors."""
    return F.array(*[(a + b) * 0.5 for a, b in zip(items(p, k), items(q, k))])


def scale_probs(p: Column, factors, k: int = 4) -> Column:
    """p * factors, renormalised."""
    scaled = [v * f for v, f in zip(items(p, k), factors)]
    s = total(scaled)
    return F.array(*[v / s for v in scaled])


def softmax(logits: list[Column]) -> Column:
    top = F.greatest(*logits)
    e = [F.exp(z - top) for z in logits]
    s = total(e)
    return F.array(*[v / s for v in e])


def softmax_linear(x: Column, layer) -> Column:
    """Class probabilities of a fitted layer: standardise, multiply, stable softmax. Constants are literals."""
    n = len(layer.mean)
    z = [(x[i] - F.lit(float(layer.mean[i]))) / F.lit(float(layer.scale[i])) for i in range(n)]
    logits = [total([z[i] * F.lit(float(layer.coef[k][i])) for i in range(n)]) + F.lit(float(layer.intercept[k]))
              if not math.isinf(layer.intercept[k]) else F.lit(-1e300) for k in range(len(layer.intercept))]
    return softmax(logits)


def centred_logits(x: Column, layer) -> Column:
    """Logits of a layer minus their mean."""
    n = len(layer.mean)
    z = [(x[i] - F.lit(float(layer.mean[i]))) / F.lit(float(layer.scale[i])) for i in range(n)]
    logits = [total([z[i] * F.lit(float(layer.coef[k][i])) for i in range(n)]) + F.lit(float(layer.intercept[k]))
              for k in range(len(layer.intercept))]
    m = total(logits) / len(logits)
    return F.array(*[v - m for v in logits])
