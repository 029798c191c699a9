"""Many decision layers at once: all folds and candidates take their steps from the same passes over the table.

Cross-validation asks for dozens of small fits of one table. Fitted one after another each needs its own hundred passes;
here one pass accumulates, per task, the loss and gradient of every open fit, and the sums decide all next steps. The curvature of a bounded
sample scales the steps and what the gradients tell corrects it; only a fit that does not settle so asks for the curvature of all rows."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteval.constants import COST
from siteval.operators.decision import Layer

_DIRECT_PARTITIONS = 16
_SALTS = 8
#: fold of a row that is not in a subset
OUTSIDE = -2


@dataclass
class Fit:
    """What to fit: inverse penalty, the fold left out (None: none), row weights, class balancing, base layer to recalibrate, and which
    of several fold columns counts. Rows whose fold is OUTSIDE take no part."""

    C: float
    fold: int | None = None
    source_w: float = 0.0
    real_w: float = 1.0
    balanced: bool = False
    base: object | None = None
    subset: int = 0

    def leaving_out(self, fold: int | None) -> "Fit":
        return replace(self, fold=fold)


def _inputs(X: np.ndarray, base) -> np.ndarray:
    if base is None:
        return X
    u = (X - np.asarray(base.mean)) / np.asarray(base.scale) @ np.asarray(base.coef).T + np.asarray(base.intercept)
    return u - u.mean(1, keepdims=True)


def _columns(batch: pa.RecordBatch, n: int):
    """(x, y, folds, src); folds has a column per subset."""
    X = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
    fold = batch.column("fold")
    fold = fold.flatten() if pa.types.is_list(fold.type) else fold
    return X, batch.column("y").to_numpy(zero_copy_only=False), fold.to_numpy(zero_copy_only=False).reshape(len(X), -1), batch.column("src").to_numpy(zero_copy_only=False).astype(bool)


def _weights(fit: Fit, fold: np.ndarray, src: np.ndarray) -> np.ndarray:
    own = fold[:, fit.subset]
    w = np.where(src, fit.source_w, np.where(own == OUTSIDE, 0.0, fit.real_w))
    return w if fit.fold is None else np.where((own == fit.fold) & ~src, 0.0, w)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _sums(df: DataFrame, n: int, per_batch, partitions: int) -> dict[int, np.ndarray]:
    """Sum per-job vectors over the table; a few small rows per job reach the driver. ``per_batch(X, y, fold, src)`` yields (job, vector)."""
    def run(batches):
        acc: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                for j, v in per_batch(*_columns(b, n)):
                    acc[j] = acc[j] + v if j in acc else v
        if acc:
            keys = list(acc)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([acc[j] for j in keys], pa.list_(pa.float64()))], ["job", "v"])

    data = df.select("x", F.col("y").cast("int").alias("y"), "fold", "src")
    out = data.mapInArrow(run, "job long, v array<double>")
    if partitions > _DIRECT_PARTITIONS:
        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"job": pdf["job"].iloc[:1], "v": [np.sum(np.vstack(pdf["v"].to_list()), axis=0)]})
        salted = out.withColumn("s", F.spark_partition_id() % (_SALTS * max(1, math.isqrt(partitions) // _SALTS)))
        out = salted.groupBy("job", "s").applyInPandas(add, "job long, v array<double>")
    total: dict[int, np.ndarray] = {}
    for b in out.toArrow().to_batches():
        values, offsets = b.column("v").values.to_numpy(zero_copy_only=False), b.column("v").offsets.to_numpy()
        for i, j in enumerate(b.column("job").to_pylist()):
            v = values[offsets[i]:offsets[i + 1]]
            total[j] = total[j] + v if j in total else v.copy()
    return total


#: rows of the sample on which every fit starts, about; it shapes the way to the optimum and not the optimum
_START_ROWS = 8192
#: rows of the sample whose curvature scales the steps over all rows, about
_SHAPE_ROWS = 1 << 17
#: numbers that a task holds at once per row block
_BLOCK = 1 << 20
#: rows that a task takes in one pass, at least about
_TASK_ROWS = 50_000
#: sums that a task makes in one pass
_SUMS = 1 << 18
#: passes with a corrected curvature after which a fit takes that of all rows, and after which a fit that only starts others ends
_CORRECTED, _LEADING = 25, 8
#: a fit has ended when its predicted step is at most this, and must have a mean gradient of at most GRADIENT
STEP, GRADIENT = 1e-5, 1e-6
_MAX_PASSES = 400
#: predicted step at which a fit is good enough to start others
_ROUGH = 0.05


def _shared_moments(df: DataFrame, n: int, k: int, partitions: int):
    """Mean and deviation of all rows, then (rows by class, sums and squares around that mean) by (subset, fold), source rows as (-1, -1): fits differ
    only in which of those they use. Labels that are NULL or outside 0..k-1 are refused, not dropped."""
    def first(X, y, fold, src):
        yield 0, np.concatenate([[len(X), (~((y >= 0) & (y < k))).sum()], X.sum(0)])

    s = _sums(df, n, first, partitions)[0]
    if s[1]:
        raise ValueError(f"{int(s[1])} labels are missing or outside 0..{k - 1}")
    mean = s[2:] / s[0]

    def second(X, y, fold, src):
        Z = X - mean
        for c in range(-1, fold.shape[1]):
            own = np.where(src, -1 if c < 0 else OUTSIDE, OUTSIDE if c < 0 else fold[:, c])
            for f in np.unique(own[own != OUTSIDE]):
                z = Z[own == f]
                yield (c + 1 << 32) + int(f) + 1, np.concatenate([np.bincount(y[own == f], minlength=k), z.sum(0), (z * z).sum(0)])

    parts = {((job >> 32) - 1, (job & (1 << 32) - 1) - 1): v for job, v in _sums(df, n, second, partitions).items()}
    whole = [v for (c, _), v in parts.items() if c <= 0]
    total = sum(whole) if whole else np.zeros(k + 2 * n)
    rows = max(total[:k].sum(), 1)
    sd = np.sqrt(np.maximum(total[k + n:] / rows - (total[k:k + n] / rows) ** 2, 0))
    return int(s[0]), mean, np.where(sd > 1e-12 * np.maximum(1.0, np.abs(mean)), sd, 1.0), parts


class _Problem:
    """One fit: its own standardisation (rows used by it), penalty and class weights, in coordinates of its own."""

    def __init__(self, fit: Fit, mean, scale, parts, n: int, k: int):
        self.fit, self.k = fit, k
        used = []
        for (subset, fold), v in parts.items():
            w = fit.source_w if subset < 0 else fit.real_w if subset == fit.subset and fold != fit.fold else 0.0
            if w > 0:
                used.append((w, v))
        count, weight = sum((v[:k] for _, v in used), np.zeros(k)), sum((w * v[:k] for w, v in used), np.zeros(k))
        self.present = count > 0
        if self.present.sum() < 2:
            raise ValueError("a layer needs at least two classes")
        m = count.sum()
        self.cw = np.where(self.present, m / (self.present.sum() * np.maximum(count, 1)), 0.0) if fit.balanced else np.ones(k)
        self.weight = float((weight * self.cw).sum())
        self.C = fit.C / 2 if k == 2 else fit.C          # two softmax rows carry half the penalty of one binary row
        if fit.base is not None:
            self.mean, self.scale = np.zeros(k), np.ones(k)
            self.a, self.c = np.ones(k), np.zeros(k)
        else:
            s = sum(v for _, v in used)
            shift = s[k:k + n] / m
            sd = np.sqrt(np.maximum(s[k + n:] / m - shift ** 2, 0))
            self.mean = mean + shift
            self.scale = np.where(sd > 1e-7 * np.maximum(1e-5, scale), sd, 1.0)
            self.a, self.c = scale / self.scale, -shift / self.scale
        self.d = len(self.mean) + 1
        self.reg = np.ones((k, self.d))
        self.reg[:, -1] = 0.0

    def numbers(self, curved: bool) -> int:
        """How many sums one pass makes for this fit."""
        return 1 + self.k * self.d + (self.k * (self.k + 1) // 2 * self.d * (self.d + 1) // 2 if curved else 0)

    def to_shared(self, theta: np.ndarray) -> np.ndarray:
        return np.column_stack([theta[:, :-1] * self.a, theta[:, -1] + theta[:, :-1] @ self.c])

    def from_shared(self, g: np.ndarray) -> np.ndarray:
        return np.column_stack([g[:, :-1] * self.a + g[:, -1:] * self.c, g[:, -1]])

    def start(self, U1, y, fold, src, theta):
        """A point near the optimum of the sample."""
        w = _weights(self.fit, fold, src) * self.cw[y]
        used = w > 0
        k, d = self.k, self.d
        if not used.any():
            return theta
        Z, w, y = U1[used], w[used], y[used]
        Z = np.column_stack([Z[:, :-1] * self.a + self.c, Z[:, -1]])
        w = w * (self.weight / w.sum())
        hot, H = np.eye(k)[y], np.zeros((k * d, k * d))
        for _ in range(15):
            logits = Z @ theta.T
            logits[:, ~self.present] = -1e30
            p = _softmax(logits)
            g = self.C * ((p - hot) * w[:, None]).T @ Z + self.reg * theta
            for a in range(k):
                for b in range(a, k):
                    h = self.C * (Z * (w * p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ Z
                    H[a * d:(a + 1) * d, b * d:(b + 1) * d] = h
                    H[b * d:(b + 1) * d, a * d:(a + 1) * d] = h
            step = np.linalg.solve(H + self._ridge(), g.ravel()).reshape(k, d)
            theta = theta - step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
            if np.abs(step).max() < 1e-2:
                break
        return theta

    def placed(self, other: "_Problem", theta: np.ndarray) -> np.ndarray:
        """The coefficients of another fit in the coordinates of this one."""
        raw = theta[:, :-1] / other.scale
        return np.column_stack([raw * self.scale, theta[:, -1] + raw @ (self.mean - other.mean)])

    def _ridge(self):
        return np.diag(np.where(self.reg > 0, 1.0, 1e-6 * self.C * self.weight / self.k).ravel())

    def _own(self, loss, g, blocks, theta, share):
        """Loss, gradient and curvature (None where it was not asked for) of the penalised loss in the fit's own coordinates, from a share of its rows."""
        k, d, at, H, C = self.k, self.d, 0, None, self.C / share
        if blocks is not None:
            turn = np.diag(np.append(self.a, 1.0))
            turn[-1, :-1] = self.c
            iu, H = np.triu_indices(d), np.zeros((k * d, k * d))
            for a in range(k):
                for b in range(a, k):
                    h = np.zeros((d, d))
                    h[iu] = blocks[at]
                    h = turn.T @ (h + np.triu(h, 1).T) @ turn * C
                    H[a * d:(a + 1) * d, b * d:(b + 1) * d] = h
                    H[b * d:(b + 1) * d, a * d:(a + 1) * d] = h
                    at += 1
        return C * loss + 0.5 * (self.reg * theta * theta).sum(), C * self.from_shared(g) + self.reg * theta, H

    def descend(self, theta: np.ndarray, step_tol: float, curvature: np.ndarray | None = None, share: float = 1.0):
        """Newton's method as a generator: it asks for the sums at a point, with or without their curvature, and is sent those of one pass over
        ``share`` of the rows. Without a mean curvature to go by it takes that of the rows, and steps are halved while the loss rises. Else every pass
        corrects the curvature given (BFGS), also one that leads to no lower loss; a fit that has not ended so after a number of passes takes the
        curvature of the rows after all, and one that only starts others ends. Returns (theta, largest mean gradient, mean curvature)."""
        whole, curved, passes, t = self.C * self.weight, curvature is None, 1, 1.0
        inverse = None if curved else np.linalg.inv(curvature * whole + self._ridge())
        loss, g, H = self._own(*(yield self.to_shared(theta), curved), theta, share)
        while True:
            size = np.abs(g).max() / whole
            step = -(np.linalg.solve(H + self._ridge(), g.ravel()) if curved else inverse @ g.ravel()).reshape(g.shape)
            if np.abs(step).max() <= step_tol and (size <= GRADIENT or step_tol > STEP) or size < 1e-13 or t < 1e-4:
                return theta, size, (H if curved else np.linalg.inv(inverse) - self._ridge()) / whole
            if not curved and step_tol > STEP and passes >= _LEADING:
                return theta, size, (np.linalg.inv(inverse) - self._ridge()) / whole
            if not curved and passes >= _CORRECTED:
                curved = True
                loss, g, H = self._own(*(yield self.to_shared(theta), curved), theta, share)
                continue
            at, slope = theta + t * step, (g * step).sum()
            passes += 1
            l2, g2, H2 = self._own(*(yield self.to_shared(at), curved), at, share)
            if not curved:
                inverse = _corrected(inverse, (at - theta).ravel(), (g2 - g).ravel())
            if l2 <= loss + 1e-4 * t * slope + 1e-11 * abs(loss):
                theta, loss, g, H, t = at, l2, g2, H2, 1.0
            elif curved:
                t /= 2


def _corrected(inverse: np.ndarray, s: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The inverse curvature that agrees with a step and the change of the gradient along it."""
    sy = s @ y
    if sy <= 1e-12 * np.sqrt((s @ s) * (y @ y)):
        return inverse
    b = inverse @ y
    return inverse + np.outer(s, s) * (1 + y @ b / sy) / sy - (np.outer(b, s) + np.outer(s, b)) / sy


def _pass(df: DataFrame, n: int, partitions: int, problems, asked: dict, mean, scale) -> dict:
    """(loss, gradient, curvature blocks or None) at the points asked for, from one pass. Coefficients are stacked and products of inputs are shared, so
    a block of rows takes a few matrix products for all fits."""
    groups: dict[tuple, list] = {}
    for j, (_, curved) in asked.items():
        groups.setdefault((id(problems[j].fit.base), problems[j].fit.subset, curved), []).append(j)
    sent = []
    for (_, _, curved), jobs in groups.items():
        ps = [problems[j] for j in jobs]
        sent.append({"jobs": jobs, "fits": [p.fit for p in ps], "cw": np.array([p.cw for p in ps]), "absent": np.array([np.where(p.present, 0.0, -1e30) for p in ps]),
                     "theta": np.concatenate([asked[j][0] for j in jobs]), "k": ps[0].k, "curved": curved})

    def accumulate(X, y, fold, src, sent=sent):
        for i, s in enumerate(sent):
            base, k, J = s["fits"][0].base, s["k"], len(s["jobs"])
            inside = np.flatnonzero((fold[:, s["fits"][0].subset] != OUTSIDE) & ~src | (src & any(f.source_w > 0 for f in s["fits"])))
            pairs = [(a, b) for a in range(k) for b in range(a, k)]
            rows = max(1, _BLOCK // (J * len(pairs))) if s["curved"] else max(256, _BLOCK // 8 // (J * k))
            for lo in range(0, len(inside), rows):
                part = inside[lo:lo + rows]
                U = (X[part] - mean) / scale if base is None else _inputs(X[part], base)
                U1 = np.column_stack([U, np.ones(len(U))])
                yy = y[part]
                w = np.stack([_weights(f, fold[part], src[part]) for f in s["fits"]], axis=1) * s["cw"][:, yy].T
                L = (U1 @ s["theta"].T).reshape(len(U), J, k) + s["absent"]
                L -= L.max(2, keepdims=True)
                p = np.exp(L)
                p /= p.sum(2, keepdims=True)
                at = np.arange(len(U))
                loss = -(w * np.log(np.maximum(p[at, :, yy], 1e-300))).sum(0)
                curve = np.zeros(0)
                if s["curved"]:
                    left, right = np.triu_indices(U1.shape[1])
                    curve = np.stack([w * p[:, :, a] * ((a == b) - p[:, :, b]) for a, b in pairs], axis=2).reshape(len(U), -1).T @ (U1[:, left] * U1[:, right])
                p[at, :, yy] -= 1
                p *= w[:, :, None]
                yield i, np.concatenate([loss, (p.reshape(len(U), -1).T @ U1).ravel(), curve.ravel()])

    sums = _sums(df.coalesce(partitions), n, accumulate, partitions)
    answers = {}
    for i, s in enumerate(sent):
        J, k = len(s["jobs"]), s["k"]
        d = s["theta"].shape[1]
        v = sums[i]
        g, h = v[J:J + J * k * d].reshape(J, k, d), v[J + J * k * d:].reshape(J, k * (k + 1) // 2, -1) if s["curved"] else [None] * J
        answers.update({j: (v[q], g[q], h[q]) for q, j in enumerate(s["jobs"])})
    return answers


def fit_many(df: DataFrame, fits: dict, n: int, k: int = 4, step_tol: float = STEP, log: list | None = None) -> dict:
    """Layers of many fits: key -> Layer, each with its largest mean gradient. df: x (array of n), y, fold, src (source rows); persist it first.
    ``fold`` may be an array with one fold per subset.

    Every fit minimises C * sum(w * loss) + |W|^2 / 2 on inputs standardised over its own training rows (recalibrations use
    the base layer's centred logits as they are). A bounded sample gives starts along the path of penalties, fits of all rows those of the folds; all open fits take their steps from
    the same passes, at most as many fits a pass as the tasks can hold sums for, until every step is below ``step_tol``. The sample's curvature scales the steps. A fit whose
    gradient does not vanish is an error. ``log`` takes the number of open fits of every pass."""
    partitions = df.rdd.getNumPartitions()
    keys = list(fits)
    rows, mean, scale, parts = _shared_moments(df, n, k, partitions)
    # A pass over few rows in many tasks is mostly the start of tasks, and a kept table may have more parts than its plan says.
    partitions = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // _TASK_ROWS))
    problems = [_Problem(fits[key], mean, scale, parts, n, k) for key in keys]
    some = df.sample(min(1.0, _START_ROWS / rows), seed=0) if rows > _START_ROWS else df
    got = some.select("x", F.col("y").cast("int").alias("y"), "fold", "src").toArrow()
    X, y, fold, src = _columns(got.combine_chunks().to_batches()[0], n) if got.num_rows else (np.zeros((0, n)), np.zeros(0, int), np.zeros((0, 1 + max(f.subset for f in fits.values())), int), np.zeros(0, bool))
    inputs: dict[int, np.ndarray] = {}

    def solve(table: DataFrame, todo: dict[int, tuple], among, tol: float, share: float = 1.0) -> dict:
        """Place -> (coefficients, mean gradient, mean curvature) of the problems ``among`` from the given starts (coefficients, curvature or None)."""
        generators = {j: among[j].descend(theta, tol, shape, share) for j, (theta, shape) in todo.items()}
        asked, done = {j: next(g) for j, g in generators.items()}, {}
        for _ in range(_MAX_PASSES):
            if not asked:
                break
            if log is not None:
                log.append(len(asked))
            room, now = _SUMS, {}
            for j, at in asked.items():
                room -= among[j].numbers(at[1])
                if now and room < 0:
                    break
                now[j] = at
            for j, answer in _pass(table, n, partitions, among, now, mean, scale).items():
                del asked[j]
                try:
                    asked[j] = generators[j].send(answer)
                except StopIteration as end:
                    done[j] = end.value
        return done

    # Fits that differ in their fold only are near each other: what all of their rows give, roughly, is where they start.
    leaders: dict[tuple, _Problem] = {}
    kin = [(id(p.fit.base), p.fit.subset, p.fit.balanced, p.fit.source_w, p.fit.real_w, p.fit.C) for p in problems]
    last: dict[tuple, np.ndarray] = {}
    starts = {}
    for key, p in sorted(dict(zip(kin, problems)).items(), key=lambda item: item[0][-1]):
        base = p.fit.base
        leaders[key] = lead = _Problem(p.fit.leaving_out(None), mean, scale, parts, n, k)
        if id(base) not in inputs:
            U = (X - mean) / scale if base is None else _inputs(X, base)
            inputs[id(base)] = np.column_stack([U, np.ones(len(U))])
        starts[key] = last[key[:-1]] = lead.start(inputs[id(base)], y, fold, src, last.get(key[:-1], np.zeros((k, lead.d))))
    names = list(leaders)
    share = min(1.0, _SHAPE_ROWS / max(rows, 1))
    part = df.sample(share, seed=1).persist() if share < 1 else df
    rough = solve(part, {i: (starts[key], None) for i, key in enumerate(names)}, [leaders[key] for key in names], _ROUGH, share)
    if share < 1:
        part.unpersist()
        rough = solve(df, {i: (theta, shape) for i, (theta, _, shape) in rough.items()}, [leaders[key] for key in names], _ROUGH)
    lead = [names.index(key) for key in kin]
    found = solve(df, {j: (p.placed(leaders[kin[j]], rough[lead[j]][0]), rough[lead[j]][2]) for j, p in enumerate(problems) if lead[j] in rough}, problems, step_tol)
    if len(found) < len(keys) or any(size > GRADIENT for _, size, _ in found.values()):
        raise RuntimeError("a fit has not reached its optimum")
    out = {}
    for j, key in enumerate(keys):
        p, (th, size, _) = problems[j], found[j]
        b = th[:, -1] - th[p.present, -1].mean()
        coef = np.where(p.present[:, None], th[:, :-1], 0.0)
        out[key] = Layer(p.mean.tolist(), p.scale.tolist(), coef.tolist(), np.where(p.present, b, -np.inf).tolist(), p.fit.C, p.fit.base, float(size))
    return out


def probabilities(X: np.ndarray, m) -> np.ndarray:
    Z = (_inputs(X, m.base) - np.asarray(m.mean)) / np.asarray(m.scale)
    b = np.asarray(m.intercept, float)
    return _softmax(Z @ np.asarray(m.coef).T + np.where(np.isinf(b), -1e30, b))


def classes_of(df: DataFrame, layers: dict[str, Layer], keep, n: int, x: str = "x") -> DataFrame:
    """Most probable class of every row under each of a few layers: the kept columns, layer, pred. One pass over Arrow batches, so the plan does not grow
    with the layers' coefficients."""
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes) + ", layer string, pred int"

    def run(batches):
        for b in batches:
            X = b.column(x).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            for name, m in layers.items():
                pred = probabilities(X, m).argmax(1) if len(X) else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([name] * len(X), pa.string()), pa.array(pred, pa.int32())], [*keep, "layer", "pred"])

    return df.select(*keep, x).mapInArrow(run, schema)


def holdout(df: DataFrame, layers: dict, n: int, k: int = 4, flip: str | None = None) -> dict:
    """key -> (rows, hits, cost) of every (fold, layer) or (fold, layer, subset) on its own fold's real rows, in one pass.

    With ``flip`` (a column of mirrored features) probabilities are averaged over both feature sets."""
    keys = list(layers)
    cost = np.asarray(COST, float) if k == len(COST) else np.zeros((k, k))

    def score(X, y, fold, src):
        both = X.shape[1] == 2 * n
        for j, key in enumerate(keys):
            f, m, *subset = layers[key]
            rows = (fold[:, subset[0] if subset else 0] == f) & ~src
            if rows.any():
                p = probabilities(X[rows, :n], m)
                if both:
                    p = (p + probabilities(X[rows, n:], m)) / 2
                c = p.argmax(1)
                yield j, np.array([rows.sum(), (c == y[rows]).sum(), cost[y[rows], c].sum()], float)

    data = df if flip is None else df.withColumn("x", F.concat("x", flip))
    got = _sums(data, n if flip is None else 2 * n, score, df.rdd.getNumPartitions())
    return {key: tuple(got.get(j, np.zeros(3))) for j, key in enumerate(keys)}
