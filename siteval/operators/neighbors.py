"""Exact nearest neighbours by cosine over two vector tables, with pivot pruning and bounded tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteval.functions.hashing import hash52
from siteval.operators.quantiles import exact_median

_CELL = 4096
_PIVOTS = 64
_SLACK = 1e-6


def _unit(vectors) -> np.ndarray:
    m = np.asarray(vectors.tolist(), dtype=np.float64)
    m = np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])  # an exact scaling, so that no square leaves the range of doubles
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _pivot_matrix(target: DataFrame, vec: str, pivots: int) -> np.ndarray:
    """A few target vectors (a bounded sample; it steers the search only) as unit rows."""
    rows = target.select(F.col(vec).cast("array<double>").alias("v")).limit(pivots).collect()
    return _unit(pd.Series([r.v for r in rows]))


def _to_pivots(df: DataFrame, key: str, vec: str, pivots: np.ndarray, every: bool) -> DataFrame:
    """(id, v, cell, angle) for the nearest pivot, or for every pivot when ``every``."""
    def angles(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            a = np.arccos(np.clip(_unit(pdf["v"]) @ pivots.T, -1, 1))
            if every:
                yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "angles": list(a)})
            else:
                c = a.argmin(1)
                yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "cell": c.astype(np.int32), "angle": a[np.arange(len(c)), c]})

    cols = df.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    tail = "angles array<double>" if every else "cell int, angle double"
    return cols.mapInPandas(angles, f"id long, v array<double>, {tail}")


def _best_in_groups(queries: DataFrame, cells: DataFrame, exclude_self: bool) -> DataFrame:
    """(id, best): largest cosine of each query within the (cell, block) groups it was sent to."""
    def best(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(t):
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "best": pd.Series(dtype="float64")})
        s = _unit(q["v"]) @ _unit(t["v"]).T
        if exclude_self:
            s[q["id"].to_numpy()[:, None] == t["id"].to_numpy()[None, :]] = -np.inf
        m = s.max(1)
        keep = np.isfinite(m)
        return pd.DataFrame({"id": q["id"][keep], "best": m[keep]})

    keys = ["cell", "block", "part"]
    out = queries.groupBy(*keys).cogroup(cells.groupBy(*keys)).applyInPandas(best, "id long, best double")
    return out.groupBy("id").agg(F.max("best").alias("best"))


def nearest_neighbor(source: DataFrame, target: DataFrame, key: str, vec: str, exclude_self: bool = False, pivots: int = _PIVOTS) -> DataFrame:
    """(key, best): largest cosine of every source vector to any target vector.

    Targets sit in cells around pivots, cells are cut into blocks, and the source rows sent to a cell are cut into parts, so
    a group never exceeds two blocks. A first pass searches each source's own cell; a second visits only the cells that the
    angle bounds leave open. Nothing but one value per row leaves a group."""
    p = _pivot_matrix(target, vec, pivots)
    cells = _to_pivots(target, key, vec, p, every=False)
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi"))
    sizes = F.broadcast(sizes.select("cell", F.ceil(F.col("n") / _CELL).alias("blocks"), "lo", "hi"))
    placed = cells.join(sizes, "cell").select("id", "v", "cell", F.pmod(hash52(F.col("id")), F.col("blocks")).alias("block"))

    def visit(q: DataFrame) -> DataFrame:
        sent = q.join(sizes.select("cell", "blocks"), "cell").select("id", "v", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        parts = sent.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / _CELL).alias("parts"))
        sent = sent.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(hash52("p", F.col("id")), F.col("parts"))).drop("parts")
        spread = placed.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        return _best_in_groups(sent, spread, exclude_self)

    src = _to_pivots(source, key, vec, p, every=True)
    own = src.select("id", "v", (F.array_position("angles", F.array_min("angles")) - 1).cast("int").alias("cell"))
    first = visit(own)
    spans = sizes.agg(F.map_from_entries(F.collect_list(F.struct("cell", F.struct("lo", "hi"))))).scalar()
    opened = (src.join(first, "id", "left").withColumn("_m", spans)
              .select("id", "v", "best", F.array_position("angles", F.array_min("angles")).alias("_own"), "_m", F.posexplode("angles").alias("cell", "angle"))
              .withColumn("_s", F.col("_m")[F.col("cell")]).filter("_s IS NOT NULL AND cell <> _own - 1"))
    reach = F.acos(F.least(F.greatest(F.coalesce("best", F.lit(-1.0)), F.lit(-1.0)), F.lit(1.0))) + _SLACK
    opened = opened.filter((F.col("angle") - F.col("_s.hi") <= reach) & (F.col("_s.lo") - F.col("angle") <= reach)).select("id", "v", "cell")
    both = first.unionByName(visit(opened))
    return both.groupBy("id").agg(F.max("best").alias("best")).withColumnRenamed("id", key)


def neighbor_medians(source: DataFrame, target: DataFrame, key: str, vec: str) -> DataFrame:
    """Median best cosine from source to target, and within target leaving each row itself out."""
    cross = exact_median(nearest_neighbor(source, target, key, vec), F.col("best")).select(F.lit("source_to_target").alias("pair"), "n", "median")
    inner = exact_median(nearest_neighbor(target, target, key, vec, exclude_self=True), F.col("best")).select(F.lit("target_to_target").alias("pair"), "n", "median")
    return cross.unionByName(inner)
