"""Approximate nearest neighbours by cross-polytope hashing.

Three rounds of random signs and a fast Hadamard transform turn unit vectors at random; the nearest signed axis is the cell.
Every table holds all vectors by cell, a query looks into the cells of its largest coordinates. Cells are scanned in blocks,
each giving the query's nearest by exact distance, so what leaves a block does not grow with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteval.llm.common import settled, table
from siteval.llm.lattice import usable

TABLES, PROBES = 8, 10
#: vectors of a cell in one block
BLOCK = 4096


def turned(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows of ``x`` (padded with zeros to a power of two) after one sign flip and Hadamard transform per row of ``signs``."""
    n, d = len(x), signs.shape[1]
    y = np.zeros((n, d))
    y[:, : x.shape[1]] = x
    for s in signs:
        y *= s
        h = 1
        while h < d:
            z = y.reshape(n, d // (2 * h), 2, h)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(n, d)
            h *= 2
        y /= np.sqrt(d)
    return y


def _hash(seed: int, tables: int, probes: int):
    """(t, dim, cell) of each vector and, of a query, its ``probes`` cells in each table."""
    def run(batches):
        for b in batches:
            ids, dims, ask = b.column(0).to_numpy(), b.column(2).to_numpy(), np.asarray(b.column(3))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                raw = b.column(1).take(pa.array(at))
                x = np.asarray(raw.values).reshape(len(at), dim)
                rng = np.random.default_rng([seed, int(dim)])
                wide = 1 << max(0, int(dim) - 1).bit_length()
                for t in range(tables):
                    y = turned(x, rng.choice([-1.0, 1.0], (3, wide)))
                    both = np.concatenate([y, -y], axis=1)
                    cell = both.argmax(axis=1)
                    asking = np.flatnonzero(ask[at])
                    near = np.argsort(-both[asking], axis=1, kind="stable")[:, :probes]
                    k = near.shape[1]
                    take = np.concatenate([np.arange(len(at)), np.repeat(asking, k)])
                    n = len(take)
                    yield pa.record_batch([pa.array(np.full(n, t, np.int32)), pa.array(np.full(n, dim, np.int32)), pa.array(np.concatenate([cell, near.ravel()]).astype(np.int32)),
                                           pa.array(np.arange(n) >= len(at)), pa.array(ids[at][take]), raw.take(pa.array(take))], names=["t", "dim", "cell", "probe", "id", "v"])
    return run


def _scan(k: int):
    """The nearest ``k`` vectors of a block to each query that looks into it."""
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        probe, ids = np.asarray(t["probe"]), np.asarray(t["id"])
        v = t["v"].combine_chunks() if isinstance(t["v"], pa.ChunkedArray) else t["v"]
        x = np.asarray(v.values).reshape(len(ids), -1)
        base, ask = np.flatnonzero(~probe), np.flatnonzero(probe)
        out: list[list] = [[], [], []]
        if len(base):
            b, norm = x[base], (x[base] ** 2).sum(axis=1)
            for q in ask:
                near = norm - 2 * (b @ x[q])  # shortlist; the distances returned are summed from differences
                near[ids[base] == ids[q]] = np.inf
                m = min(k, len(base))
                edge = np.partition(near, m - 1)[m - 1]
                short = np.flatnonzero((near <= edge + 1e-9 * (1 + abs(edge) + norm.max())) & np.isfinite(near))
                d = np.sqrt(((b[short] - x[q]) ** 2).sum(axis=1))
                best = np.lexsort((ids[base][short], d))[:k]
                out[0] += [ids[q]] * len(best)
                out[1] += d[best].tolist()
                out[2] += ids[base][short[best]].tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "score": pa.array(out[1], pa.float64()), "vec_id": pa.array(out[2], pa.int64())})
    return run


def _searched(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, best): the k nearest of what the blocks give. ``rows``: t, dim, cell, probe, id, v."""
    sizes = rows.filter("not probe").groupBy("t", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    at = F.when(F.col("probe"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    blocks = rows.join(sizes, ["t", "dim", "cell"]).withColumn("block", F.explode(at))
    found = blocks.groupBy("t", "dim", "cell", "block").applyInArrow(_scan(k), "query_id long, score double, vec_id long")
    return found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set(F.struct("score", "vec_id"))), 1, k).alias("best"))


def nearest(embeddings: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, tables: int = TABLES, probes: int = PROBES, seed: int = 0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest rows found by Euclidean distance in double precision, ties to the smaller id.

    ``is_query`` is a condition on the column ``id``. A query's own row is no candidate. A query for which the cells hold fewer
    than k candidates is compared with all vectors, so it gets all there are if they are fewer than k. Vectors that are
    null, empty, zero or not finite take no part, neither do null ids; vectors of different lengths are not compared; of rows
    that repeat an id the smallest vector counts. An empty table gives an empty result; further columns are not read."""
    spark = embeddings.sparkSession
    rows = usable(embeddings.select(key, vector), key, vector).filter("v is not null").groupBy("id").agg(F.min("v").alias("v"))
    rows = settled(rows.withColumn("dim", F.size("v")).withColumn("ask", is_query), "vectors")
    spread = rows.select("id", "v", "dim", "ask").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    hashed = spread.mapInArrow(_hash(seed, tables, probes), "t int, dim int, cell int, probe boolean, id long, v array<double>")
    best = settled(_searched(settled(hashed, "cells"), k), "found")
    few = rows.filter("ask").select("id", "v", "dim").join(best.filter(F.size("best") >= k).select(F.col("query_id").alias("id")), "id", "left_anti")
    zero = F.lit(0)
    rest = rows.select(zero.alias("t"), "dim", zero.alias("cell"), F.lit(False).alias("probe"), "id", "v").unionByName(few.select(zero.alias("t"), "dim", zero.alias("cell"), F.lit(True).alias("probe"), "id", "v"))
    if not few.isEmpty():
        again = _searched(rest, k)
        best = best.join(again.select("query_id"), "query_id", "left_anti").unionByName(again)
    return best.select("query_id", F.posexplode("best").alias("r", "b")).select("query_id", (F.col("r") + 1).alias("rank"), "b.vec_id", "b.score")


def query(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
