"""Near-duplicate embeddings by E8 lattice hashing.

Every table projects unit vectors to eight random directions, scales them and decodes the nearest point of the E8 lattice;
a vector lives in that cell and looks into the neighbouring cells closest to it. What meets in a cell is compared by a
128-bit sign sketch and then exactly. The smallest vector at home in a cell is its hub: the others are compared with the hub
first, and with each other only if they are still in different components. Links are counted inside components, in blocks.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteval.llm.common import settled, table
from siteval.operators.groups import connected_components

TABLES, PROBES, SCALE = 10, 4, 1.75
#: sign bits that a pair at the threshold may differ in: its mean plus seven standard deviations
SKETCH_BITS = 128
BLOCK = 1024
#: participants of a cell in one block of a comparison
PART = 512


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of one, or all entries of one half with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(out)


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points of even sum: round, and where the sum is odd round the worst coordinate the other way."""
    r = np.rint(x)
    d = x - r
    odd = np.flatnonzero(r.sum(axis=1) % 2)
    k = np.abs(d[odd]).argmax(axis=1)
    r[odd, k] += np.where(d[odd, k] >= 0, 1, -1)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points of (n, 8): the better of the even points and the even points moved by one half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def _unit(column) -> np.ndarray:
    n = len(column)
    x = np.asarray(column.values)[: len(column.values)].reshape(n, -1) if n else np.zeros((0, 1))
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])  # an exact scaling, so that no square leaves the range of doubles
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(embeddings: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v array<double>, dim): one row per id that is not null, with the vector if it takes part, else null. Vectors that are null, empty,
    zero or hold null or non-finite components take no part; of rows that repeat an id the smallest vector counts."""
    v = F.col(vector).cast("array<double>")
    sound = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = embeddings.select(F.col(key).cast("long").alias("id"), F.when(sound, v).alias("v"), *[c for c in embeddings.columns if c not in (key, vector)])
    return rows.filter("id is not null").withColumn("dim", F.size("v"))


def _cells(seed: int, tables: int, probes: int, scale: float):
    near = minimal_vectors()

    def run(batches):
        for b in batches:
            ids, labels, dims = b.column(0).to_numpy(), b.column(1), b.column(3).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                u = _unit(b.column(2).take(pa.array(at)))
                rng = np.random.default_rng([seed, int(dim)])
                planes = rng.normal(size=(dim, SKETCH_BITS))
                words = np.packbits(u @ planes > 0, axis=1).view(np.int64)
                label = labels.take(pa.array(at))
                for t in range(tables):
                    x = u @ rng.normal(size=(dim, 8)) / scale
                    home = decode(x)
                    gain = (x - home) @ near.T * 2 - (near**2).sum(axis=1)
                    best = np.argpartition(-gain, probes, axis=1)[:, :probes] if probes else np.zeros((len(x), 0), int)
                    for p in range(probes + 1):
                        cell = home if not p else home + near[best[:, p - 1]]
                        name = pa.array((cell * 2).astype(np.int8).tobytes()[i * 8 : i * 8 + 8] for i in range(len(cell)))
                        n = len(at)
                        yield pa.record_batch([label, pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, t, np.int32)), name.cast(pa.binary()), pa.array(np.full(n, not p)),
                                               pa.array(ids[at]), pa.array(words[:, 0]), pa.array(words[:, 1])], names=["label", "dim", "t", "cell", "home", "node", "x", "y"])
    return run


def _cosines(threshold):
    def run(batches):
        for b in batches:
            n = b.num_rows
            ok = np.zeros(n, bool)
            dims = np.asarray(b.column(4))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                ok[at] = (_unit(b.column(2).take(pa.array(at))) * _unit(b.column(3).take(pa.array(at)))).sum(axis=1) >= threshold
            yield b.filter(pa.array(ok)).select([0, 1])
    return run


def _count(threshold):
    """Links of the members of one component in a pair of blocks: equal vectors are one row with its number of ids."""
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        side = np.asarray(t["side"])
        ids, many = np.asarray(t["node"]), np.asarray(t["copies"])
        u = _unit(t["v"].combine_chunks() if isinstance(t["v"], pa.ChunkedArray) else t["v"])
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side != 0)
        if not len(b):  # a block with itself
            near = u[a] @ u[a].T >= threshold
            np.fill_diagonal(near, False)
            return pa.table({"node": ids[a], "n": (near * many[a]).sum(axis=1)})
        near = u[a] @ u[b].T >= threshold
        return pa.table({"node": np.concatenate([ids[a], ids[b]]), "n": np.concatenate([(near * many[b]).sum(axis=1), (near.T * many[a]).sum(axis=1)])})
    return run


def near_duplicates(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label", threshold: float = 0.93,
                    tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = 0) -> DataFrame:
    """One row per id: vec_id, n_links (other ids linked directly), component_id (smallest id reachable), kept (id names its component).

    Two vectors of one label and one length link when the cosine in double precision reaches ``threshold``. Null labels and unusable vectors
    link with nothing. Equal vectors are one node. Rows that repeat an id are one vector (see ``usable``); rows with a null id
    are left out; an empty table gives an empty result; further columns are not read."""
    spark = embeddings.sparkSession
    own = embeddings.select(key, vector, *([F.col(label).cast("string").alias("label")] if label else [F.lit("").alias("label")]))
    rows = usable(own, key, vector).groupBy("id").agg(F.min(F.struct("v", "label", "dim")).alias("s")).select("id", "s.*")
    rows = settled(rows.withColumn("v", F.when(F.col("label").isNotNull(), F.col("v"))), "vectors")
    node = settled(rows.filter("v is not null").groupBy("label", "v").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("v")), "nodes")

    spread = node.select("node", "label", "v", "dim").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    cells = settled(spread.mapInArrow(_cells(seed, tables, probes, scale), "label string, dim int, t int, cell binary, home boolean, node long, x long, y long"), "cells")
    angle = float(np.arccos(threshold) / np.pi)
    allowed = int(SKETCH_BITS * angle + 7 * (SKETCH_BITS * angle * (1 - angle)) ** 0.5)
    at = ["label", "dim", "t", "cell"]

    def near(a, b):
        return F.bit_count(F.col(f"{a}x").bitwiseXOR(F.col(f"{b}x"))) + F.bit_count(F.col(f"{a}y").bitwiseXOR(F.col(f"{b}y"))) <= allowed

    def verified(pairs):
        v = node.select("node", "v", "dim")
        both = pairs.join(v.select(F.col("node").alias("a"), F.col("v").alias("va"), "dim"), "a").join(v.select(F.col("node").alias("b"), F.col("v").alias("vb")), "b")
        return both.select("a", "b", "va", "vb", "dim").mapInArrow(_cosines(threshold), "a long, b long")

    hubs = cells.filter("home").groupBy(*at).agg(F.min(F.struct("node", "x", "y")).alias("h")).select(*at, F.col("h.node").alias("hub"), F.col("h.x").alias("hx"), F.col("h.y").alias("hy"))
    spokes = cells.join(hubs, at).filter((F.col("node") != F.col("hub")) & near("", "h")).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    links = settled(verified(spokes), "links")
    roots = connected_components(links)
    placed = settled(cells.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    full = placed.groupBy(*at).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.sum(F.col("home").cast("int")).alias("homes"), F.count(F.lit(1)).alias("c")).filter("lo < hi and homes > 1")
    full = full.select(*at, F.ceil(F.col("c") / PART).cast("int").alias("blocks"))
    open_ = placed.join(full, at)
    left = open_.select(*at, F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.col("node").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("root").alias("ra"))
    right = open_.filter("home").select(*at, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("node").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("root").alias("rb"))
    rest = left.join(right, [left[c] == right[c] for c in [*at, "block"]] + [F.col("ra") != F.col("rb"), near("a", "b")]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = links.unionByName(settled(verified(rest), "links"))
    roots = connected_components(links)

    # All links of a node lie in its component: count them there, a pair of blocks at a time.
    size = roots.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    member = roots.join(size, "root").join(node, "node").select("root", "blocks", "node", "copies", "v", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("i"))
    pairs = member.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("root", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), F.when(F.col("i") <= F.col("j"), 0).otherwise(1).alias("side"), "node", "copies", "v")
    counted = pairs.groupBy("root", "lo", "hi").applyInArrow(_count(threshold), "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    known = node.join(roots, "node", "left").join(counted, "node", "left").select("label", "v", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("n", F.lit(0)).alias("n"))
    got = rows.join(known, ["label", "v"], "left")
    component = F.coalesce("root", "id")
    return got.select(F.col("id").alias("vec_id"), F.coalesce(F.col("n") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))


def query(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))
