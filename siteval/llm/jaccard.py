"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of five-word shingles. Shingles have one global order: rare first, by a count sketch of the whole table,
then by hash. Two sets of Jaccard similarity t or more share at least l shingles among the first |x| - ceil(t |x|) + l of
each, for every l. Each document picks its own l: the number of partners that share l of its prefix shingles is at most the
summed frequency of the prefix divided by l, so a document with a costly prefix takes a longer one and asks for more shared
shingles. A pair is held to the smaller l of its two documents.

Equal sets are one node. Among the holders of a shingle, the one with the most frequent prefix is the hub: in a group of near
copies that is the text the others were made from. Pairs with a hub are verified first. Holders that are then in one
component need no comparison, so a large group of copies costs one pair per member. All remaining pairs of different
components are counted and verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteval.llm.common import mix, settled, sets_of, signature, table, texts_of
from siteval.operators.groups import connected_components

#: counters of the shingle sketch: its size is fixed, whatever the input
SKETCH = 1 << 20
_PIECE = 1 << 14
_BITS = np.uint64(58)
#: largest l
LEVELS = 4
#: relative costs: one more prefix row, one holder met, one candidate verified
ROW_COST, MEET_COST, VERIFY_COST = 2.0, 1.0, 20.0
#: holders of a shingle in one part of its list
PART = 200_000
#: hubs of a shingle that all its holders are compared with before each other
HUBS = 16
#: holders of a shingle up to which its pairs are joined one by one; the holders of more common ones are compared in blocks
SHORT, PAIR_BLOCK = 32, 1024
_MET = ["a", "b", "c", "n_a", "n_b", "level_a", "level_b", "need_a", "need_b"]
_POSTING = "token long, part int, node long, n int, level int, need int, central int"


def _profile(batches):
    """One row per document (node, size) and, at the end of the task, its part of the shingle sketch in pieces."""
    sketch = np.zeros(SKETCH, np.uint32)
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("piece", pa.int32()), ("counts", pa.binary())])
    for b in batches:
        nodes, sizes, pool, held = [], [], [], 0
        for x in sets_of(b.column(1)):
            nodes.append(signature(x) if len(x) else None)
            sizes.append(len(x))
            pool.append((x >> np.uint64(44)).astype(np.int64))
            held += len(x)
            if held > 1 << 20:
                sketch += np.bincount(np.concatenate(pool), minlength=SKETCH).astype(np.uint32)
                pool, held = [], 0
        if pool:
            sketch += np.bincount(np.concatenate(pool), minlength=SKETCH).astype(np.uint32)
        k = len(nodes)
        yield pa.record_batch([b.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema=schema)
    used = [i for i in range(SKETCH // _PIECE) if sketch[i * _PIECE : (i + 1) * _PIECE].any()]
    k = len(used)
    yield pa.record_batch([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.array(used, pa.int32()),
                           pa.array([sketch[i * _PIECE : (i + 1) * _PIECE].tobytes() for i in used], pa.binary())], schema=schema)


def _add_pieces(key, pdf):
    import pandas as pd
    total = sum(np.frombuffer(c, np.uint32).astype(np.int64) for c in pdf["counts"])
    return pd.DataFrame({"piece": [key[0]], "counts": [total.tobytes()]})


def _sum_sketch(pieces: DataFrame) -> np.ndarray:
    """The sketch of the whole table: pieces of equal place are added in two steps, so no task adds more than a share of the parts."""
    salted = pieces.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16)))

    def first(key, pdf):
        import pandas as pd
        total = sum(np.frombuffer(c, np.uint32).astype(np.int64) for c in pdf["counts"])
        return pd.DataFrame({"piece": [key[0]], "counts": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})

    merged = salted.groupBy("piece", "salt").applyInPandas(first, "piece int, counts binary").groupBy("piece").applyInPandas(_add_pieces, "piece int, counts binary")
    sketch = np.zeros(SKETCH, np.int64)
    for r in merged.collect():  # SKETCH / _PIECE rows at most
        sketch[r.piece * _PIECE : (r.piece + 1) * _PIECE] = np.frombuffer(r.counts, np.int64)
    return sketch


def need_of(freq: np.ndarray, n: int, threshold: int) -> int:
    """The l of a document from the estimated frequencies of its shingles in global order."""
    base = n - -(-threshold * n // 100) + 1
    top = min(LEVELS, n - base + 1)
    met = np.cumsum(freq)
    levels = np.arange(1, top + 1)
    sums = met[base - 1 : base - 1 + top]
    return int(levels[np.argmin(ROW_COST * levels + MEET_COST * sums + VERIFY_COST * sums / levels)])


def _postings(sketch_value, threshold):
    """The prefix rows of every distinct set of a task; sets met again in the task add nothing."""
    def run(batches):
        sketch = sketch_value.value
        noise = sketch.sum() / SKETCH
        order = np.minimum(np.log2(np.maximum(sketch / max(noise, 1.0), 1.0)) * 4, 63).astype(np.uint64) << _BITS
        freq = np.maximum(sketch - 1 - 2 * noise, 0)
        low = (np.uint64(1) << _BITS) - np.uint64(1)
        seen = set()
        for b in batches:
            cols, held = [], 0
            for x in sets_of(b.column(0)):
                if not len(x) or (node := signature(x)) in seen:
                    continue
                seen.add(node)
                n, place = len(x), (x >> np.uint64(44)).astype(np.int64)
                token = order[place] | (x & low)
                by = np.argsort(token)
                f = freq[place[by]]
                need = need_of(f, n, threshold)
                base = n - -(-threshold * n // 100) + 1
                keep = base + need - 1
                level = np.maximum(np.arange(keep) - base + 2, 1)
                parts = np.ceil(np.maximum(f[:keep], 1) / PART).astype(np.int64)
                spread = (node % parts).astype(np.int32) + (parts > 1)
                central = min(int(f[:keep].sum() / keep), 2**31 - 1)
                cols.append((token[by[:keep]].view(np.int64), spread, np.full(keep, node), np.full(keep, n), level, np.full(keep, need), np.full(keep, central)))
                held += keep
                if held > 200_000:
                    yield _batch(cols)
                    cols, held = [], 0
            if cols:
                yield _batch(cols)
    return run


def _batch(cols):
    kinds = [np.int64, np.int32, np.int64, np.int32, np.int32, np.int32, np.int32]
    return pa.record_batch([pa.array(np.concatenate(c).astype(t)) for c, t in zip(zip(*cols), kinds)], names=["token", "part", "node", "n", "level", "need", "central"])


def _verify(threshold):
    def run(batches):
        for b in batches:
            a, c, left, right = b.column(0).to_numpy(), b.column(1).to_numpy(), sets_of(b.column(2)), sets_of(b.column(3))
            ok = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(left, right)):
                if signature(x) == a[i] and signature(y) == c[i]:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok[i] = 100 * both >= threshold * (len(x) + len(y) - both)
            yield b.filter(pa.array(ok)).select([0, 1])
    return run


def _links(pairs: DataFrame, documents: DataFrame, first: DataFrame, key: str, text: str, threshold: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets reach the threshold."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(first, "node")
    texts = texts_of(documents, nodes.select("id").distinct(), key, text).join(nodes, "id").select("node", "text")
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(_verify(threshold), "a long, b long").distinct()


def _counted(rows: DataFrame, threshold: int) -> DataFrame:
    """(a, b): pairs that share enough shingles of the prefixes of their common level m, and whose sizes allow a link.

    Enough is m at least. Shingles shared beyond the prefixes are at most max(o) - m, o being the least overlap of each document
    alone, so the prefixes must also hold what is then missing from the least overlap of the pair."""
    need = F.least("need_a", "need_b")
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b").cast("long") * threshold
    fit = rows.filter(sizes & (F.greatest("level_a", "level_b") <= need)).groupBy("a", "b").agg(F.sum("c").alias("c"), F.min(need).alias("need"), F.min("n_a").alias("n_a"), F.min("n_b").alias("n_b"))
    alone = f"(greatest(n_a, n_b) * {threshold}L + 99) div 100"
    pair = f"((n_a + n_b) * {threshold}L + {99 + threshold}) div {100 + threshold}"
    return fit.filter(f"c >= need and c >= {pair} - {alone} + need").select("a", "b")


def _block_counts(threshold: int):
    def run(t: pa.Table) -> pa.Table:
        """Shared shingles of the holders in a pair of blocks of one hub, for all its shingles at once."""
        token, node, side = (np.asarray(t[c]) for c in ("token", "node", "side"))
        _, at = np.unique(token, return_inverse=True)
        level, out = np.asarray(t["level"]), []
        blocks = []
        for k in (0, 1) if (side == 1).any() else (0,):
            rows = np.flatnonzero(side == k)
            names, first, place = np.unique(node[rows], return_index=True, return_inverse=True)
            held = np.full((len(names), at.max() + 1), LEVELS + 1, np.int8)
            held[place, at[rows]] = level[rows]
            blocks.append((names, held, *(np.asarray(t[c])[rows][first] for c in ("n", "need", "root", "total"))))
        (a, ha, na, da, ra, ta), (b, hb, nb, db, rb, tb) = blocks[0], blocks[-1]
        least = np.minimum(da[:, None], db[None])
        c = np.zeros(least.shape, np.int32)
        for m in np.unique(least):
            c = np.where(least == m, ((ha <= m).astype(np.float32) @ (hb <= m).astype(np.float32).T).astype(np.int32), c)
        # What the other hubs may add at most decides whether the pair can still reach what it needs.
        other = np.minimum((ta - (ha <= LEVELS).sum(axis=1))[:, None], (tb - (hb <= LEVELS).sum(axis=1))[None])
        large = np.maximum(na[:, None], nb[None]).astype(np.int64)
        missing = -(-(na[:, None] + nb[None].astype(np.int64)) * threshold // (100 + threshold)) + (-large * threshold // 100) + least
        fit = (c > 0) & (c + other >= np.maximum(missing, least)) & (ra[:, None] != rb[None]) & (np.minimum(na[:, None], nb[None]) * 100 >= np.maximum(na[:, None], nb[None]) * np.int64(threshold))
        if len(blocks) == 1:
            fit &= a[:, None] < b[None]
        i, j = np.nonzero(fit)
        swap = a[i] > b[j]
        pick = lambda x, y: (np.where(swap, y[j], x[i]), np.where(swap, x[i], y[j]))
        (x, y), (nx, ny), (dx, dy) = pick(a, b), pick(na, nb), pick(da, db)
        one = np.ones(len(i), np.int32)
        return pa.table(dict(zip(_MET, [x, y, c[i, j], nx, ny, one, one, dx, dy])), schema=_MET_SCHEMA)
    return run


_MET_SCHEMA = pa.schema([(c, pa.int64() if c in "ab" else pa.int32()) for c in _MET])


def _long_lists(rows: DataFrame, threshold: int) -> DataFrame:
    """Pairs of holders of common shingles with the number that they share, counted in blocks: lists with the same hub meet in one group,
    so a pair is given out once for all shingles of a hub instead of once for each. The blocks of a hub divide the holders of all its lists."""
    hubs = rows.groupBy("token").agg(F.max(F.struct("central", "node")).alias("h")).select("token", F.col("h.node").alias("hub"))
    own = rows.join(hubs, "token")
    sizes = own.select("hub", "node").distinct().groupBy("hub").agg(F.count(F.lit(1)).alias("most")).select("hub", F.ceil(F.col("most") / PAIR_BLOCK).cast("int").alias("blocks"))
    placed = own.join(sizes, "hub").withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sides = placed.select("hub", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), F.when(F.col("i") <= F.col("j"), 0).otherwise(1).alias("side"), "token", "node", "n", "level", "need", "root", "total")
    return sides.groupBy("hub", "lo", "hi").applyInArrow(_block_counts(threshold), ", ".join(f"{c} {'long' if c in 'ab' else 'int'}" for c in _MET))


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = 75) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_shingles (distinct five-word shingles), component_id (smallest id reachable by links).

    Two documents link when 100 * shared >= threshold * union of their shingle sets. A text of one to four words is one
    shingle; a null text or one without words has none, links with nothing and is its own component. Rows that repeat an id
    are one document: their components are joined. A null id takes part, is returned, and never names a component unless
    its component holds no other id. An empty table gives an empty result; further columns are not read."""
    spark = documents.sparkSession
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    profile = settled(rows.mapInArrow(_profile, "doc_id long, node long, n int, piece int, counts binary"), "profile")
    sketch = spark.sparkContext.broadcast(_sum_sketch(profile.filter("piece is not null").select("piece", "counts")))
    sizes = profile.filter("n is not null").select("doc_id", "node", "n")
    first = sizes.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("id"))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings = rows.select("text").mapInArrow(_postings(sketch, threshold), _POSTING).repartition(parts, "token", "part")
    hubs = postings.groupBy("token", "part").agg(F.max(F.struct("central", "node", "n", "level", "need")).alias("hub"), F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi or part > 0")
    shared = settled(postings.join(hubs.drop("lo", "hi"), ["token", "part"]), "shared")
    held = [F.col("hub.node").alias("a"), F.col("hub.n").alias("n_a"), F.col("hub.level").alias("level_a"), F.col("hub.need").alias("need_a"),
            F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("level").alias("level_b"), F.col("need").alias("need_b")]
    spokes = shared.select(*held)
    # The hubs of the parts of a divided list meet each other through the most central of them.
    divided = shared.filter("part > 0").select("token", "hub").distinct()
    tops = divided.groupBy("token").agg(F.max("hub").alias("top"))
    across = divided.join(tops, "token").select("token", F.col("top").alias("hub"), "hub.node", "hub.n", "hub.level", "hub.need").select(*held)
    met = spokes.unionByName(across).filter("a <> b").withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b"), "c": F.lit(1)})
    checked = settled(_counted(met, threshold), "spokes")
    links = settled(_links(checked, documents, first, key, text, threshold), "links")

    member = settled(shared.select("token", "node", "n", "level", "need", "central").distinct(), "members")
    names = ["n", "level", "need", "root"]
    for hubs_only in (True, False):
        roots = settled(connected_components(links), "roots")
        links = roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))  # stars: the next round starts from them
        own = member.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = own.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("c")).filter("lo < hi")
        open_ = own.join(mixed.select("token", "c"), "token")
        if hubs_only:  # a holder that is not near the hub may be near one of the next
            rank = F.row_number().over(W.partitionBy("token").orderBy(F.desc("central"), F.desc("node")))
            left = open_.withColumn("rank", rank).filter(F.col("rank") <= HUBS).select("token", F.col("node").alias("a"), *[F.col(c).alias(f"{c}_a") for c in names])
            right = open_.select("token", F.col("node").alias("b"), *[F.col(c).alias(f"{c}_b") for c in names])
            met = left.join(right, "token").filter("root_a <> root_b").withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")}).distinct().withColumn("c", F.lit(1))
        else:
            open_ = open_.join(open_.groupBy("node").agg(F.count(F.lit(1)).cast("int").alias("total")), "node")
            short, long_ = open_.filter(F.col("c") <= SHORT), open_.filter(F.col("c") > SHORT)
            sides = [short.select("token", F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in names]) for x in "ab"]
            met = sides[0].join(sides[1], "token").filter("a < b and root_a <> root_b").withColumn("c", F.lit(1)).select(*_MET).unionByName(_long_lists(long_, threshold))
        pairs = settled(_counted(met, threshold).join(checked, ["a", "b"], "left_anti"), "pairs")
        checked = checked.unionByName(pairs)
        links = links.unionByName(settled(_links(pairs, documents, first, key, text, threshold), "links"))

    # Rows that repeat an id under different texts are one document.
    several = sizes.filter("node is not null and doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").select("doc_id", "a")
    again = sizes.select("doc_id", F.col("node").alias("b")).join(several, "doc_id").filter("a <> b").select("a", "b")
    roots = connected_components(links.unionByName(again))
    placed = first.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    names_ = placed.join(least, "root").select("node", "component_id")
    return sizes.join(names_, "node", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicated(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``documents`` whose id names their component: of each group of near duplicates the smallest id stays.

    Rows with a null id stay. Rows that repeat the id that stays all stay; use distinct() where a table may hold such rows."""
    groups = near_duplicates(documents, key, text)
    gone = groups.filter("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return documents.join(gone, F.col(key) == F.col("_gone"), "left_anti")


def query(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
