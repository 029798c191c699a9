"""Signatures, near-duplicate links, connected groups, folds and splits."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteval.functions.hashing import hash52, key_text
from siteval.operators.ordering import hash_rank
from siteval.runtime import case, checkpoint, total

#: signatures per block of a large bucket
_BLOCK = 2048


def signature64(df: DataFrame, key: str, text: str) -> DataFrame:
    """64-bit similarity hash of a text: sign of the summed token bits. Output: key, sig (bigint).

    Bits are added up where a text is split: the tokens of a text lie together, so one row per text and task is shuffled, never its tokens."""
    tokens = df.select(key, F.explode(F.filter(F.split(F.col(text), r"\s+"), lambda t: t != "")).alias("_t")).select(key, F.md5("_t").alias("_m"))
    halves = tokens.select(key, *[F.conv(F.substring("_m", 1 + 8 * h, 8), 16, 10).cast("long").alias(f"_w{h}") for h in (0, 1)])
    # Two counters per sum: bit b of both halves, 32 bits apart (a text holds fewer than 2^31 tokens).
    one = F.lit(1).cast("long")
    lanes = [F.sum(F.shiftleft(F.shiftright("_w0", b).bitwiseAND(one), 32) + F.shiftright("_w1", b).bitwiseAND(one)).alias(f"_s{b}") for b in range(32)]
    wide = halves.groupBy(key).agg(F.count(F.lit(1)).alias("_all"), *lanes)
    low = F.lit(0xFFFFFFFF)

    def word(count):
        return total([F.when(count(F.col(f"_s{b}")) * 2 > F.col("_all"), F.lit(1 << b).cast("long")).otherwise(F.lit(0).cast("long")) for b in range(32)])

    signature = F.shiftleft(word(lambda s: F.shiftrightunsigned(s, 32)), 32).bitwiseOR(word(lambda s: s.bitwiseAND(low)))
    # A text without tokens has no signature bits set.
    return df.select(key).join(wide.select(key, signature.alias("sig")), key, "left").select(key, F.coalesce("sig", F.lit(0).cast("long")).alias("sig"))


def _band_masks(bands: int) -> list[int]:
    """The 64 bits cut into ``bands`` runs of nearly equal width, as signed 64-bit masks."""
    edges = [64 * i // bands for i in range(bands + 1)]
    masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _band_keys(sigs: DataFrame, d: int, bands: int) -> DataFrame:
    """Every signature under each set of bands that a pair at distance <= d must share (pigeonhole): (sig, combo, band).

    ``combo`` is the set of bands as bits, ``band`` the signature masked to them. The masks are one constant array."""
    if bands <= d:
        raise ValueError("bands must exceed the distance")
    masks = _band_masks(bands)
    rows = []
    for c in combinations(range(bands), bands - d):
        mask = 0
        for b in c:
            mask |= masks[b]
        rows.append(f"named_struct('combo', {sum(1 << b for b in c)}, 'mask', {mask}L)")
    keyed = sigs.select("sig", F.expr(f"inline(array({', '.join(rows)}))"))
    return keyed.select("sig", "combo", F.col("sig").bitwiseAND(F.col("mask")).alias("band"))


def _reports(a: Column, b: Column, combo: Column, bands: int) -> Column:
    """True in exactly one of the buckets a pair shares: the one whose combo holds the lowest shared bands, that is, no
    shared band below the highest band of the combo lies outside it."""
    x = a.bitwiseXOR(b)
    shared = total([F.when(x.bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, m in enumerate(_band_masks(bands))])
    below = case([(combo >= (1 << i), (2 << i) - 1) for i in reversed(range(bands))])
    return shared.bitwiseAND(below) == combo


def hamming_pairs(sigs: DataFrame, d: int = 10, bands: int | None = None, sig: str = "sig") -> DataFrame:
    """All pairs of distinct signatures at Hamming distance <= d: (sig_a, sig_b, distance), sig_a < sig_b.

    Equal signatures are one node, so copies never multiply pairs. Buckets above the block size are cut into blocks and
    joined block against block, so no task meets a whole hot bucket."""
    bands = bands or d + 3
    keyed = _band_keys(sigs.select(F.col(sig).alias("sig")).distinct(), d, bands)
    sizes = keyed.groupBy("combo", "band").agg(F.ceil(F.count(F.lit(1)) / _BLOCK).alias("blocks")).filter("blocks > 1")
    left = keyed.join(sizes, ["combo", "band"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    a = left.select("combo", "band", F.col("sig").alias("sig_a"), F.pmod(F.xxhash64("sig"), F.col("blocks")).alias("block"))
    b = left.select("combo", "band", F.col("sig").alias("sig_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    near = F.bit_count(F.col("sig_a").bitwiseXOR(F.col("sig_b")))
    j = a.join(b, ["combo", "band", "block"]).filter((F.col("sig_a") < F.col("sig_b")) & (near <= d))
    j = j.filter(_reports(F.col("sig_a"), F.col("sig_b"), F.col("combo"), bands))
    return j.select("sig_a", "sig_b", near.alias("distance"))


def near_links(sigs: DataFrame, d: int = 10, bands: int | None = None) -> DataFrame:
    """Enough links between distinct signatures to connect all that are chained by distance <= d.

    In every bucket the smallest signature is the hub: members within d of it are linked to it and need no comparison among
    themselves. Only the members further away are compared with the bucket, so a dense group of near copies costs one link
    per member instead of all its pairs."""
    bands = bands or d + 3
    keyed = _band_keys(sigs.select("sig").distinct(), d, bands)
    hubs = keyed.groupBy("combo", "band").agg(F.min("sig").alias("hub"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    member = keyed.join(hubs, ["combo", "band"]).filter("sig <> hub")
    close = F.bit_count(F.col("sig").bitwiseXOR(F.col("hub"))) <= d
    spokes = member.filter(close).select(F.col("sig").alias("a"), F.col("hub").alias("b"))
    rest = member.filter(~close).select("combo", "band", F.col("sig").alias("sig_a"), F.pmod(F.xxhash64("sig"), F.ceil(F.col("_n") / _BLOCK)).alias("block"))
    others = member.select("combo", "band", F.col("sig").alias("sig_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_n") / _BLOCK) - 1)).alias("block"))
    near = F.bit_count(F.col("sig_a").bitwiseXOR(F.col("sig_b"))) <= d
    ties = rest.join(others, ["combo", "band", "block"]).filter((F.col("sig_a") != F.col("sig_b")) & near)
    return spokes.unionByName(ties.select(F.col("sig_a").alias("a"), F.col("sig_b").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge table (a, b); root is the smallest node of the component.

    Alternating large-star and small-star steps: each is one min-aggregation and one join, and each round is written to the
    checkpoint folder. Edges shrink towards stars, so a component of any size needs a logarithmic number of rounds."""
    e = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low2, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(linked.unionByName(low2.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicate_groups(items: DataFrame, key: str, sig: str = "sig", d: int = 10, bands: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """(key, grp): items whose signatures chain within d bits, or that ``known`` pairs (a, b of keys) join, share a group.

    Groups are named by their smallest signature; known pairs are translated to signatures first."""
    sigs = items.select(F.col(sig).alias("sig")).distinct()
    links = near_links(sigs, d, bands)
    if known is not None:
        at = items.select(key, F.col(sig).alias("sig"))
        pairs = known.join(at.select(F.col(key).alias("a"), F.col("sig").alias("sa")), "a").join(at.select(F.col(key).alias("b"), F.col("sig").alias("sb")), "b")
        links = links.unionByName(pairs.filter("sa <> sb").select(F.col("sa").alias("a"), F.col("sb").alias("b")))
    roots = connected_components(links)
    return items.select(key, F.col(sig).alias("node")).join(roots, "node", "left").select(key, F.coalesce("root", "node").alias("grp"))


def assign_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """(group, n, fold): whole groups dealt out in order of size (hash of the key on ties), so folds stay balanced."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    by_size = hash_rank(sizes, F.md5(F.col(group).cast("string")), "_r", ("n",))
    larger = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("_c"))
    before = larger.select("n", F.coalesce(F.sum("_c").over(W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return by_size.join(before, "n").select(group, "n", ((F.col("_b") + F.col("_r") - 1) % k).cast("int").alias("fold"))


def hash_folds(df: DataFrame, group: str, k: int = 5, seed: int = 0) -> DataFrame:
    """Fold by hash of the group: no shuffle at all; balance is statistical."""
    return df.withColumn("fold", (hash52(seed, F.col(group)) % k).cast("int"))


def group_split(df: DataFrame, group: str, fractions=(0.7, 0.15, 0.15), seed: int = 0, names=("train", "dev", "test")) -> DataFrame:
    """(group, split): groups in hashed order, cut at rounded counts."""
    groups = df.select(group).distinct()
    ranked = hash_rank(groups, F.md5(key_text(seed, F.col(group))), "_r")
    n = groups.agg(F.count(F.lit(1))).scalar()
    cut = ranked.withColumn("_n", n)
    first = F.bround(F.col("_n") * F.lit(float(fractions[0])))
    second = first + F.bround(F.col("_n") * F.lit(float(fractions[1])))
    return cut.select(group, F.when(F.col("_r") <= first, names[0]).when(F.col("_r") <= second, names[1]).otherwise(names[2]).alias("split"))


def sample_without_replacement(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n keys in hashed order."""
    return hash_rank(df, F.md5(key_text(seed, F.col(key))), "_r").filter(F.col("_r") <= n).drop("_r")


def groups_of(ids: DataFrame, groups: DataFrame | None, key: str, default: Column) -> DataFrame:
    """Group per id: the given one, else the default."""
    if groups is None:
        return ids.select(key, default.alias("grp"))
    return ids.join(groups.select(key, F.col("grp").alias("_g")), key, "left").select(key, F.coalesce("_g", default).alias("grp"))
