"""Operators on pixel tables: one row per pixel with class codes and owner bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteval.functions.stats import safe_ratio
from siteval.operators.metrics import count_if, share_if
from siteval.operators.quantiles import exact_median
from siteval.runtime import lookup


def pixel_confusion(px: DataFrame, gt: str = "gt", pred: str = "pred") -> DataFrame:
    """Counts per (true, predicted) code."""
    return px.groupBy(gt, pred).agg(F.count(F.lit(1)).alias("n"))


def pixel_iou(px: DataFrame, gt: str = "gt", pred: str = "pred") -> DataFrame:
    """Intersection over union per class, from the confusion counts: both marginals come from one small stacked sum."""
    cells = pixel_confusion(px, gt, pred)
    ends = F.array(F.struct(F.col(gt).alias("class"), F.col("n").alias("g"), F.lit(0).cast("long").alias("p"), F.when(F.col(gt) == F.col(pred), F.col("n")).otherwise(0).alias("i")),
                   F.struct(F.col(pred).alias("class"), F.lit(0).cast("long").alias("g"), F.col("n").alias("p"), F.lit(0).cast("long").alias("i")))
    sums = cells.select(F.explode(ends).alias("_e")).select("_e.*").groupBy("class").agg(F.sum("g").alias("gt_px"), F.sum("p").alias("_p"), F.sum("i").alias("inter"))
    union = F.col("gt_px") + F.col("_p") - F.col("inter")
    return sums.select("class", "gt_px", "inter", union.alias("union"), safe_ratio(F.col("inter"), union).alias("iou"))


def mean_iou(px: DataFrame, gt: str = "gt", pred: str = "pred") -> DataFrame:
    """Mean IoU over the classes present in the truth."""
    return pixel_iou(px, gt, pred).filter("gt_px > 0").agg(F.avg("iou").alias("miou"), F.count(F.lit(1)).alias("classes"))


def top_confusions(px: DataFrame, n: int = 12, gt: str = "gt", pred: str = "pred") -> DataFrame:
    """The n largest off-diagonal cells."""
    return pixel_confusion(px, gt, pred).filter(F.col(gt) != F.col(pred)).orderBy(F.desc("n"), gt, pred).limit(n)


def mask_iou(px: DataFrame, a: str, b: str, entity, by=(), good: float = 0.7) -> DataFrame:
    """IoU of two boolean masks per entity; its median and the share of good ones."""
    per = px.groupBy(*entity, *by).agg(safe_ratio(count_if(F.col(a) & F.col(b)), count_if(F.col(a) | F.col(b))).alias("iou")).filter("iou IS NOT NULL")
    shares = per.groupBy(*by).agg(F.count(F.lit(1)).alias("entities"), share_if(F.col("iou") >= good).alias("share_good"))
    median = exact_median(per, F.col("iou"), by, "iou_median").drop("n")
    return shares.join(median, list(by)) if by else shares.select("*", median.scalar().alias("iou_median"))


def bitmask_containment(px: DataFrame, code: str, bit: str, limit: float = 0.005, keys=("scene",), site: str = "site") -> DataFrame:
    """Share of visible pixels whose outline code lacks the site's bit; worst scene and pass flag per site."""
    outside = F.col(code).bitwiseAND(F.col(bit)) == 0
    per = px.groupBy(*keys, site).agg(share_if(outside).alias("out"))
    return per.groupBy(site).agg(F.max("out").alias("worst"), count_if(F.col("out") > limit).alias("scenes_over"), (F.max("out") <= limit).alias("ok"))


def stump_overlap_swaps(px: DataFrame, pred_site: str, true_site: str, keys=("scene",), min_px: int = 30) -> DataFrame:
    """Per (scene, site): overlap of the predicted mask with the own and with the opposite true mask, where both masks are
    large enough. A swap is an opposite overlap above the own one. Codes: 0 none, else 2*limb+side with side 0/1."""
    p, g = F.col(pred_site), F.col(true_site)
    def other(c):
        return F.when(c % 2 == 0, c + 1).otherwise(c - 1)
    ends = F.array(F.struct(p.alias("site"), F.lit(1).alias("p"), F.lit(0).alias("g"), (p == g).cast("int").alias("own"), (p == other(g)).cast("int").alias("opp")),
                   F.struct(g.alias("site"), F.lit(0).alias("p"), F.lit(1).alias("g"), F.lit(0).alias("own"), F.lit(0).alias("opp")))
    rows = px.select(*keys, F.explode(ends).alias("_e")).select(*keys, "_e.*").filter("site IS NOT NULL")
    per = rows.groupBy(*keys, "site").agg(F.sum("p").alias("pred_px"), F.sum("g").alias("true_px"), F.sum("own").alias("own_px"), F.sum("opp").alias("opp_px"))
    return per.filter((F.col("pred_px") >= min_px) & (F.col("true_px") >= min_px)).withColumn("swap", F.col("opp_px") > F.col("own_px"))


def colour_code(r: Column, g: Column, b: Column) -> Column:
    """Three channels quantised to 0, 1, 2 and read as a base-3 number."""
    # Fixed values. Channel cuts between the three levels.
    low, high = 90, 220

    def level(c):
        return F.when(c > high, 2).when(c > low, 1).otherwise(0)

    return level(r) * 9 + level(g) * 3 + level(b)


def decode_code(code: Column, names: dict[int, str]) -> Column:
    """Base-3 code to class name; unknown codes give NULL."""
    return lookup(code, names)


def signal_ratios(px: DataFrame, hidden: str, masks) -> DataFrame:
    """Recall of hidden pixels and precision, for every mask column."""
    h = F.col(hidden)
    rows = []
    aggs = [count_if(h).alias("_h")]
    for m in masks:
        aggs += [count_if(F.col(m)).alias(f"_n_{m}"), count_if(F.col(m) & h).alias(f"_b_{m}")]
        rows.append(F.struct(F.lit(m).alias("mask"), (F.col(f"_b_{m}") / F.greatest(F.col("_h"), F.lit(1))).alias("recall"),
                             (F.col(f"_b_{m}") / F.greatest(F.col(f"_n_{m}"), F.lit(1))).alias("precision")))
    return px.agg(*aggs).select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")
