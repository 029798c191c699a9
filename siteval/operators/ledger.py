"""The failure ledger: severity, cause flags and report tables of every site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteval.constants import AMPUTATION, GROSS_CONFIDENCE, GROSS_SIZE, KEY_PIXELS, STUMP_MIN_PX, WOUND
from siteval.functions import probs as P
from siteval.functions.labels import class_name
from siteval.functions.stats import safe_ratio
from siteval.operators.metrics import count_if, share_if
from siteval.operators.ordering import top_per_group
from siteval.operators.quantiles import exact_median
from siteval.runtime import case

#: share of the true key pixels under which a hit was luck or a miss was the map's
LOST_SHARE = 0.3
NEAR_P = 0.6


def key_pixels(cls: Column, raw: Column) -> Column:
    """Class-defining pixels of a record; NULL for other classes or a NULL record."""
    return case([(cls == WOUND, raw[KEY_PIXELS["wound"]]), (cls == AMPUTATION, raw[KEY_PIXELS["amputation"]])])


def severity(y: Column, pred: Column, conf: Column, p_true: Column, raw: Column, raw_true: Column, wound_visible_px: Column) -> Column:
    """gross / near for wrong sites, lucky / near / ok for right ones."""
    big = ((y == AMPUTATION) & (raw_true["stump_px"] >= GROSS_SIZE["amputation"])) | ((y == WOUND) & (wound_visible_px >= GROSS_SIZE["wound"]))
    true_px, seen_px = key_pixels(y, raw_true), key_pixels(y, raw)
    lucky = (true_px >= STUMP_MIN_PX) & (seen_px <= true_px * LOST_SHARE)
    def yes(c):
        return F.coalesce(c, F.lit(False))
    wrong = F.when((conf >= GROSS_CONFIDENCE) | yes(big), "gross").otherwise("near")
    right = F.when(yes(lucky), "lucky").when(p_true < NEAR_P, "near").otherwise("ok")
    return F.when(y != pred, wrong).otherwise(right)


def with_causes(df: DataFrame, alt_rules) -> DataFrame:
    """Add severity, flags, sub, cause and fixed_by_group.

    df: y, pred, p, labels (rule -> class index), raw, raw_true, wound_visible_px, kp (struct err_torso, side_swap, or NULL),
    pred_side, pred_true_fixed, pred_true_refit (class index, or NULL where the counterfactual is missing) and
    swaps (group name -> class index)."""
    y, pred, raw, true = F.col("y"), F.col("pred"), F.col("raw"), F.col("raw_true")
    def yes(c):
        return F.coalesce(c, F.lit(False))
    sev = severity(y, pred, P.confidence(F.col("p")), F.element_at(F.col("p"), y + 1), raw, true, F.col("wound_visible_px"))
    d = df.withColumn("severity", sev).withColumn("_look", (y != pred) | (F.col("severity") == "lucky"))
    boundary = F.lit(False)
    for rule in alt_rules:
        other = F.col("labels")[rule]
        boundary = boundary | yes((other != y) & (other == pred))
    flag_l = boundary | yes((y == AMPUTATION) & (true["stump_px"] == 0))
    flag_k = yes(F.col("pred_side") == y)
    flag_pos = yes(F.col("kp.side_swap") | (F.col("kp.err_torso") > 0.15))
    flag_s = yes(F.col("pred_true_fixed") == y) | yes(F.col("pred_true_refit") == y)
    flags = F.array_compact(F.array(F.when(flag_l, "L"), F.when(flag_k, "K"), F.when(flag_pos, "K-pos"), F.when(flag_s, "S").when(true.isNotNull(), "F")))
    true_px, seen_px = key_pixels(y, true), F.coalesce(key_pixels(y, raw), F.lit(0))
    hall_px, hall_true = key_pixels(pred, raw), F.coalesce(key_pixels(pred, true), F.lit(0))
    ratio = raw["vis_px"] / F.greatest(true["vis_px"], F.lit(1))
    kind = (F.when(yes((true_px >= STUMP_MIN_PX) & (seen_px <= true_px * LOST_SHARE)), "miss")
            .when(yes((hall_px >= STUMP_MIN_PX) & (hall_true <= hall_px * LOST_SHARE)), "hall")
            .when(yes((true["vis_px"] > 0) & ~ratio.between(0.5, 2)), "extent").otherwise("other"))
    fixed_by = F.map_keys(F.map_filter("swaps", lambda _, c: c == y))
    d = d.withColumn("flags", F.when(F.col("_look"), flags).otherwise(F.array().cast("array<string>")))
    has_s = F.array_contains("flags", "S")
    cause = F.when(y != pred, case([(F.array_contains("flags", c), c) for c in ("L", "K", "S", "F")]))
    d = d.withColumn("cause", cause).withColumn("cause_sub", F.when(F.col("cause") == "S", kind))
    return d.withColumn("fixed_by_group", F.when(has_s, F.coalesce(fixed_by, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))).drop("_look")


def ledger(df: DataFrame, alt_rules, phase: str, schema: str = "ledger/1.0") -> DataFrame:
    """Ledger rows in storage form. Needs what ``with_causes`` needs, and feature_delta_top3 and truth context columns if any."""
    d = with_causes(df, alt_rules)
    delta = F.create_map(*[v for k in ("vis_px", "ext_px", "stump_px", "wound_px", "tq_px") for v in (F.lit(k), F.struct(
        F.col("raw")[k].alias("pred"), F.col("raw_true")[k].alias("true")))])
    optional = [c for c in ("feature_delta_top3", "position", "visible_fraction", "kp") if c in d.columns]
    counter = F.create_map(*[v for k in ("side", "true_fixed", "true_refit") for v in (F.lit(k), class_name(F.col(f"pred_{k}")))])
    return d.select(
        F.lit(schema).alias("schema"), F.lit(phase).alias("phase"), "scene", "site", "split", class_name(F.col("y")).alias("true"), class_name(F.col("pred")).alias("pred"),
        (F.col("y") == F.col("pred")).alias("correct"), F.transform("p", lambda v: F.round(v, 3)).alias("p"), F.round(P.margin(F.col("p")), 3).alias("margin"), "severity", "cause",
        "cause_sub", "flags", "fixed_by_group", counter.alias("counterfactual"), F.transform_values("labels", lambda _, v: class_name(v)).alias("labels_alt"), delta.alias("delta"), *optional,
        F.struct(F.lit(None).cast("string").alias("cause_override"), F.lit(None).cast("string").alias("note")).alias("review"))


def cause_pareto(df: DataFrame, by=("split",)) -> DataFrame:
    """Errors per cause (with sub-type), gross and near, and their share of the errors of the group."""
    code = F.when(F.col("cause").isNull(), "unassigned").otherwise(F.concat_ws("-", "cause", "cause_sub"))
    per = df.filter(F.col("y") != F.col("pred")).groupBy(*by, code.alias("code")).agg(count_if(F.col("severity") == "gross").alias("gross"),
                                                                                      count_if(F.col("severity") != "gross").alias("near"))
    n = F.col("gross") + F.col("near")
    return per.select(*by, "code", "gross", "near", n.alias("total"), safe_ratio(n, F.sum(n).over(W.partitionBy(*by))).alias("share"))


def error_pairs_with_causes(df: DataFrame, by=("split",)) -> DataFrame:
    """Counts per (true, predicted) with their causes as text, most frequent first."""
    cell = df.filter(F.col("y") != F.col("pred")).groupBy(*by, "y", "pred", F.coalesce("cause", F.lit("?")).alias("c")).agg(F.count(F.lit(1)).alias("k"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("o"), F.col("c"))))
    per = cell.groupBy(*by, "y", "pred").agg(F.sum("k").alias("n"), listed.alias("_c"))
    return per.select(*by, "y", "pred", "n", F.array_join(F.transform("_c", lambda s: F.concat_ws(" ", s["c"], (-s["o"]).cast("string"))), ", ").alias("causes"))


def key_pixel_ratio(df: DataFrame, by=("split",)) -> DataFrame:
    """Predicted over true key pixels on true wounds and amputations, by position: n, median, share under 0.3."""
    true = key_pixels(F.col("y"), F.col("raw_true"))
    rows = df.filter(F.col("y").isin(WOUND, AMPUTATION)).withColumn("_t", true).filter("_t > 0")
    rows = rows.select(*by, class_name(F.col("y")).alias("class"), "position", (F.coalesce(key_pixels(F.col("y"), F.col("raw")), F.lit(0)) / F.col("_t")).alias("r"))
    keys = [*by, "class", "position"]
    shares = rows.groupBy(*keys).agg(share_if(F.col("r") < 0.3).alias("under_0.3"))
    return exact_median(rows, F.col("r"), keys, "median_ratio").join(shares, keys)


def top_gross(df: DataFrame, n: int = 20, by=("split",)) -> DataFrame:
    """The n most confident gross errors per group."""
    rows = df.filter((F.col("y") != F.col("pred")) & (F.col("severity") == "gross")).withColumn("conf", P.confidence(F.col("p")))
    return top_per_group(rows, by, [F.desc("conf"), "scene", "site"], n)


def severity_counts(df: DataFrame, by=("split",)) -> DataFrame:
    return df.groupBy(*by, "severity", (F.col("y") == F.col("pred")).alias("correct")).agg(F.count(F.lit(1)).alias("n"))
