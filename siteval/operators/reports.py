"""Report tables over the site table and the logs. Each is a few partial aggregations; results are small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteval.constants import AMPUTATION, CLASSES, ERROR_TAGS, NO_INJURY, NOT_TESTABLE, STUMP_MIN_PX, WOUND, WOUND_MIN_PX
from siteval.functions.stats import safe_ratio
from siteval.operators.metrics import count_if, share_if
from siteval.operators.pairing import mirror_pairs
from siteval.operators.quantiles import exact_median, exact_quantiles, with_scalars


def _medians(out: DataFrame, df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``out`` with medians over the whole of ``df`` added, all from one pass over stacked values."""
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("stat"), v.cast("double").alias("v")) for n, v in values.items()]))
    rows = df.select(stacked.alias("_s")).select("_s.stat", "_s.v")
    found = exact_median(rows, F.col("v"), ["stat"])
    return with_scalars(out, found.agg(*[F.max(F.when(F.col("stat") == n, F.col("median"))).alias(n) for n in values]))


def label_audit(df: DataFrame, by=()) -> DataFrame:
    """Labels that the visible evidence does not support, and tourniquets by label. Needs y, tq, stump_px, wound_px, visible_fraction."""
    amp, wound = F.col("y") == AMPUTATION, F.col("y") == WOUND
    counts = df.groupBy(*by).agg(count_if(amp).alias("amp_n"), count_if(amp & (F.col("stump_px") == 0)).alias("amp_zero_stump"), count_if(wound).alias("wound_n"),
                                 count_if(wound & (F.col("wound_px") == 0)).alias("wound_zero_px"),
                                 *[count_if(F.col("tq") & (F.col("y") == i)).alias(f"tq_{c}") for i, c in enumerate(CLASSES)])
    med = exact_median(df, F.when(amp & (F.col("stump_px") < STUMP_MIN_PX), F.col("visible_fraction")), by, "small_stump_vf_median").drop("n")
    return counts.join(med, list(by), "left") if by else counts.select("*", med.scalar().alias("small_stump_vf_median"))


def wound_detail(df: DataFrame) -> DataFrame:
    """Missed and false wounds: what was seen and what they were called. Needs y, pred, raw, raw_true."""
    y, p, seen, true = F.col("y"), F.col("pred"), F.col("raw.wound_px"), F.col("raw_true.wound_px")
    miss, false = (y == WOUND) & (p != WOUND), (y != WOUND) & (p == WOUND)
    out = df.agg(
        count_if(miss).alias("missed"), count_if(miss & (seen == 0)).alias("missed_px_0"), count_if(miss & (seen > 0) & (seen < WOUND_MIN_PX)).alias("missed_px_1_19"),
        count_if(miss & (seen >= WOUND_MIN_PX)).alias("missed_px_ge20"),
        *[count_if(miss & (p == i)).alias(f"called_{c}") for i, c in enumerate(CLASSES) if i != WOUND],
        count_if(false).alias("false"), count_if(false & (true == 0)).alias("false_true_px_0"), count_if(false & (F.col("raw.tq_px") > 0)).alias("false_with_tq"),
        count_if(false & (y == AMPUTATION)).alias("false_true_amp"))
    return _medians(out, df, {"missed_true_px_median": F.when(miss, true), "false_pred_px_median": F.when(false, seen)})


def amputation_detail(df: DataFrame) -> DataFrame:
    """Missed and false amputations. Needs y, pred, raw, raw_true, visible_fraction."""
    y, p, seen, true = F.col("y"), F.col("pred"), F.col("raw.stump_px"), F.col("raw_true.stump_px")
    miss, false = (y == AMPUTATION) & (p != AMPUTATION), (y != AMPUTATION) & (p == AMPUTATION)
    p_amp = F.coalesce(F.col("raw.p_end")[1], F.lit(0.0))
    end = F.col("raw.end")
    ring = F.aggregate(F.map_values(end), F.lit(0).cast("long"), lambda a, v: a + v)
    blocked = (F.coalesce(end["OCC"], F.lit(0)) + F.coalesce(end["EDGE"], F.lit(0))) / F.greatest(ring, F.lit(1))
    out = df.agg(
        count_if(miss).alias("missed"), count_if(miss & (seen == 0)).alias("missed_px_0"), count_if(miss & (seen > 0) & (p_amp < 0.5)).alias("missed_px_low_p"),
        *[count_if(miss & (p == i)).alias(f"called_{c}") for i, c in enumerate(CLASSES) if i != AMPUTATION],
        count_if(false).alias("false"), count_if(false & (seen > 0)).alias("false_pred_px"), count_if(false & (true > 0)).alias("false_true_px"),
        F.avg(F.when(false, blocked)).alias("false_occ_edge_share"))
    return _medians(out, df, {"missed_ratio_median": F.when(miss, (seen + 1) / (true + 1)), "false_vf_median": F.when(false, F.col("visible_fraction"))})


def raw_disagreement(df: DataFrame, pred: str = "raw", true: str = "raw_true", min_vis: int = 30) -> DataFrame:
    """Where the predicted and true measurements of the same sites part."""
    a, b = F.col(pred), F.col(true)
    ratio = (a["vis_px"] + 1) / (b["vis_px"] + 1)

    def flips(field, cut=0):
        return count_if((a[field] > cut) != (b[field] > cut))

    out = df.agg(F.count(F.lit(1)).alias("n"), share_if((ratio < 0.5) | (ratio > 2)).alias("vis_ratio_outside"),
                 count_if((a["vis_px"] < min_vis) & (b["vis_px"] >= min_vis)).alias("vis_lost"), count_if((b["vis_px"] < min_vis) & (a["vis_px"] >= min_vis)).alias("vis_gained"),
                 flips("stump_px").alias("stump_disagree"), flips("ext_px").alias("ext_disagree"), flips("wound_px", WOUND_MIN_PX - 1).alias("wound_disagree"),
                 count_if(a["p_end"].isNull() & b["p_end"].isNotNull()).alias("p_end_lost"))
    return _medians(out, df, {"vis_ratio_median": ratio})


def population_quartiles(df: DataFrame, stats: dict[str, Column], by=("set",)) -> DataFrame:
    """Quartiles of several statistics per population, stacked into one pass."""
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("stat"), v.cast("double").alias("v")) for n, v in stats.items()]))
    rows = df.select(*by, stacked.alias("_s")).select(*by, "_s.stat", "_s.v")
    return exact_quantiles(rows, F.col("v"), [0.25, 0.5, 0.75], (*by, "stat"))


def population_shares(df: DataFrame, by=("set",), keys=("scene",)) -> DataFrame:
    """Per population: share of images with any wound pixels, median limb size, class mix. Images hold four rows."""
    per = df.groupBy(*by, *keys).agg(F.bool_or(F.col("wound_px") > WOUND_MIN_PX).alias("w"), F.median("vis_px").alias("mv"), F.count(F.lit(1)).alias("k"),
                                     *[count_if(F.col("pred") == i).alias(f"c{i}") for i in range(len(CLASSES))])
    shares = per.groupBy(*by).agg(share_if(F.col("w")).alias("wound_px_share"), *[safe_ratio(F.sum(f"c{i}"), F.sum("k")).alias(f"mix_{c}") for i, c in enumerate(CLASSES)])
    return shares.join(exact_median(per, F.col("mv"), by, "limb_px_median").drop("n"), list(by))


def screening_proxy(df: DataFrame, group: str = "screening", keys=("scene",)) -> DataFrame:
    """Per screening group: wound limbs per photo, all-wound share, not-testable share, any-amputation share."""
    per = df.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("k"), count_if(F.col("pred") == WOUND).alias("w"), count_if(F.col("pred") == NOT_TESTABLE).alias("nt"),
                                       count_if(F.col("pred") == AMPUTATION).alias("am"))
    return per.groupBy(group).agg(F.count(F.lit(1)).alias("photos"), safe_ratio(F.sum("w"), F.count(F.lit(1))).alias("wound_limbs"), share_if(F.col("w") == F.col("k")).alias("all_wound"),
                                  safe_ratio(F.sum("nt"), F.sum("k")).alias("not_testable_share"), share_if(F.col("am") > 0).alias("any_amputation"))


def timing_summary(df: DataFrame, seconds: str = "s", by=(), budget_s: float = 1800) -> DataFrame:
    """Mean, median, p95 and largest time, and how many images a time budget covers."""
    base = df.groupBy(*by).agg(F.count(F.lit(1)).alias("images"), F.avg(seconds).alias("mean"), F.max(seconds).alias("max"))
    quant = exact_quantiles(df, F.col(seconds), [0.5, 0.95], by, ["p50", "p95"]).drop("n")
    out = base.join(quant, list(by)) if by else with_scalars(base, quant, ("p50", "p95"))
    return out.withColumn("capacity", F.lit(float(budget_s)) / F.col("mean"))


def stage_means(rows: DataFrame, first: str = "t", second: str = "t_flip") -> DataFrame:
    """Mean seconds per stage over both passes, from maps stage -> seconds."""
    both = F.transform_values(first, lambda k, v: v + F.coalesce(F.col(second)[k], F.lit(0.0)))
    return rows.select(F.explode(both).alias("stage", "s")).groupBy("stage").agg(F.avg("s").alias("mean"), F.count(F.lit(1)).alias("n"))


def run_summary(df: DataFrame, reason: str = "reason") -> DataFrame:
    """Images predicted and images that fell back, by the kind of reason (text before the colon)."""
    kind = F.coalesce(F.split_part(F.col(reason), F.lit(":"), F.lit(1)), F.lit("predicted"))
    return df.groupBy(kind.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def tag_tally(df: DataFrame, tag: str = "tag", y: str = "y", tags=ERROR_TAGS, need: float = 0.5) -> DataFrame:
    """Counts and shares per tag of tagged errors, by true class, with the rule-candidate flag."""
    aggs = [F.count(F.lit(1)).alias("_n"), F.count(tag).alias("_t")]
    for t in tags:
        here = F.col(tag) == t
        aggs += [count_if(here).alias(f"n_{t}"), count_if(here & (F.col(y) == WOUND)).alias(f"w_{t}"), count_if(here & (F.col(y) == AMPUTATION)).alias(f"a_{t}")]
    def share(t):
        return safe_ratio(F.col(f"n_{t}"), F.greatest(F.col("_t"), F.lit(1)))
    rows = F.array(*[F.struct(F.lit(t).alias("tag"), F.col(f"n_{t}").alias("n"), share(t).alias("share"), (share(t) >= need).alias("candidate"),
                              F.col(f"w_{t}").alias("true_wound"), F.col(f"a_{t}").alias("true_amputation"), (F.col("_n") - F.col("_t")).alias("untagged")) for t in tags])
    return df.agg(*aggs).select(F.explode(rows).alias("_r")).select("_r.*")


def requirement_status(tests: DataFrame, requirements, name: str = "name", outcome: str = "outcome") -> DataFrame:
    """Status per requirement from test names such as test_M3_02_05_case (several ids) or case[M3_02] (one id).

    FAILED if any test failed, OPEN if any was skipped, UNTESTED without tests, else VERIFIED."""
    head = F.regexp_extract(name, r"^test_(M\d+)_(\d\d(?:_\d\d)*)_", 1)
    nums = F.split(F.regexp_extract(name, r"^test_(M\d+)_(\d\d(?:_\d\d)*)_", 2), "_")
    inside = F.regexp_extract(name, r"\[(M\d+)_(\d\d)\]", 0)
    bracket = F.array(F.concat(F.regexp_extract(name, r"\[(M\d+)_(\d\d)\]", 1), F.lit("-"), F.regexp_extract(name, r"\[(M\d+)_(\d\d)\]", 2)))
    ids = F.when(inside != "", bracket).when(head != "", F.array_distinct(F.transform(nums, lambda v: F.concat(head, F.lit("-"), v))))
    per = (tests.select(F.explode(ids).alias("requirement"), outcome).groupBy("requirement")
           .agg(F.count(F.lit(1)).alias("tests"), F.bool_or(F.col(outcome) == "fail").alias("f"), F.bool_or(F.col(outcome) == "skip").alias("s")))
    wanted = tests.sparkSession.createDataFrame([(r,) for r in requirements], "requirement string")
    j = wanted.join(per, "requirement", "left")
    status = F.when(F.col("tests").isNull(), "UNTESTED").when(F.col("f"), "FAILED").when(F.col("s"), "OPEN").otherwise("VERIFIED")
    return j.select("requirement", F.coalesce("tests", F.lit(0)).alias("tests"), status.alias("status"))


def row_shares(cells: DataFrame, truth: str = "truth", n: str = "n") -> DataFrame:
    """Confusion cells with their share of the truth row."""
    return cells.withColumn("row_share", safe_ratio(F.col(n), F.sum(n).over(Window.partitionBy(truth))))


def side_diagnostics(df: DataFrame, min_score: float = 0.3) -> DataFrame:
    """Agreement with the true side by source: keypoint side labels (score above the minimum), foot chirality, facing."""
    hits = F.transform(F.filter("kp_side", lambda h: h["score"] > min_score),
                       lambda h: F.struct(F.lit("keypoint").alias("source"), (h["label"] == h["near"]).alias("ok")))
    foot = F.when(F.col("foot").isNotNull(), F.struct(F.lit("foot").alias("source"), (F.col("foot.chir") == F.col("foot.side")).alias("ok")))
    facing = F.when(F.col("facing").isNotNull(), F.struct(F.lit("facing").alias("source"), (F.col("facing") == F.col("facing_true")).alias("ok")))
    rows = df.select(F.explode(F.concat(hits, F.array_compact(F.array(foot, facing)))).alias("_r")).select("_r.*")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), share_if(F.col("ok")).alias("agreement"))


def focus_vs_other(df: DataFrame, focus: str = "focus", y: str = "y", pred: str = "pred") -> DataFrame:
    """Accuracy, recall and class mix of the site in focus against the rest."""
    yy, pp = F.col(y), F.col(pred)
    return df.groupBy(focus).agg(F.count(F.lit(1)).alias("n"), share_if(yy == pp).alias("acc"), share_if(pp == WOUND, yy == WOUND).alias("recall_wound"),
                                 share_if(pp == AMPUTATION, yy == AMPUTATION).alias("recall_amputation"), *[count_if(yy == i).alias(f"mix_{c}") for i, c in enumerate(CLASSES)])


def validation_summary(df: DataFrame, by=("site",)) -> DataFrame:
    """IoU from summed intersections and unions, median point error, and accuracy of the cause where known."""
    base = df.groupBy(*by).agg(safe_ratio(F.sum("inter"), F.sum("uni")).alias("iou"), share_if(F.col("cause_true") == F.col("cause_pred"), F.col("cause_true").isNotNull()).alias("cause_acc"))
    return base.join(exact_median(df, F.col("err"), by, "point_error_median").drop("n"), list(by), "left")


def file_stats(files: DataFrame, scene: Column) -> DataFrame:
    """Bytes per scene (median, largest) over a file listing with ``length``."""
    per = files.groupBy(scene.alias("scene")).agg(F.sum("length").alias("bytes"))
    base = per.agg(F.count(F.lit(1)).alias("scenes"), F.max("bytes").alias("bytes_max"))
    return base.select("*", exact_median(per, F.col("bytes")).select("median").scalar().alias("bytes_median"))


def constant_accuracy(df: DataFrame, y: str = "y", pred: str = "pred", by=()) -> DataFrame:
    """Accuracy beside that of always answering no_injury."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), share_if(F.col(y) == F.col(pred)).alias("acc"), share_if(F.col(y) == NO_INJURY).alias("always_no_injury"))


def pairs_swapped(df: DataFrame, y: str = "y", pred: str = "pred", keys=("scene",)) -> Column:
    pairs = mirror_pairs(df, [y, pred], keys)
    swap = (F.col(f"l_{y}") != F.col(f"r_{y}")) & (F.col(f"l_{pred}") == F.col(f"r_{y}")) & (F.col(f"r_{pred}") == F.col(f"l_{y}"))
    return pairs.agg(count_if(swap)).scalar()
