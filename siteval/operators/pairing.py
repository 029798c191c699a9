"""Comparisons between the two sides of a scene, between models, and between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteval.constants import AMPUTATION, CLASSES
from siteval.functions import probs as P
from siteval.functions.labels import mirror_site
from siteval.functions.stats import safe_ratio, sign_p
from siteval.operators.metrics import count_if, share_if
from siteval.operators.quantiles import exact_quantiles, with_scalars
from siteval.runtime import total


def mirror_pairs(df: DataFrame, columns, keys=("scene",), site: str = "site") -> DataFrame:
    """One row per (scene, limb) with every column of the left (``l_``) and right (``r_``) site.

    One hash aggregation over at most two rows per key instead of a self-join."""
    left = F.col(site).startswith("L")
    aggs = []
    for c in columns:
        aggs += [F.max(F.when(left, F.col(c))).alias(f"l_{c}"), F.max(F.when(~left, F.col(c))).alias(f"r_{c}")]
    return df.groupBy(*keys, F.substring(site, 2, 2).alias("limb")).agg(*aggs)


def with_mirror(df: DataFrame, columns, keys=("scene",), site: str = "site") -> DataFrame:
    """Site rows with the other side's columns as ``m_`` (NULL when the other side is missing)."""
    pairs = mirror_pairs(df, columns, keys, site)

    def side(a, b):
        return F.struct(F.concat(F.lit(a.upper()), F.col("limb")).alias(site), *[F.col(f"{a}_{c}").alias(c) for c in columns],
                        *[F.col(f"{b}_{c}").alias(f"m_{c}") for c in columns])

    rows = pairs.select(*keys, F.explode(F.array(side("l", "r"), side("r", "l"))).alias("_s")).select(*keys, "_s.*")
    return rows.filter(F.col(columns[0]).isNotNull())


def _exchanged(y1, p1, y2, p2) -> Column:
    return (y1 != y2) & (p1 == y2) & (p2 == y1)


def laterality_swaps(df: DataFrame, y: str = "y", pred: str = "pred", by=(), keys=("scene",)) -> DataFrame:
    """Exactly exchanged pairs, counted as sites and as pairs, and the site rate."""
    pairs = mirror_pairs(df, [y, pred], (*by, *keys))
    swap = _exchanged(F.col(f"l_{y}"), F.col(f"l_{pred}"), F.col(f"r_{y}"), F.col(f"r_{pred}"))
    present = F.col(f"l_{y}").isNotNull().cast("int") + F.col(f"r_{y}").isNotNull().cast("int")
    n = count_if(swap)
    return pairs.groupBy(*by).agg((n * 2).alias("sites"), n.alias("pairs"), safe_ratio(n * 2, F.sum(present)).alias("site_rate"))


def wrong_side_amputations(df: DataFrame, y: str = "y", pred: str = "pred", by=(), keys=("scene",)) -> DataFrame:
    """Amputations called on the wrong side. 'strict' also asks that the amputated side was missed."""
    m = with_mirror(df.select(*by, *keys, "site", y, pred), [y, pred], (*by, *keys))
    loose = (F.col(pred) == AMPUTATION) & (F.col(y) != AMPUTATION) & (F.col(f"m_{y}") == AMPUTATION)
    return m.groupBy(*by).agg(count_if(loose & (F.col(f"m_{pred}") != AMPUTATION)).alias("strict"), count_if(loose).alias("loose"))


def pair_models(a: DataFrame, b: DataFrame, on=("scene", "site"), y: str = "y", pred: str = "pred", by=()) -> DataFrame:
    """Site-by-site comparison of two models: fixed, broken, both right, both wrong and the exact sign test."""
    j = a.select(*on, *by, y, F.col(pred).alias("_a")).join(b.select(*on, F.col(pred).alias("_b")), list(on))
    return _paired(j, F.col("_a") == F.col(y), F.col("_b") == F.col(y), by)


def _paired(df: DataFrame, a_ok: Column, b_ok: Column, by=()) -> DataFrame:
    out = df.groupBy(*by).agg(count_if(~a_ok & b_ok).alias("fixed"), count_if(a_ok & ~b_ok).alias("broken"),
                              count_if(a_ok & b_ok).alias("both_right"), count_if(~a_ok & ~b_ok).alias("both_wrong"))
    return out.withColumn("p", sign_p(F.col("fixed"), F.col("broken")))


def pair_all_models(long: DataFrame, models, on=("scene", "site"), y: str = "y", pred: str = "pred", model: str = "model") -> DataFrame:
    """Every pair of models a < b over the sites both scored. One aggregation to a row per site, one to counts."""
    models = sorted(models)
    ok = F.col(pred) == F.col(y)
    wide = long.groupBy(*on).agg(*[F.max(F.when(F.col(model) == m, ok)).alias(f"ok{i}") for i, m in enumerate(models)])
    cells, aggs = [], []
    for i in range(len(models)):
        for j in range(i + 1, len(models)):
            a, b, t = F.col(f"ok{i}"), F.col(f"ok{j}"), f"{i}_{j}"
            aggs += [count_if(~a & b).alias(f"f{t}"), count_if(a & ~b).alias(f"b{t}"), count_if(a & b).alias(f"r{t}"), count_if(~a & ~b).alias(f"w{t}")]
            cells.append(F.struct(F.lit(models[i]).alias("a"), F.lit(models[j]).alias("b"), F.col(f"f{t}").alias("fixed"), F.col(f"b{t}").alias("broken"),
                                  F.col(f"r{t}").alias("both_right"), F.col(f"w{t}").alias("both_wrong")))
    rows = wide.agg(*aggs).select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")
    return rows.withColumn("p", sign_p(F.col("fixed"), F.col("broken")))


def change_table(current: DataFrame, previous: DataFrame, on=("scene", "site"), by=("true",)) -> DataFrame:
    """fixed / broke / still_wrong / still_right between two ledgers, by true class. Both need ``correct``."""
    j = current.select(*on, *by, F.col("correct").alias("_now")).join(previous.select(*on, F.col("correct").alias("_then")), list(on))
    now, then = F.col("_now"), F.col("_then")
    status = F.when(~then & now, "fixed").when(then & ~now, "broke").when(~now, "still_wrong").otherwise("still_right")
    return j.groupBy(*by, status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def persistent_failures(ledgers: list[DataFrame], on=("scene", "site")) -> DataFrame:
    """Keys wrong in every ledger (a key missing from one does not count). One union and one aggregation."""
    stacked = None
    for i, led in enumerate(ledgers):
        part = led.select(*on, F.col("correct"), F.lit(i).alias("_run"))
        stacked = part if stacked is None else stacked.unionByName(part)
    wrong = [F.coalesce(F.bool_or((F.col("_run") == i) & ~F.col("correct")), F.lit(False)).alias(f"w{i}") for i in range(len(ledgers))]
    flagged = stacked.groupBy(*on).agg(*wrong)
    for i in range(len(ledgers)):
        flagged = flagged.filter(F.col(f"w{i}"))
    return flagged.select(*on)


def average_passes(orig: DataFrame, flip: DataFrame, on=("scene", "site"), p: str = "p") -> DataFrame:
    """Mean of the probabilities of two passes over the keys both have."""
    j = orig.join(flip.select(*on, F.col(p).alias("_q")), list(on))
    return j.withColumn(p, P.mean_probs(F.col(p), F.col("_q"))).drop("_q")


def flip_stability(orig: DataFrame, flip: DataFrame, on=("scene", "site"), y: str = "y", limit: float = 0.05) -> DataFrame:
    """How far probabilities move between an image and its mirror, and what averaging fixes and breaks."""
    j = orig.select(*on, y, "p").join(flip.select(*on, F.col("p").alias("q")), list(on))
    p, q = F.col("p"), F.col("q")
    moved = F.greatest(*[F.abs(p[i] - q[i]) for i in range(4)])
    rows = j.select(F.col(y).alias("y"), moved.alias("d"), P.argmax(p).alias("a"), P.argmax(q).alias("b"), P.argmax(P.mean_probs(p, q)).alias("m"))
    differ, wrong, mean_wrong = F.col("a") != F.col("b"), F.col("a") != F.col("y"), F.col("m") != F.col("y")
    counts = rows.agg(F.count(F.lit(1)).alias("sites"), share_if(F.col("d") > limit).alias("share_over"), share_if(differ).alias("disagreement"),
                      share_if(wrong, differ).alias("error_when_disagree"), share_if(wrong, ~differ).alias("error_when_agree"),
                      count_if(wrong & ~mean_wrong).alias("fixed"), count_if(~wrong & mean_wrong).alias("broken"))
    quant = exact_quantiles(rows, F.col("d"), [0.5, 0.9, 0.99], (), ["p50", "p90", "p99"])
    return with_scalars(counts, quant, ("p50", "p90", "p99"))


def side_fixable(df: DataFrame, y: str = "y", pred: str = "pred", side: str = "pred_side", mean: str = "pred_mean") -> DataFrame:
    """Errors the rendered side would fix, and how many of them averaging fixes."""
    fix = (F.col(pred) != F.col(y)) & (F.col(side) == F.col(y))
    return df.agg(count_if(fix).alias("side_fixable"), count_if(fix & (F.col(mean) == F.col(y))).alias("fixed_by_average"))


def mirror_consistency(orig: DataFrame, mirrored: DataFrame, keys=("scene",), pred: str = "pred") -> DataFrame:
    """Share of sites whose class on the mirrored pass, with sides exchanged, equals the class on the original."""
    m = mirrored.select(*keys, mirror_site(F.col("site")).alias("site"), F.col(pred).alias("_m"))
    j = orig.join(m, [*keys, "site"])
    return j.agg(F.count(F.lit(1)).alias("n"), share_if(F.col(pred) == F.col("_m")).alias("agreement"))


def compare_runs(ref: DataFrame, var: DataFrame, px, on=("scene", "site"), px_tol: float = 2, p_tol: float = 0.02) -> DataFrame:
    """Parity of two extractions: pixel and probability differences, class agreement, and the pass rule
    (agreement >= 0.97 and at most 5% of sites differing). ``p_end`` may be NULL on either side."""
    b = var.select(*on, *[F.col(c).alias(f"_b_{c}") for c in px], F.col("p").alias("_b_p"), F.col("p_end").alias("_b_end"), F.col("facing").alias("_b_facing"))
    j = ref.join(b, list(on))
    dpx = [F.abs(F.col(c) - F.col(f"_b_{c}")) for c in px]
    dpx = F.greatest(*dpx) if len(dpx) > 1 else dpx[0]
    dprob = F.greatest(*[F.abs(F.col("p")[i] - F.col("_b_p")[i]) for i in range(4)])
    dend = F.coalesce(F.greatest(*[F.abs(F.col("p_end")[i] - F.col("_b_end")[i]) for i in range(3)]), F.lit(0.0))
    rows = j.select(dpx.alias("dpx"), dprob.alias("dprob"), dend.alias("dend"), (P.argmax(F.col("p")) == P.argmax(F.col("_b_p"))).alias("same"),
                    F.col("facing").eqNullSafe(F.col("_b_facing")).alias("same_facing"))
    differ = (F.col("dpx") > px_tol) | (F.col("dend") > p_tol)
    out = rows.agg(F.count(F.lit(1)).alias("sites"), count_if(differ).alias("differ"), share_if(F.col("same")).alias("class_agree"),
                   F.max("dprob").alias("max_dprob"), share_if(F.col("same_facing")).alias("facing_agree"))
    return out.withColumn("ok", (F.col("class_agree") >= 0.97) & (F.col("differ") <= F.col("sites") * 0.05))


def agree_two_readers(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row per (photo, site): class kept only where both readers call the photo usable and give the same known class.

    Inputs: photo, usable, site, class. Adds per-photo counts of disagreements and of pairs that are each other's mirror."""
    j = (a.select("photo", "site", F.col("usable").alias("ua"), F.col("class").alias("ca"))
         .join(b.select("photo", "site", F.col("usable").alias("ub"), F.col("class").alias("cb")), ["photo", "site"], "left"))
    usable = F.coalesce(F.col("ua") & F.col("ub"), F.lit(False))
    known = F.col("ca").isin(*CLASSES)
    rows = j.select("photo", "site", usable.alias("usable"), "ca", "cb", F.when(usable & known & (F.col("ca") == F.col("cb")), F.col("ca")).alias("class"),
                    F.coalesce(usable & known & F.col("cb").isin(*CLASSES) & (F.col("ca") != F.col("cb")), F.lit(False)).alias("disagree"))
    return rows


def reader_summary(agreed: DataFrame) -> DataFrame:
    """Per photo: usable, kept sites, disagreeing sites, swap-only pairs."""
    keep = agreed.withColumn("usable_i", F.col("usable").cast("int")).withColumn("kept_i", F.col("class").isNotNull().cast("int")).withColumn("dis_i", F.col("disagree").cast("int"))
    pairs = mirror_pairs(keep, ["ca", "cb", "usable_i", "kept_i", "dis_i"], ("photo",))
    swap = (F.col("l_usable_i") == 1) & (F.col("l_ca") != F.col("l_cb")) & (F.col("l_ca") == F.col("r_cb")) & (F.col("r_ca") == F.col("l_cb"))
    def both(c):
        return F.coalesce(F.col(f"l_{c}"), F.lit(0)) + F.coalesce(F.col(f"r_{c}"), F.lit(0))
    return pairs.groupBy("photo").agg(F.max(F.greatest("l_usable_i", "r_usable_i")).cast("boolean").alias("usable"), F.sum(both("kept_i")).alias("kept"),
                                      F.sum(both("dis_i")).alias("disagree"), count_if(swap).alias("swap_only"))


def vector_distance(a: Column, b: Column, n: int) -> Column:
    return F.sqrt(total([(a[i] - b[i]) * (a[i] - b[i]) for i in range(n)]))
