"""Queries of the aggregations."""

from pyspark.sql import functions as F

from siteval import fixtures as V
from siteval.catalog import query
from siteval.catalog.rows import CONDITION_SQL, with_conditions
from siteval.constants import SITES, STUMP_SIZE_BINS, WOUND_SIZE_BINS
from siteval.functions import labels as L
from siteval.functions import probs as P
from siteval.functions import rules as R
from siteval.functions import stats as S
from siteval.operators import metrics as M
from siteval.operators import pairing as J
from siteval.operators import pixels as X
from siteval.operators import reports as N
from siteval.operators import sites as O
from siteval.operators.quantiles import exact_median, exact_quantiles
from siteval.runtime import lookup

_PAIRS = "(SELECT t.i AS truth, p.i AS pred FROM (VALUES (0),(1),(2),(3)) AS t(i) CROSS JOIN (VALUES (0),(1),(2),(3)) AS p(i))"


@query("A1_confusion", f"""SELECT s.split, c.truth, c.pred, count(*) FILTER (s.y = c.truth AND s.pred_a = c.pred) AS n
    FROM v_sites s CROSS JOIN {_PAIRS} c GROUP BY ALL""")
def _(spark, sf):
    return M.confusion(V.sites(spark, sf), pred="pred_a", by=("split",))


_CLASS_SQL = """SELECT c.i AS class, count(*) FILTER (y = c.i) AS support,
    CAST(count(*) FILTER (y = c.i AND pred_a = c.i) AS DOUBLE) / nullif(count(*) FILTER (pred_a = c.i), 0) AS "precision",
    CAST(count(*) FILTER (y = c.i AND pred_a = c.i) AS DOUBLE) / nullif(count(*) FILTER (y = c.i), 0) AS recall,
    coalesce(CAST(2 * count(*) FILTER (y = c.i AND pred_a = c.i) AS DOUBLE) / nullif(count(*) FILTER (y = c.i) + count(*) FILTER (pred_a = c.i), 0), 0) AS f1
    FROM v_sites CROSS JOIN (VALUES (0),(1),(2),(3)) AS c(i) GROUP BY 1"""


@query("A2_class_metrics", _CLASS_SQL)
def _(spark, sf):
    return M.class_metrics(V.sites(spark, sf), pred="pred_a")


_F1 = "2.0*count(*) FILTER (y={c} AND {p}={c}) / nullif(count(*) FILTER (y={c}) + count(*) FILTER ({p}={c}), 0)"
_R1 = "CAST(count(*) FILTER (y={c} AND {p}={c}) AS DOUBLE) / nullif(count(*) FILTER (y={c}), 0)"


def _score_sql(p, keys, source):
    f1 = ", ".join(_F1.format(c=c, p=p) for c in range(4))
    rec = ", ".join(_R1.format(c=c, p=p) for c in range(4))
    return f"""SELECT {keys}, count(*) AS n, CAST(count(*) FILTER (y={p}) AS DOUBLE)/count(*) AS acc, round(list_avg([{f1}]), 9) AS macro_f1,
      least({rec}) AS min_recall, CAST(count(*) FILTER (y IN (0,2) AND {p}=1) AS DOUBLE)/nullif(count(*) FILTER (y IN (0,2)),0) AS false_wound,
      CAST(count(*) FILTER (y IN (0,1) AND {p}=2) AS DOUBLE)/nullif(count(*) FILTER (y IN (0,1)),0) AS false_amp FROM {source} GROUP BY {keys}"""


@query("A3_score_metrics", _score_sql("pred_a", "split", "v_sites"))
def _(spark, sf):
    return M.score_metrics(V.sites(spark, sf), pred="pred_a", by=("split",)).withColumn("macro_f1", F.round("macro_f1", 9))


_RULE_ROWS = """(SELECT pred_a, r.rule, CASE WHEN NOT (CASE WHEN cut = 0 THEN visible_fraction > 0 ELSE visible_fraction >= cut END) THEN 3
    WHEN amputated THEN CASE WHEN amp = 'any' OR stump_px >= 20 OR cause = 'amputated_visible' THEN 2 ELSE 3 END
    WHEN wound_present AND (wr = 'present' OR wound_px >= 20) THEN 1 ELSE 0 END AS y FROM (SELECT * EXCLUDE (y) FROM v_raw) CROSS JOIN
    (VALUES ('v3_compat',0.10,'visible','any'),('guide_primary',0,'visible','observable'),('guide_wound_present',0,'present','observable'),
            ('guide_amp_any',0,'visible','any')) AS r(rule, cut, wr, amp))"""


@query("A3_score_metrics_by_rule", _score_sql("pred_a", "rule", _RULE_ROWS))
def _(spark, sf):
    rows = O.apply_label_rules(V.raw_sites(spark, sf), keep=("pred_a",))
    return M.score_metrics(rows, pred="pred_a", by=("rule",)).withColumn("macro_f1", F.round("macro_f1", 9))


@query("A4_macro_f1", f"""SELECT site, round(list_avg([{', '.join(_F1.format(c=c, p='pred_b') for c in range(4))}]), 9) AS macro_f1_either,
    round(list_avg([{', '.join('CASE WHEN count(*) FILTER (y=%d) > 0 THEN %s END' % (c, _F1.format(c=c, p='pred_b')) for c in range(4))}]), 9) AS macro_f1_truth
    FROM v_sites WHERE y <> 2 GROUP BY 1""")
def _(spark, sf):
    d = M.macro_f1(V.sites(spark, sf).filter("y <> 2"), pred="pred_b", by=("site",))
    return d.select("site", F.round("macro_f1_either", 9).alias("macro_f1_either"), F.round("macro_f1_support", 9).alias("macro_f1_truth"))


@query("A5_site_accuracy", "SELECT site, count(*) AS n, CAST(count(*) FILTER (y=pred_a) AS DOUBLE)/count(*) AS acc FROM v_sites GROUP BY 1")
def _(spark, sf):
    return M.accuracy(V.sites(spark, sf), ["site"], pred="pred_a")


@query("A5_majority_baseline", """SELECT split, arg_max(y, n*10 - y) AS majority, CAST(max(n) AS DOUBLE)/sum(n) AS majority_acc
    FROM (SELECT split, y, count(*) AS n FROM v_sites GROUP BY ALL) GROUP BY 1""")
def _(spark, sf):
    return M.majority_baseline(V.sites(spark, sf), by=("split",))


_SWAP = "a.y <> b.y AND a.pred_a = b.y AND b.pred_a = a.y"


@query("A6_laterality_swaps", f"""SELECT a.split, count(*) FILTER ({_SWAP}) AS sites, count(*) FILTER ({_SWAP} AND a.k < b.k) AS pairs,
    CAST(count(*) FILTER ({_SWAP}) AS DOUBLE)/count(*) AS site_rate FROM v_sites a JOIN v_sites b ON a.scene=b.scene AND a.mk=b.k GROUP BY 1""")
def _(spark, sf):
    return J.laterality_swaps(V.sites(spark, sf).withColumnRenamed("pred_a", "pred"), by=("split",))


@query("A7_wrong_side_amputations", """SELECT count(*) FILTER (a.pred_a=2 AND a.y<>2 AND b.y=2 AND b.pred_a<>2) AS strict,
    count(*) FILTER (a.pred_a=2 AND a.y<>2 AND b.y=2) AS loose FROM v_sites a JOIN v_sites b ON a.scene=b.scene AND a.mk=b.k""")
def _(spark, sf):
    return J.wrong_side_amputations(V.sites(spark, sf).withColumnRenamed("pred_a", "pred"))


@query("A8_cost_per_site", """SELECT split, count(*) AS n, CAST(sum([[0,3,3,2],[40,0,3,10],[100,40,0,40],[1,3,3,0]][y+1][pred_a+1]) AS DOUBLE)/count(*) AS cost
    FROM v_sites GROUP BY 1""")
def _(spark, sf):
    return M.cost_per_site(V.sites(spark, sf), pred="pred_a", by=("split",))


_BAND = "CASE WHEN visible_fraction < 0.10 THEN '<0.10' WHEN visible_fraction < 0.25 THEN '0.10-0.25' WHEN visible_fraction < 0.5 THEN '0.25-0.50' ELSE '>=0.50' END"


@query("A9_slice_metrics", f"""SELECT slice, value, count(*) AS n, CAST(count(*) FILTER (y=pred_a) AS DOUBLE)/count(*) AS acc,
    CAST(count(*) FILTER (y=1 AND pred_a=1) AS DOUBLE)/nullif(count(*) FILTER (y=1),0) AS recall_wound,
    CAST(count(*) FILTER (y=2 AND pred_a=2) AS DOUBLE)/nullif(count(*) FILTER (y=2),0) AS recall_amputation FROM (
    SELECT y, pred_a, 'position' AS slice, position AS value FROM v_sites UNION ALL SELECT y, pred_a, 'facing', facing FROM v_sites
    UNION ALL SELECT y, pred_a, 'limb', CASE WHEN k<=2 THEN 'upper' ELSE 'lower' END FROM v_sites
    UNION ALL SELECT y, pred_a, 'band', {_BAND} FROM v_sites UNION ALL SELECT y, pred_a, 'tourniquet', CAST(tourniquet AS VARCHAR) FROM v_sites) GROUP BY 1, 2""")
def _(spark, sf):
    slices = {"position": F.col("position"), "facing": F.col("facing"),
              "limb": F.when(L.is_upper(F.col("site")), "upper").otherwise("lower"),
              "band": L.visibility_band(F.col("visible_fraction")), "tourniquet": F.col("tourniquet")}
    return M.slice_metrics(V.sites(spark, sf), slices, pred="pred_a")


@query("A10_condition_rates", f"""SELECT condition, count(*) FILTER (y IN (0,2)) AS n_wound,
    CAST(count(*) FILTER (y IN (0,2) AND pred_a=1) AS DOUBLE)/nullif(count(*) FILTER (y IN (0,2)),0) AS false_wound, count(*) FILTER (y IN (0,1)) AS n_amp,
    CAST(count(*) FILTER (y IN (0,1) AND pred_a=2) AS DOUBLE)/nullif(count(*) FILTER (y IN (0,1)),0) AS false_amp FROM {CONDITION_SQL} GROUP BY 1""")
def _(spark, sf):
    return M.condition_rates(with_conditions(V.sites(spark, sf)), F.col("conditions"), pred="pred_a")


@query("A14_coverage", """SELECT CAST(count(*) FILTER (has_side) AS DOUBLE)/count(*) AS raw_side, CAST(count(*) FILTER (has_true) AS DOUBLE)/count(*) AS raw_true FROM v_raw""")
def _(spark, sf):
    return M.coverage(V.raw_sites(spark, sf), ["raw_side", "raw_true"])


@query("A15_label_counts", f"SELECT rule, y, count(*) AS n FROM {_RULE_ROWS} GROUP BY ALL")
def _(spark, sf):
    return M.label_counts(O.apply_label_rules(V.raw_sites(spark, sf), keep=()), "y", ["rule"])


@query("A16_label_cutoff_counts", """SELECT lpad(CAST(CAST(c AS DECIMAL(4,2)) AS VARCHAR), 4, '0') AS cut, CASE WHEN NOT (CASE WHEN c=0 THEN visible_fraction>0 ELSE visible_fraction>=c END) THEN 3
    WHEN amputated THEN 2 WHEN wound_present AND wound_px>=20 THEN 1 ELSE 0 END AS label, count(*) AS n FROM v_raw CROSS JOIN (VALUES (0.0),(0.10),(0.25),(0.50)) AS t(c) GROUP BY ALL""")
def _(spark, sf):
    rows = O.labels_by_threshold(V.raw_sites(spark, sf), keep=()).select(F.explode("labels").alias("cut", "label"))
    return M.label_counts(rows, "label", ["cut"])


@query("A17_label_audit", """SELECT split, count(*) FILTER (y=2) AS amp_n, count(*) FILTER (y=2 AND t_stump=0) AS amp_zero_stump, count(*) FILTER (y=1) AS wound_n,
    count(*) FILTER (y=1 AND t_wound=0) AS wound_zero_px, count(*) FILTER (tourniquet AND y=0) AS tq_no_injury, count(*) FILTER (tourniquet AND y=1) AS tq_wound,
    count(*) FILTER (tourniquet AND y=2) AS tq_amputation, count(*) FILTER (tourniquet AND y=3) AS tq_not_testable,
    round(median(visible_fraction) FILTER (y=2 AND t_stump<20), 9) AS small_stump_vf_median FROM v_raw GROUP BY 1""")
def _(spark, sf):
    d = V.raw_sites(spark, sf).withColumnRenamed("tourniquet", "tq")
    return N.label_audit(d, by=("split",)).withColumn("small_stump_vf_median", F.round("small_stump_vf_median", 9))


@query("A18_crosstab", """SELECT y, CASE WHEN r_wound > 0 THEN 'W' ELSE '-' END || CASE WHEN tq_px > 0 THEN 'T' ELSE '-' END AS feature, count(*) AS n FROM v_raw GROUP BY ALL""")
def _(spark, sf):
    r = F.col("raw")
    tag = F.concat(F.when(r["wound_px"] > 0, "W").otherwise("-"), F.when(r["tq_px"] > 0, "T").otherwise("-"))
    return M.crosstab(V.raw_sites(spark, sf), "y", tag)


@query("A19_threshold_stability", """SELECT unstable, count(*) AS n, CAST(count(*) FILTER (y=pred_a) AS DOUBLE)/count(*) AS acc FROM (
    SELECT y, pred_a, len(list_distinct([l0,l1,l2])) > 1 AS unstable FROM (SELECT *, CASE WHEN NOT visible_fraction>0 THEN 3 ELSE l END AS l0,
      CASE WHEN visible_fraction<0.10 THEN 3 ELSE l END AS l1, CASE WHEN visible_fraction<0.25 THEN 3 ELSE l END AS l2 FROM (
      SELECT *, CASE WHEN amputated THEN 2 WHEN wound_present AND wound_px>=20 THEN 1 ELSE 0 END AS l FROM v_sites))) GROUP BY 1""")
def _(spark, sf):
    d = O.labels_by_threshold(V.sites(spark, sf), cuts=(0.0, 0.10, 0.25), keep=("y", "pred_a"))
    return M.accuracy(d.withColumn("unstable", F.size(F.array_distinct(F.map_values("labels"))) > 1), ["unstable"], pred="pred_a")


@query("A20_wound_detail", """SELECT count(*) FILTER (m) AS missed, count(*) FILTER (m AND r_wound=0) AS missed_px_0, count(*) FILTER (m AND r_wound>0 AND r_wound<20) AS missed_px_1_19,
    count(*) FILTER (m AND r_wound>=20) AS missed_px_ge20, median(t_wound) FILTER (m) AS missed_true_px_median, count(*) FILTER (m AND pred_a=0) AS called_no_injury,
    count(*) FILTER (m AND pred_a=2) AS called_amputation, count(*) FILTER (m AND pred_a=3) AS called_not_testable, count(*) FILTER (f) AS "false",
    count(*) FILTER (f AND t_wound=0) AS false_true_px_0, median(r_wound) FILTER (f) AS false_pred_px_median, count(*) FILTER (f AND tq_px>0) AS false_with_tq,
    count(*) FILTER (f AND y=2) AS false_true_amp FROM (SELECT *, y=1 AND pred_a<>1 AS m, y<>1 AND pred_a=1 AS f FROM v_raw)""")
def _(spark, sf):
    return N.wound_detail(V.raw_sites(spark, sf).withColumnRenamed("pred_a", "pred").withColumn("raw_true", _truth_px()))


def _truth_px():
    """The true measurements for every row, whether or not the true-map extraction is present."""
    return F.struct(F.col("wound_px"), F.col("stump_px"), F.col("vis_px"))


@query("A20_amputation_detail", """SELECT count(*) FILTER (m) AS missed, count(*) FILTER (m AND r_stump=0) AS missed_px_0,
    count(*) FILTER (m AND r_stump>0 AND coalesce(CASE WHEN r_vis>=30 THEN p2/psum END, 0)<0.5) AS missed_px_low_p, round(median((r_stump+1.0)/(t_stump+1)) FILTER (m), 9) AS missed_ratio_median,
    count(*) FILTER (m AND pred_a=0) AS called_no_injury, count(*) FILTER (m AND pred_a=1) AS called_wound, count(*) FILTER (m AND pred_a=3) AS called_not_testable,
    count(*) FILTER (f) AS "false", count(*) FILTER (f AND r_stump>0) AS false_pred_px, count(*) FILTER (f AND t_stump>0) AS false_true_px,
    round(median(visible_fraction) FILTER (f), 9) AS false_vf_median,
    round(avg(CAST(e_occ+e_edge AS DOUBLE)/greatest(e_bg+e_occ+e_torso+e_other+e_edge,1)) FILTER (f), 6) AS false_occ_edge_share
    FROM (SELECT *, y=2 AND pred_a<>2 AS m, y<>2 AND pred_a=2 AS f FROM v_raw)""")
def _(spark, sf):
    d = N.amputation_detail(V.raw_sites(spark, sf).withColumnRenamed("pred_a", "pred").withColumn("raw_true", _truth_px()))
    return d.withColumns({"missed_ratio_median": F.round("missed_ratio_median", 9), "false_vf_median": F.round("false_vf_median", 9),
                          "false_occ_edge_share": F.round("false_occ_edge_share", 6)})


def _bins_sql(col, bins, c):
    arms = " ".join(f"WHEN {col}>={a} AND {col}<{b} THEN '{a}-{b}'" for a, b in bins)
    return f"SELECT CASE {arms} END AS bin, count(*) AS n, CAST(count(*) FILTER (pred_a={c}) AS DOUBLE)/count(*) AS recall FROM v_raw WHERE y={c} GROUP BY 1"


@query("A21_binned_recall_wound", _bins_sql("wound_px", WOUND_SIZE_BINS, 1))
def _(spark, sf):
    return M.binned_recall(V.raw_sites(spark, sf), F.col("wound_px"), WOUND_SIZE_BINS, 1, pred="pred_a")


@query("A21_binned_recall_amputation", _bins_sql("stump_px", STUMP_SIZE_BINS, 2))
def _(spark, sf):
    return M.binned_recall(V.raw_sites(spark, sf), F.col("stump_px"), STUMP_SIZE_BINS, 2, pred="pred_a")


@query("A22_raw_disagreement", """SELECT count(*) AS n, round(median((r_vis+1.0)/(t_vis+1)), 9) AS vis_ratio_median,
    CAST(count(*) FILTER ((r_vis+1.0)/(t_vis+1) < 0.5 OR (r_vis+1.0)/(t_vis+1) > 2) AS DOUBLE)/count(*) AS vis_ratio_outside,
    count(*) FILTER (r_vis<30 AND t_vis>=30) AS vis_lost, count(*) FILTER (t_vis<30 AND r_vis>=30) AS vis_gained, count(*) FILTER ((r_stump>0)<>(t_stump>0)) AS stump_disagree,
    0::BIGINT AS ext_disagree, count(*) FILTER ((r_wound>=20)<>(t_wound>=20)) AS wound_disagree, count(*) FILTER (r_vis<30 AND t_vis>=30) AS p_end_lost
    FROM v_raw WHERE has_true""")
def _(spark, sf):
    d = N.raw_disagreement(V.raw_sites(spark, sf).filter("has_true"))
    return d.withColumn("vis_ratio_median", F.round("vis_ratio_median", 9))


@query("A25_flip_stability", """SELECT count(*) AS sites, CAST(count(*) FILTER (d > 0.05) AS DOUBLE)/count(*) AS share_over,
    round(quantile_cont(d, 0.5), 9) AS p50, round(quantile_cont(d, 0.9), 9) AS p90, round(quantile_cont(d, 0.99), 9) AS p99,
    CAST(count(*) FILTER (pred_a<>pred_b) AS DOUBLE)/count(*) AS disagreement, CAST(count(*) FILTER (pred_a<>pred_b AND pred_a<>y) AS DOUBLE)/nullif(count(*) FILTER (pred_a<>pred_b),0) AS error_when_disagree,
    CAST(count(*) FILTER (pred_a=pred_b AND pred_a<>y) AS DOUBLE)/nullif(count(*) FILTER (pred_a=pred_b),0) AS error_when_agree,
    count(*) FILTER (pred_a<>y AND m=y) AS fixed, count(*) FILTER (pred_a=y AND m<>y) AS broken FROM (SELECT *,
    greatest(abs(p0-q0),abs(p1-q1),abs(p2-q2),abs(p3-q3)) AS d, CASE WHEN (p0+q0)*0.5>=greatest((p1+q1)*0.5,(p2+q2)*0.5,(p3+q3)*0.5) THEN 0
    WHEN (p1+q1)*0.5>=greatest((p2+q2)*0.5,(p3+q3)*0.5) THEN 1 WHEN (p2+q2)*0.5>=(p3+q3)*0.5 THEN 2 ELSE 3 END AS m FROM v_sites)""")
def _(spark, sf):
    rows = V.sites(spark, sf)
    d = J.flip_stability(rows.select("scene", "site", "y", "p"), rows.select("scene", "site", F.col("q").alias("p")))
    return d.withColumns({c: F.round(c, 9) for c in ("p50", "p90", "p99")})


@query("A23_population_stats", """SELECT "set", stat, round(quantile_cont(v,0.25),6) AS q250, round(quantile_cont(v,0.5),6) AS q500, round(quantile_cont(v,0.75),6) AS q750, count(*) AS n FROM (
    SELECT facing AS "set", unnest(['confidence','entropy','vis_px','visible_fraction']) AS stat,
    unnest([greatest(p0,p1,p2,p3), -(p0*ln(p0+1e-9)+p1*ln(p1+1e-9)+p2*ln(p2+1e-9)+p3*ln(p3+1e-9)), CAST(vis_px AS DOUBLE), visible_fraction]) AS v FROM v_sites) GROUP BY ALL""")
def _(spark, sf):
    p = F.col("p")
    stats = {"confidence": P.confidence(p), "entropy": P.entropy(p), "vis_px": F.col("vis_px").cast("double"), "visible_fraction": F.col("visible_fraction")}
    d = N.population_quartiles(V.sites(spark, sf).withColumnRenamed("facing", "set"), stats, by=("set",))
    return d.withColumns({c: F.round(c, 6) for c in ("q250", "q500", "q750")})


@query("A23_population_shares", """SELECT facing AS "set", CAST(count(*) FILTER (w) AS DOUBLE)/count(*) AS wound_px_share, round(median(mv),6) AS limb_px_median,
    CAST(sum(c0) AS DOUBLE)/sum(4) AS mix_no_injury, CAST(sum(c1) AS DOUBLE)/sum(4) AS mix_wound, CAST(sum(c2) AS DOUBLE)/sum(4) AS mix_amputation, CAST(sum(c3) AS DOUBLE)/sum(4) AS mix_not_testable
    FROM (SELECT scene, facing, bool_or(wound_px_pred>20) AS w, median(vis_px) AS mv, count(*) FILTER (pred_a=0) AS c0, count(*) FILTER (pred_a=1) AS c1,
    count(*) FILTER (pred_a=2) AS c2, count(*) FILTER (pred_a=3) AS c3 FROM v_sites GROUP BY ALL) GROUP BY 1""")
def _(spark, sf):
    rows = V.sites(spark, sf).select("scene", F.col("facing").alias("set"), F.col("pred_a").alias("pred"), "vis_px", F.col("wound_px_pred").alias("wound_px"))
    return N.population_shares(rows, by=("set",)).withColumn("limb_px_median", F.round("limb_px_median", 6))


@query("A24_screening_proxy", """SELECT position AS screening, count(*) AS photos, CAST(sum(w) AS DOUBLE)/count(*) AS wound_limbs, CAST(count(*) FILTER (w=4) AS DOUBLE)/count(*) AS all_wound,
    CAST(sum(nt) AS DOUBLE)/sum(c) AS not_testable_share, CAST(count(*) FILTER (am>0) AS DOUBLE)/count(*) AS any_amputation FROM (SELECT scene, position, count(*) AS c,
    count(*) FILTER (pred_a=1) AS w, count(*) FILTER (pred_a=3) AS nt, count(*) FILTER (pred_a=2) AS am FROM v_sites GROUP BY ALL) GROUP BY 1""")
def _(spark, sf):
    return N.screening_proxy(V.sites(spark, sf).select("scene", F.col("position").alias("screening"), F.col("pred_a").alias("pred")))


@query("A26_pixel_iou", """SELECT g.c AS class, g.n AS gt_px, coalesce(i.n,0) AS inter, g.n + p.n - coalesce(i.n,0) AS "union", CAST(coalesce(i.n,0) AS DOUBLE)/(g.n+p.n-coalesce(i.n,0)) AS iou
    FROM (SELECT gt AS c, count(*) AS n FROM v_pix GROUP BY 1) g JOIN (SELECT pred AS c, count(*) AS n FROM v_pix GROUP BY 1) p USING (c)
    LEFT JOIN (SELECT gt AS c, count(*) AS n FROM v_pix WHERE gt=pred GROUP BY 1) i USING (c)""")
def _(spark, sf):
    return X.pixel_iou(V.pixels(spark, sf))


@query("A26_top_confusions", "SELECT gt, pred, count(*) AS n FROM v_pix WHERE gt<>pred GROUP BY ALL ORDER BY n DESC, gt, pred LIMIT 12")
def _(spark, sf):
    return X.top_confusions(V.pixels(spark, sf), 12)


@query("A26_mean_iou", """SELECT round(avg(CAST(i AS DOUBLE)/(g+p-i)), 9) AS miou, count(*) AS classes FROM (SELECT c, sum(g) AS g, sum(p) AS p, sum(i) AS i FROM (
    SELECT gt AS c, 1 AS g, 0 AS p, CAST(gt=pred AS INT) AS i FROM v_pix UNION ALL SELECT pred, 0, 1, 0 FROM v_pix) GROUP BY 1 HAVING sum(g) > 0)""")
def _(spark, sf):
    return X.mean_iou(V.pixels(spark, sf)).withColumn("miou", F.round("miou", 9))


@query("A27_mask_iou", """SELECT bit, count(*) AS entities, round(median(iou),9) AS iou_median, CAST(count(*) FILTER (iou>=0.7) AS DOUBLE)/count(*) AS share_good FROM (
    SELECT scene, bit, CAST(count(*) FILTER (g AND p) AS DOUBLE)/nullif(count(*) FILTER (g OR p),0) AS iou FROM (SELECT scene, gt%4 AS bit, gt<12 AS g, pred<13 AS p FROM v_pix) GROUP BY ALL)
    WHERE iou IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    d = V.pixels(spark, sf).select("scene", (F.col("gt") % 4).alias("bit"), (F.col("gt") < 12).alias("g"), (F.col("pred") < 13).alias("p"))
    return X.mask_iou(d, "g", "p", entity=("scene",), by=("bit",)).withColumn("iou_median", F.round("iou_median", 9))


@query("A28_bitmask_containment", """SELECT site, CAST(max(o) AS DOUBLE) AS worst, count(*) FILTER (o > 0.005) AS scenes_over, max(o) <= 0.005 AS ok FROM (SELECT scene, site,
    CAST(count(*) FILTER ((owner & b)=0) AS DOUBLE)/count(*) AS o FROM v_pix JOIN (VALUES ('LUE',1,0),('RUE',2,1),('LLE',4,2),('RLE',8,3)) AS s(site,b,i) ON v_pix.gt % 4 = i WHERE visible GROUP BY ALL) GROUP BY 1""")
def _(spark, sf):
    d = V.pixels(spark, sf).filter("visible").withColumn("site", F.element_at(F.array(*[F.lit(s) for s in SITES]), (F.col("gt") % 4 + 1).cast("int")))
    bit = F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4), F.lit(8)), (F.col("gt") % 4 + 1).cast("int"))
    return X.bitmask_containment(d.withColumn("bit", bit), "owner", "bit")


@query("A29_timing_summary", """SELECT stage, count(*) AS images, round(avg(s),6) AS mean, round(quantile_cont(s,0.5),6) AS p50, round(quantile_cont(s,0.95),6) AS p95, max(s) AS max,
    round(1800/avg(s),4) AS capacity FROM v_times GROUP BY 1""")
def _(spark, sf):
    d = N.timing_summary(V.run_times(spark, sf), by=("stage",), budget_s=1800)
    return d.select("stage", "images", F.round("mean", 6).alias("mean"), F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "max", F.round("capacity", 4).alias("capacity"))


@query("A30_run_summary", """SELECT coalesce(split_part(reason,':',1),'predicted') AS outcome, count(*) AS n FROM v_times GROUP BY 1""")
def _(spark, sf):
    return N.run_summary(V.run_times(spark, sf))


@query("A31_aux_metrics", """SELECT CAST(count(*) FILTER (ht>=0 AND h=ht) AS DOUBLE)/nullif(count(*) FILTER (ht>=0),0) AS head_end_accuracy,
    CAST(count(*) FILTER (ft>=0 AND f=ft) AS DOUBLE)/nullif(count(*) FILTER (ft>=0),0) AS facing_accuracy, round(avg(abs(v-vt)) FILTER (vt>=0),6) AS visibility_mae,
    CAST(count(*) FILTER (vt>=0 AND (v>=0.1)=(vt>=0.1)) AS DOUBLE)/nullif(count(*) FILTER (vt>=0),0) AS visibility_threshold_accuracy FROM (
    SELECT px%2 AS h, CASE WHEN px%5=0 THEN -1 ELSE (px+k)%2 END AS ht, px%3 AS f, CASE WHEN px%7=0 THEN NULL ELSE scene%3 END AS ft, p0 AS v, CASE WHEN px%9=0 THEN -1 ELSE visible_fraction END AS vt FROM v_sites)""")
def _(spark, sf):
    d = V.sites(spark, sf).selectExpr("px%2 AS h", "CASE WHEN px%5=0 THEN -1 ELSE (px+k)%2 END AS ht", "px%3 AS f", "CASE WHEN px%7=0 THEN NULL ELSE scene%3 END AS ft",
                                      "p0 AS v", "CASE WHEN px%9=0 THEN -1 ELSE visible_fraction END AS vt")
    return M.aux_metrics(d, {"head_end": ("h", "ht"), "facing": ("f", "ft")}, "v", "vt").withColumn("visibility_mae", F.round("visibility_mae", 6))


_TAGS = "(SELECT y, CASE px % 6 WHEN 0 THEN NULL WHEN 1 THEN 'S1' WHEN 2 THEN 'S2' WHEN 3 THEN 'S3' WHEN 4 THEN 'S3' ELSE 'S4' END AS tag FROM v_sites WHERE y <> pred_a)"


@query("A32_tag_tally", f"""SELECT t.tag, count(*) FILTER (s.tag = t.tag) AS n, CAST(count(*) FILTER (s.tag=t.tag) AS DOUBLE)/greatest(count(s.tag),1) AS share,
    CAST(count(*) FILTER (s.tag=t.tag) AS DOUBLE)/greatest(count(s.tag),1) >= 0.5 AS candidate, count(*) FILTER (s.tag=t.tag AND y=1) AS true_wound, count(*) FILTER (s.tag=t.tag AND y=2) AS true_amputation,
    count(*) - count(s.tag) AS untagged FROM {_TAGS} s CROSS JOIN (VALUES ('S1'),('S2'),('S3'),('S4')) AS t(tag) GROUP BY 1""")
def _(spark, sf):
    d = V.sites(spark, sf).filter("y <> pred_a").selectExpr("y", "CASE px % 6 WHEN 0 THEN NULL WHEN 1 THEN 'S1' WHEN 2 THEN 'S2' WHEN 3 THEN 'S3' WHEN 4 THEN 'S3' ELSE 'S4' END AS tag")
    return N.tag_tally(d)


@query("A33_trace_matrix", """WITH t AS (SELECT 'M' || (o_custkey%3+1) || '-' || lpad(CAST(o_custkey%20 AS VARCHAR),2,'0') AS id, o_orderstatus AS st FROM orders
    UNION ALL SELECT 'M' || (o_custkey%3+1) || '-' || lpad(CAST((o_custkey+7)%20 AS VARCHAR),2,'0'), o_orderstatus FROM orders WHERE o_custkey%4=0 AND o_custkey%20 <> (o_custkey+7)%20),
    r AS (SELECT 'M' || m.i || '-' || lpad(CAST(k.j AS VARCHAR),2,'0') AS requirement FROM (VALUES (1),(2),(3),(4)) AS m(i) CROSS JOIN range(0,20) AS k(j))
    SELECT requirement, count(t.id) AS tests, CASE WHEN count(t.id)=0 THEN 'UNTESTED' WHEN bool_or(st='F') THEN 'FAILED' WHEN bool_or(st='P') THEN 'OPEN' ELSE 'VERIFIED' END AS status
    FROM r LEFT JOIN t ON t.id = requirement GROUP BY 1""")
def _(spark, sf):
    m = "concat('test_M', o_custkey%3+1, '_', lpad(o_custkey%20, 2, '0'), CASE WHEN o_custkey%4=0 THEN concat('_', lpad((o_custkey+7)%20, 2, '0')) ELSE '' END, '_case')"
    tests = V.table(spark, sf, "orders").selectExpr(f"{m} AS name", "CASE o_orderstatus WHEN 'F' THEN 'fail' WHEN 'P' THEN 'skip' ELSE 'pass' END AS outcome")
    wanted = [f"M{i}-{j:02d}" for i in (1, 2, 3, 4) for j in range(20)]
    return N.requirement_status(tests, wanted)


@query("A34_three_class_summary", """SELECT truth, pred, n, CAST(n AS DOUBLE)/sum(n) OVER (PARTITION BY truth) AS row_share FROM (SELECT t.i AS truth, p.i AS pred,
    count(*) FILTER (y3=t.i AND p3c=p.i) AS n FROM (SELECT [0,-1,1,2][y+1] AS y3, CASE WHEN r_vis<30 THEN 2 WHEN bg>=0.60 AND lfrac<0.75 THEN 1 WHEN lfrac>=0.10 THEN 0 ELSE 2 END AS p3c FROM v_raw WHERE y<>1)
    CROSS JOIN (VALUES (0),(1),(2)) AS t(i) CROSS JOIN (VALUES (0),(1),(2)) AS p(i) GROUP BY ALL)""")
def _(spark, sf):
    r = F.col("raw")
    three = {0: 0, 2: 1, 3: 2}
    d = V.raw_sites(spark, sf).filter("y <> 1").select(
        lookup(F.col("y"), three).alias("y"), lookup(R.rule_area(r["vis_px"], r["bg_frac"], r["Lfrac"]), three).alias("pred"))
    return N.row_shares(M.confusion(d, k=3))


@query("A35_errors_by_stage", """SELECT stage, count(*) AS n FROM (SELECT CASE WHEN (a.scene + a.k) % 4 = 0 THEN 'laterality_swap' WHEN (a.y=3) <> (a.pred_a=3) THEN 'visibility' ELSE 'state' END AS stage
    FROM v_sites a WHERE a.y <> a.pred_a) GROUP BY 1""")
def _(spark, sf):
    d = V.sites(spark, sf).select(M.stage_of_error(F.col("y"), F.col("pred_a"), F.expr("(scene + k) % 4 = 0")).alias("stage"))
    return d.filter("stage IS NOT NULL").groupBy("stage").agg(F.count("*").alias("n"))


@query("A37_class_weights", """SELECT c AS class, round(w/(sum(w) OVER ()/4), 9) AS weight FROM (SELECT c, sqrt((SELECT count(*)+4 FROM v_sites)/(n+1)) AS w FROM (
    SELECT y AS c, CAST(count(*) AS DOUBLE) AS n FROM v_sites GROUP BY 1))""")
def _(spark, sf):
    return M.class_weights(V.sites(spark, sf)).withColumn("weight", F.round("weight", 9))


@query("A38_side_diagnostics", """SELECT source, count(*) AS n, CAST(count(*) FILTER (ok) AS DOUBLE)/count(*) AS agreement FROM (
    SELECT 'keypoint' AS source, lab=near AS ok FROM (SELECT px%2+1 AS lab, (px+k)%2+1 AS near, p0 AS s FROM v_sites) WHERE s > 0.3
    UNION ALL SELECT 'foot', CASE WHEN px%3=0 THEN 1 ELSE -1 END = CASE WHEN k%2=1 THEN 1 ELSE -1 END FROM v_sites WHERE k>2 AND px%5<>0
    UNION ALL SELECT 'facing', (px%2=0) = (scene%2=0) FROM v_sites WHERE k=1 AND px%7<>0) GROUP BY 1""")
def _(spark, sf):
    d = V.sites(spark, sf)
    return N.side_diagnostics(d.select(
        F.array(F.struct(F.expr("px%2+1").alias("label"), F.expr("(px+k)%2+1").alias("near"), F.col("p0").alias("score"))).alias("kp_side"),
        F.expr("CASE WHEN k>2 AND px%5<>0 THEN struct(CASE WHEN px%3=0 THEN 1 ELSE -1 END AS chir, CASE WHEN k%2=1 THEN 1 ELSE -1 END AS side) END").alias("foot"),
        F.expr("CASE WHEN k=1 AND px%7<>0 THEN CASE WHEN px%2=0 THEN 1 ELSE -1 END END").alias("facing"),
        F.expr("CASE WHEN scene%2=0 THEN 1 ELSE -1 END").alias("facing_true")))


@query("A39_mirror_consistency", """SELECT count(*) AS n, CAST(count(*) FILTER (a.pred_a=b.pred_b) AS DOUBLE)/count(*) AS agreement FROM v_sites a JOIN v_sites b ON a.scene=b.scene AND a.mk=b.k""")
def _(spark, sf):
    d = V.sites(spark, sf)
    return J.mirror_consistency(d.select("scene", "site", F.col("pred_a").alias("pred")), d.select("scene", "site", F.col("pred_b").alias("pred")))


@query("A40_cutoff_agreement", """SELECT split, count(*) AS n, CAST(count(*) FILTER ((p0>=0.1)=(visible_fraction>=0.1)) AS DOUBLE)/count(*) AS agreement, round(avg(abs(p0-visible_fraction)),6) AS mae FROM v_sites GROUP BY 1""")
def _(spark, sf):
    return M.cutoff_agreement(V.sites(spark, sf), "p0", "visible_fraction", 0.10, by=("split",)).withColumn("mae", F.round("mae", 6))


@query("A41_focus_vs_other", """SELECT k = scene%4+1 AS focus, count(*) AS n, CAST(count(*) FILTER (y=pred_a) AS DOUBLE)/count(*) AS acc, CAST(count(*) FILTER (y=1 AND pred_a=1) AS DOUBLE)/nullif(count(*) FILTER (y=1),0) AS recall_wound,
    CAST(count(*) FILTER (y=2 AND pred_a=2) AS DOUBLE)/nullif(count(*) FILTER (y=2),0) AS recall_amputation, count(*) FILTER (y=0) AS mix_no_injury, count(*) FILTER (y=1) AS mix_wound,
    count(*) FILTER (y=2) AS mix_amputation, count(*) FILTER (y=3) AS mix_not_testable FROM v_sites GROUP BY 1""")
def _(spark, sf):
    d = V.sites(spark, sf).withColumn("focus", F.expr("k = scene % 4 + 1")).withColumnRenamed("pred_a", "pred")
    return N.focus_vs_other(d)


@query("A42_validation_summary", """SELECT site, CAST(sum(CASE WHEN px%5>1 THEN vis_px ELSE 0 END) AS DOUBLE)/sum(vis_px+ext) AS iou, round(median(e) FILTER (px%3<>0), 9) AS point_error_median,
    CAST(count(*) FILTER (px%4<>0 AND y=pred_a) AS DOUBLE)/count(*) FILTER (px%4<>0) AS cause_acc FROM (SELECT *, px%200 AS ext, sqrt((px%30)*(px%30)+(px%17)*(px%17)) AS e FROM v_sites) GROUP BY 1""")
def _(spark, sf):
    d = V.sites(spark, sf).selectExpr("site", "CASE WHEN px%5>1 THEN vis_px ELSE 0 END AS inter", "vis_px + px%200 AS uni", "CASE WHEN px%3<>0 THEN sqrt((px%30)*(px%30)+(px%17)*(px%17)) END AS err",
                                      "CASE WHEN px%4<>0 THEN y END AS cause_true", "pred_a AS cause_pred")
    return N.validation_summary(d).withColumn("point_error_median", F.round("point_error_median", 9))


@query("F17_wilson_by_position", """SELECT position, n, round((p+z*z/(2*n))/(1+z*z/n) - z*sqrt(p*(1-p)/n+z*z/(4.0*n*n))/(1+z*z/n), 9) AS lo,
    round((p+z*z/(2*n))/(1+z*z/n) + z*sqrt(p*(1-p)/n+z*z/(4.0*n*n))/(1+z*z/n), 9) AS hi FROM (SELECT position, CAST(count(*) AS DOUBLE) AS nd, count(*) AS n,
    CAST(count(*) FILTER (y=pred_a) AS DOUBLE)/count(*) AS p, CAST(1.96 AS DOUBLE) AS z FROM v_sites GROUP BY 1)""")
def _(spark, sf):
    d = M.accuracy(V.sites(spark, sf), ["position"], pred="pred_a")
    lo, hi = S.wilson(F.col("acc"), F.col("n"))
    return d.select("position", "n", F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


@query("Q_exact_quantiles", """SELECT split, count(*) AS n, round(quantile_cont(p0,0.025),9) AS q025, round(quantile_cont(p0,0.5),9) AS q500, round(quantile_cont(p0,0.975),9) AS q975 FROM v_sites GROUP BY 1""")
def _(spark, sf):
    d = exact_quantiles(V.sites(spark, sf), F.col("p0"), [0.025, 0.5, 0.975], ["split"])
    return d.select("split", "n", *[F.round(c, 9).alias(c) for c in ("q025", "q500", "q975")])


@query("Q_exact_median_all", "SELECT count(*) AS n, median(vis_px) AS median FROM v_sites")
def _(spark, sf):
    return exact_median(V.sites(spark, sf), F.col("vis_px"))
