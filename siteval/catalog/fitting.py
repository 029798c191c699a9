"""Queries of the fitted operators. Fits are iterative, so most have no SQL twin; exact identities that have one are checked."""

from pyspark.sql import functions as F

from siteval import fixtures as V
from siteval.catalog import query
from siteval.catalog.order import ledger_input
from siteval.constants import C_GRID, FEATURES
from siteval.functions import features as X
from siteval.functions import labels as L
from siteval.functions import probs as P
from siteval.operators import documents as D
from siteval.operators import layer as M
from siteval.operators import sites as O
from siteval.operators import studies as S
from siteval.operators.metrics import cutoff_agreement
from siteval.operators.multifit import GRADIENT, Fit
from siteval.plans import adaptation, batch, scorer
from siteval.runtime import written


def design(spark, sf, limb=False):
    """scene, site, split, grp, y, x of every site. Written once: a fit reads it dozens of times, and folds, weights and scores by parts."""
    return written(O.features(V.raw_sites(spark, sf), "raw", "raw" if limb else None).select("scene", "site", "split", "grp", "position", "facing", "y", "x", "visible_fraction"), "design")


def real_and_source(spark, sf):
    """Evaluation scenes as the newly labelled set, development scenes as the source."""
    d = design(spark, sf)
    return d.filter("split = 'eval'"), d.filter("split = 'dev'")


@query("M2_fit_multinomial")
def _(spark, sf):
    d = design(spark, sf).persist()
    layer = M.fit_layer(d, 0.3)
    d.unpersist()
    return spark.createDataFrame([(c, i, float(w)) for c, row in enumerate(layer.coef) for i, w in enumerate(row)], "class int, feature int, weight double")


@query("M2_fit_balanced")
def _(spark, sf):
    d = design(spark, sf)
    layer = M.fit_layer(d, 0.3, balanced=True)
    return M.accuracy_of(d.withColumn("p", layer.proba(F.col("x"))), by=("y",))


@query("M4_fit_C")
def _(spark, sf):
    C, acc = M.fit_C(M.with_folds(design(spark, sf), "grp"))
    return spark.createDataFrame([(C, acc)], "C double, acc double")


_GRID = "(VALUES " + ", ".join(f"(CAST({C} AS DOUBLE))" for C in C_GRID) + ") AS t(C)"


@query("M4_penalty_path", f"SELECT C, (SELECT count(*) FROM v_sites) AS n, true AS at_optimum, true AS chosen_not_below FROM {_GRID}")
def _(spark, sf):
    """Every penalty holds out each site once, its fits end where the gradient vanishes, and none beats the chosen one."""
    path = M.penalty_path(M.with_folds(design(spark, sf), "grp"))
    top = path[M.best_C(path)]["acc"]
    return spark.createDataFrame([(float(C), r["rows"], r["gradient"] <= GRADIENT, r["acc"] <= top) for C, r in path.items()], "C double, n long, at_optimum boolean, chosen_not_below boolean")


@query("M5_oof_predict")
def _(spark, sf):
    d = design(spark, sf)
    dev = M.with_folds(d.filter("split = 'dev'"), "scene")
    rows, _ = M.oof_predict(dev, 0.1, d.filter("split = 'eval'"))
    return M.accuracy_of(rows, by=("split", "site"))


@query("M6_counterfactual_score")
def _(spark, sf):
    return _scored(spark, sf).metrics()


@query("M6_scorer_ledger")
def _(spark, sf):
    return _scored(spark, sf).ledger.groupBy("split", "severity", "cause").agg(F.count("*").alias("n"))


def _scored(spark, sf):
    rows = ledger_input(spark, sf).select("scene", "site", "split", "y", "raw", "raw_side", "raw_true", "labels", "wound_visible_px", "kp", "position", "visible_fraction")
    return scorer.score_phase(rows, "check", "dev", "eval", limb=True, alt_rules=("0.00", "0.25"))


@query("M6_scorer_coverage", "SELECT split, count(*) AS sites, count(*) FILTER (has_side) AS side, count(*) FILTER (has_true) AS true_map FROM v_raw GROUP BY 1")
def _(spark, sf):
    r = _scored(spark, sf).rows
    return r.groupBy("split").agg(F.count("*").alias("sites"), F.count("pred_side").alias("side"), F.count("pred_true_fixed").alias("true_map"))


@query("M7_swap_refit")
def _(spark, sf):
    d = O.features(O.features(V.raw_sites(spark, sf).filter("has_true"), "raw", out="xp"), "raw_true", out="xt")
    both = M.with_folds(written(d.select("scene", "y", X.swap_group(F.col("xp"), F.col("xt"), (15, 16, 17), 19).alias("x")), "swapped"), "scene")
    C, acc = M.fit_C(both, n=19)
    return spark.createDataFrame([("wound", C, acc)], "group string, C double, acc double")


def _base(source):
    return M.fit_whole(source, 0.03)


@query("M8_arms")
def _(spark, sf):
    real, source = real_and_source(spark, sf)
    src = source.select("x", "y").persist()
    base = _base(src)
    best, scores, _ = M.select_arm(M.with_folds(real, "grp"), base, M.arms(base), source=src)
    src.unpersist()
    return spark.createDataFrame([(n, float(a), n == best) for n, a in scores.items()], "arm string, acc double, picked boolean")


@query("M8_prior_arm", "SELECT y, count(*) AS n, 0 AS answered FROM v_sites WHERE split='eval' GROUP BY 1")
def _(spark, sf):
    real, _ = real_and_source(spark, sf)
    layer = M.prior_layer(real, n=19)
    return real.withColumn("k", P.argmax(layer.proba(F.col("x")))).groupBy("y").agg(F.count("*").alias("n"), F.max("k").alias("answered"))


@query("M9_nested_select")
def _(spark, sf):
    real, source = real_and_source(spark, sf)
    src = source.select("x", "y").persist()
    rows, picks = M.nested_select(real, _base(src), src, by="cost")
    out = M.accuracy_of(rows, by=("fold",))
    src.unpersist()
    return out.withColumn("pick", F.element_at(F.array(*[F.lit(p) for p in picks]), F.col("fold") + 1))


@query("M9_adaptation_report")
def _(spark, sf):
    real, source = real_and_source(spark, sf)
    base = _base(source)
    d = M.with_folds(real, "grp").persist()
    layers = M.cross_validate(d, {"D": Fit(0.1, base=base)})["D"]
    rows = M.predict_by_fold(d, layers)
    return adaptation.report(rows, key="scene")


@query("M14_visible_fraction_regressor")
def _(spark, sf):
    d = M.with_folds(design(spark, sf), "scene")
    return cutoff_agreement(S.visible_fraction_oof(d, "x", "visible_fraction"), "estimate", "visible_fraction", 0.10, by=("split",))


@query("M14_estimates_inside", "SELECT split, count(*) AS n, count(*) AS inside FROM v_sites GROUP BY 1")
def _(spark, sf):
    """Every site of either split has an estimate between 0 and 1: development out of fold, evaluation from all folds."""
    d = design(spark, sf)
    dev = M.with_folds(d.filter("split = 'dev'"), "scene")
    e = S.visible_fraction_oof(dev.unionByName(d.filter("split = 'eval'").withColumn("fold", F.lit(-1))), "x", "visible_fraction")
    return e.groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("estimate").between(0, 1)).alias("inside"))


@query("M14_visible_fraction_arms")
def _(spark, sf):
    d = design(spark, sf).select("scene", "site", "split", "y", "x", "visible_fraction")
    return S.visible_fraction_arms(M.with_folds(d.filter("split = 'dev'"), "scene").drop("split"), d.filter("split = 'eval'").drop("split"), "visible_fraction")


@query("M15_pod_curve")
def _(spark, sf):
    d = V.raw_sites(spark, sf).filter("y = 1")
    return S.pod_curve(d, "scene", F.col("wound_px"), F.col("pred_a") == 1)


@query("M16_domain_auc")
def _(spark, sf):
    e = V.table(spark, sf, "embeddings")
    return S.domain_auc(e.filter("label < 3"), e.filter("label >= 3"), "vec_id", "embedding")


@query("M18_swap_detector")
def _(spark, sf):
    d = written(O.features(V.raw_sites(spark, sf), "raw").select("scene", "site", "y", "x"), "design")
    other = d.select("scene", L.mirror_site(F.col("site")).alias("site"), F.col("x").alias("_m"))
    d = d.join(other, ["scene", "site"]).withColumn("xc", F.when(F.col("scene") % 5 == 0, F.col("_m")).otherwise(F.col("x"))).drop("_m")
    return S.swap_detector(d, "x", "xc", 19)


@query("M19_leave_one_group_out")
def _(spark, sf):
    d = design(spark, sf).select("position", F.col("x"), (F.col("facing") == "F").cast("int").alias("y"))
    return M.accuracy_of(S.leave_one_group_out(d, "position").withColumn("p", F.concat("p", F.array(F.lit(0.0), F.lit(0.0)))), by=("position",))


@query("M20_ablation")
def _(spark, sf):
    d = M.with_folds(design(spark, sf), "scene").select("fold", "y", "x")
    sets = {"all": list(range(19)), "no_ring": [i for i, f in enumerate(FEATURES) if not f.startswith("ring_")], "wound_only": [15, 16, 17]}
    return S.ablation(d, sets)


@query("M21_learning_curve")
def _(spark, sf):
    real, source = real_and_source(spark, sf)
    base = _base(source)
    cands = {"A_synthetic": None, "B_real_C0.1": Fit(0.1), "D_recal_C0.1": Fit(0.1, base=base)}
    return S.learning_curve(real, base, None, sizes=(30, 60), seeds=2, candidates=cands)


@query("M22_experiment_grid")
def _(spark, sf):
    d = design(spark, sf)
    limb = design(spark, sf, limb=True)
    def pair(x):
        return M.with_folds(x.filter("split = 'dev'"), "scene"), x.filter("split = 'eval'")
    return S.experiment_grid({"site": pair(d), "site+limb": pair(limb)})


@query("M23_compare_feature_blocks")
def _(spark, sf):
    rows = V.raw_sites(spark, sf)
    d = O.features(rows, "raw", "raw").select("scene", "tourniquet", "y", F.expr("CASE WHEN visible_fraction < 0.25 THEN 3 ELSE y END").alias("y25"), "x")
    return S.compare_feature_blocks(M.with_folds(written(d, "design"), "scene"), {"base": list(range(19)), "base+limb": list(range(27))}, ["y", "y25"], "tourniquet")


@query("A16_label_cutoff_budget")
def _(spark, sf):
    rows = V.raw_sites(spark, sf)
    def t(c):
        return L.threshold_class(F.col("visible_fraction"), F.col("amputated"), F.col("wound_present"), F.col("wound_px"), F.lit(c))

    d = O.features(rows, "raw").select("scene", "x", t(0.0).alias("y00"), t(0.10).alias("y10"), t(0.25).alias("y25"))
    return S.label_cutoff_budget(M.with_folds(written(d, "design"), "scene"), {"0.00": "y00", "0.10": "y10", "0.25": "y25"})


@query("B_predict_batch", """SELECT image_id, site, y FROM (SELECT scene AS image_id, site, CASE WHEN scene%17=0 THEN 0 WHEN ln(p0)>=greatest(ln(p1)+0.5,ln(p2),ln(p3)-0.25) THEN 0 WHEN ln(p1)+0.5>=greatest(ln(p2),ln(p3)-0.25) THEN 1 WHEN ln(p2)>=ln(p3)-0.25 THEN 2 ELSE 3 END AS y FROM v_sites)""")
def _(spark, sf):
    s = V.sites(spark, sf).select(F.col("scene").alias("image_id"), "site", "p", F.lit(None).cast("string").alias("reason"))
    expected = V.table(spark, sf, "orders").selectExpr("o_orderkey AS image_id")
    docs = batch.predict_batch(expected, s.filter("image_id % 17 <> 0"), bias=(0.0, 0.5, 0.0, -0.25))
    return D.from_predictions(docs).select("image_id", "site", "y")
