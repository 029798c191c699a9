"""Queries of the joins, comparisons, set operations and integrity checks."""

from pyspark.sql import functions as F

from siteval import fixtures as V
from siteval.catalog import query
from siteval.catalog.rows import params
from siteval.constants import CLASSES, COST, PROVENANCE_KEYS
from siteval.functions import probs as P
from siteval.functions.hashing import poisson_steps
from siteval.operators import documents as D
from siteval.operators import groups as G
from siteval.operators import integrity as I
from siteval.operators import metrics as M
from siteval.operators import neighbors as N
from siteval.operators import pairing as J
from siteval.operators import pixels as X
from siteval.operators import sites as O
from siteval.operators.calibration import ensemble

COST_SQL = str([list(r) for r in COST])
_CLS = "['no_injury','wound','amputation','not_testable']"


@query("J4_agree_two_readers", """SELECT pair AS photo, usable_a AND usable_b AS usable,
    CAST(usable_a AND usable_b AND a_l=b_l AS INT) + CAST(usable_a AND usable_b AND a_r<>'unsure' AND a_r=b_r AS INT) AS kept,
    CAST(usable_a AND usable_b AND a_l<>b_l AND b_l<>'unsure' AS INT) + CAST(usable_a AND usable_b AND a_r<>'unsure' AND b_r<>'unsure' AND a_r<>b_r AS INT) AS disagree,
    CAST(usable_a AND usable_b AND a_l<>b_l AND a_l=b_r AND a_r=b_l AS BIGINT) AS swap_only FROM v_readers""")
def _(spark, sf):
    agreed = J.agree_two_readers(V.reader_rows(spark, sf, "a"), V.reader_rows(spark, sf, "b"))
    return J.reader_summary(agreed).select("photo", "usable", F.col("kept").cast("int").alias("kept"), F.col("disagree").cast("int").alias("disagree"), "swap_only")


def _two(spark, sf):
    s = V.sites(spark, sf)
    return s.select("scene", "site", "split", "y", F.col("pred_a").alias("pred")), s.select("scene", "site", F.col("pred_b").alias("pred"))


@query("J5_pair_models", """SELECT split, count(*) FILTER (pred_a<>y AND pred_b=y) AS fixed, count(*) FILTER (pred_a=y AND pred_b<>y) AS broken,
    count(*) FILTER (pred_a=y AND pred_b=y) AS both_right, count(*) FILTER (pred_a<>y AND pred_b<>y) AS both_wrong FROM v_sites GROUP BY 1""")
def _(spark, sf):
    a, b = _two(spark, sf)
    return J.pair_models(a, b, by=("split",)).drop("p")


@query("J5_pair_all_models", """WITH m AS (SELECT scene, site, y, 'm1' AS model, pred_a AS pred FROM v_sites UNION ALL SELECT scene, site, y, 'm2', pred_b FROM v_sites
    UNION ALL SELECT scene, site, y, 'm3', CASE WHEN scene%3=0 THEN pred_a ELSE pred_b END FROM v_sites)
    SELECT a.model AS a, b.model AS b, count(*) FILTER (a.pred<>a.y AND b.pred=b.y) AS fixed, count(*) FILTER (a.pred=a.y AND b.pred<>b.y) AS broken,
    count(*) FILTER (a.pred=a.y AND b.pred=b.y) AS both_right, count(*) FILTER (a.pred<>a.y AND b.pred<>b.y) AS both_wrong
    FROM m a JOIN m b ON a.scene=b.scene AND a.site=b.site AND a.model<b.model GROUP BY ALL""")
def _(spark, sf):
    s = V.sites(spark, sf)
    long = s.selectExpr("scene", "site", "y", "stack(3, 'm1', pred_a, 'm2', pred_b, 'm3', CASE WHEN scene%3=0 THEN pred_a ELSE pred_b END) AS (model, pred)")
    return J.pair_all_models(long, ["m1", "m2", "m3"]).drop("p")


def _ledger(spark, sf, pred):
    return V.sites(spark, sf).select("scene", "site", F.col("y").alias("true"), (F.col("y") == F.col(pred)).alias("correct"))


@query("J5_change_table", """SELECT y AS true, CASE WHEN pred_a<>y AND pred_b=y THEN 'fixed' WHEN pred_a=y AND pred_b<>y THEN 'broke' WHEN pred_b<>y THEN 'still_wrong' ELSE 'still_right' END AS status,
    count(*) AS n FROM v_sites WHERE scene%5<>0 GROUP BY ALL""")
def _(spark, sf):
    return J.change_table(_ledger(spark, sf, "pred_b"), _ledger(spark, sf, "pred_a").filter("scene % 5 <> 0"))


@query("J6_persistent_failures", "SELECT scene, site FROM v_sites WHERE pred_a<>y AND pred_b<>y AND scene%2=0")
def _(spark, sf):
    a, b = _ledger(spark, sf, "pred_a"), _ledger(spark, sf, "pred_b")
    return J.persistent_failures([a, b, a.filter("scene % 2 = 0")])


@query("J7_mirror_pairs", """SELECT a.scene, substr(a.site,2,2) AS limb, a.y AS l_y, b.y AS r_y, a.pred_a AS l_pred, b.pred_a AS r_pred FROM v_sites a JOIN v_sites b
    ON a.scene=b.scene AND a.mk=b.k WHERE a.k%2=1""")
def _(spark, sf):
    return J.mirror_pairs(V.sites(spark, sf).withColumnRenamed("pred_a", "pred"), ["y", "pred"])


@query("J9_average_passes", "SELECT scene, site, (p0+q0)*0.5 AS m0, (p1+q1)*0.5 AS m1, (p2+q2)*0.5 AS m2, (p3+q3)*0.5 AS m3 FROM v_sites WHERE scene%3<>0")
def _(spark, sf):
    s = V.sites(spark, sf)
    out = J.average_passes(s.select("scene", "site", "p"), s.filter("scene % 3 <> 0").select("scene", "site", F.col("q").alias("p")))
    return out.select("scene", "site", *[F.col("p")[i].alias(f"m{i}") for i in range(4)])


@query("J10_missing_outputs", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 13 = 0")
def _(spark, sf):
    o = V.table(spark, sf, "orders").selectExpr("o_orderkey AS id")
    return I.missing_outputs(o, o.filter("id % 13 <> 0"), "id")


@query("J10_extra_outputs", "SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_orderkey % 7 = 0")
def _(spark, sf):
    o = V.table(spark, sf, "orders").selectExpr("o_orderkey AS id").filter("id % 7 <> 0")
    return I.extra_outputs(o, V.table(spark, sf, "lineitem").selectExpr("l_orderkey AS id"), "id")


@query("J11_manifest_diff", """SELECT coalesce(l.name, c.name) AS name, CASE WHEN c.name IS NULL THEN 'missing' WHEN l.name IS NULL THEN 'extra' ELSE 'changed' END AS status
    FROM v_lock l FULL JOIN v_cur c ON l.name=c.name WHERE l.sha IS DISTINCT FROM c.sha""")
def _(spark, sf):
    return I.manifest_diff(V.manifest_lock(spark, sf), V.manifest_current(spark, sf))


@query("J11_manifest_verify", """SELECT count(*) FILTER (c.name IS NULL) AS missing, count(*) FILTER (l.name IS NULL) AS extra, count(*) FILTER (l.sha<>c.sha) AS changed,
    count(*) FILTER (l.sha IS DISTINCT FROM c.sha) = 0 AS ok FROM v_lock l FULL JOIN v_cur c ON l.name=c.name""")
def _(spark, sf):
    return I.manifest_ok(V.manifest_lock(spark, sf), V.manifest_current(spark, sf))


@query("J11_guard_in_scope", """SELECT l.name, 'changed' AS status FROM v_lock l JOIN v_cur c ON l.name=c.name WHERE l.sha<>c.sha AND l.key%2=0""")
def _(spark, sf):
    lock = V.manifest_lock(spark, sf)
    return I.guard_mismatch(lock, V.manifest_current(spark, sf), lock.filter("key % 2 = 0"))


@query("J12_publish_guard", """SELECT p_partkey || CASE p_partkey%4 WHEN 0 THEN '.jpg' WHEN 1 THEN '_part3.png' WHEN 2 THEN '_amodal.png' ELSE '.JPG' END AS name,
    CASE WHEN p_partkey%9=0 THEN 'no generator sidecar' WHEN p_partkey%7=0 THEN 'sidecar unreadable' WHEN p_partkey%5=0 THEN 'not our generator' END AS reason FROM part""")
def _(spark, sf):
    part = V.table(spark, sf, "part")
    images = part.selectExpr("p_partkey || CASE p_partkey%4 WHEN 0 THEN '.jpg' WHEN 1 THEN '_part3.png' WHEN 2 THEN '_amodal.png' ELSE '.JPG' END AS name", "'own' AS dir")
    cars = part.filter("p_partkey % 9 <> 0").selectExpr(
        "CAST(p_partkey AS STRING) AS stem", "CASE WHEN p_partkey%3=0 THEN 'own' ELSE 'd1' END AS dir",
        "CASE WHEN p_partkey%5=0 THEN 'camera' ELSE 'scene4/2' END AS generator", "p_partkey%7<>0 AS readable")
    worse = part.filter("p_partkey % 9 <> 0").selectExpr("CAST(p_partkey AS STRING) AS stem", "'d2' AS dir", "'other' AS generator", "true AS readable")
    return I.publish_guard(images, cars.unionByName(worse), ("d1", "d2"))


@query("J12_guard_verdict", "SELECT count(*) AS images, count(*) FILTER (p_partkey%10=0) AS refused, count(*) > 0 AND count(*) FILTER (p_partkey%10=0) = 0 AS allowed FROM part")
def _(spark, sf):
    part = V.table(spark, sf, "part")
    images = part.selectExpr("p_partkey || '.jpg' AS name", "'own' AS dir")
    cars = part.selectExpr("CAST(p_partkey AS STRING) AS stem", "'own' AS dir", "CASE WHEN p_partkey%10=0 THEN NULL ELSE 'scene3/1' END AS generator", "true AS readable")
    return I.guard_verdict(I.publish_guard(images, cars))


def paired_rows(spark, sf):
    """Site rows of paired scenes: scenes 2i and 2i+1 are members a and b of pair i."""
    s = V.raw_sites(spark, sf)
    return s.selectExpr(
        "scene div 2 AS pair", "concat('P', lpad((scene div 2) % 10 + 1, 2, '0')) AS kind", "CASE WHEN scene%2=0 THEN 'a' ELSE 'b' END AS member", "site", "k",
        "1000 + (scene div 2) % 50 * 10 + CASE WHEN scene % 60 = 0 THEN 100 ELSE 0 END AS full_px", "vis_px AS visible_px", "y AS label", "amputated",
        "CAST(px % 400 AS DOUBLE) / 90000 AS outside_share", "CASE WHEN amputated AND px % 50 = 0 THEN 3 ELSE 0 END AS distal_px", "false AS distal_exists",
        "CASE WHEN px % 40 = 0 THEN 0 ELSE 50 END AS stump_full_px", "CAST(px % 640 AS DOUBLE) AS terminal_x", "CASE WHEN px % 97 = 0 THEN NULL ELSE 5.0D END AS terminal_y",
        "cause", "'body' AS owner", "wound_px", "CASE WHEN px % 33 = 0 THEN 0 ELSE wound_px END AS wound_native_px", "tourniquet", "px % 5 AS tq_native_px")


def paired_scenes(spark, sf):
    keys = ", ".join(f"'{k}'" for k in PROVENANCE_KEYS)
    return V.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS scene", f"CASE WHEN o_orderkey % 29 = 0 THEN array('generator', 'commit') ELSE array({keys}, 'extra') END AS keys")


_PAIR_SQL = """SELECT *, scene//2 AS pair, 'P' || lpad(CAST((scene//2)%10+1 AS VARCHAR),2,'0') AS kind, CASE WHEN scene%2=0 THEN 'a' ELSE 'b' END AS member,
    1000 + (scene//2)%50*10 + CASE WHEN scene%60=0 THEN 100 ELSE 0 END AS full_px FROM v_raw"""


@query("J13_pairwise_scene_checks", f"""WITH r AS ({_PAIR_SQL}) SELECT a.pair, a.site, abs(a.full_px-b.full_px) <= greatest(b.full_px,1)*0.02 AS outline_same, a.vis_px < b.vis_px-20 AS hidden_in_a,
    a.y = m.y AS label_swapped, a.amputated AS a_amputated, m.amputated AS m_amputated FROM r a JOIN r b ON a.pair=b.pair AND a.site=b.site AND a.member='a' AND b.member='b'
    JOIN r m ON m.pair=a.pair AND m.member='b' AND m.k=a.mk""")
def _(spark, sf):
    return I.pairwise_scene_checks(paired_rows(spark, sf))


@query("V2_acceptance_checks", f"""WITH r AS ({_PAIR_SQL}), j AS (SELECT a.pair, a.kind, a.site, abs(a.full_px-b.full_px) <= greatest(b.full_px,1)*0.02 AS same, a.vis_px < b.vis_px-20 AS hid,
    a.y = m.y AS sw, a.amputated AND m.amputated AS amp FROM r a JOIN r b ON a.pair=b.pair AND a.site=b.site AND a.member='a' AND b.member='b' JOIN r m ON m.pair=a.pair AND m.member='b' AND m.k=a.mk),
    p AS (SELECT pair, kind, bool_and(same) AS same, bool_or(hid) AS hid, bool_and(sw) AS sw, bool_or(site='LUE' AND amp) AS amp FROM j GROUP BY ALL),
    c AS (SELECT 'amodal_containment' AS name, count(*) FILTER (CAST(px%400 AS DOUBLE)/90000 > 0.005) AS bad FROM r
    UNION ALL SELECT 'amputation_truth', count(*) FILTER (amputated AND (px%50=0 OR px%40=0)) FROM r
    UNION ALL SELECT 'endpoint_representation', count(*) FILTER (px%97=0) FROM r
    UNION ALL SELECT 'treatment_and_injury_truth', count(*) FILTER ((px%33=0 AND wound_px>5) OR (tourniquet AND px%5=0)) FROM r
    UNION ALL SELECT 'hidden_intact_and_occluder_identity', count(*) FILTER (kind IN ('P03','P04') AND NOT (same AND hid)) FROM p
    UNION ALL SELECT 'laterality', count(*) FILTER (kind='P09' AND NOT (sw AND amp)) FROM p
    UNION ALL SELECT 'provenance', count(*) FILTER (o_orderkey%29=0) FROM orders)
    SELECT name, bad=0 AS "pass", bad FROM c UNION ALL SELECT 'out_of_frame', count(*) FILTER (kind='P10' AND member='b' AND cause='out_of_frame') > 0, 0 FROM r
    UNION ALL SELECT 'performance', true, 0 UNION ALL SELECT 'regression', true, 0""")
def _(spark, sf):
    return I.acceptance_checks(paired_rows(spark, sf), paired_scenes(spark, sf))


@query("V3_provenance_complete", "SELECT o_orderkey%29<>0 AS complete, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    return paired_scenes(spark, sf).select(I.provenance_complete(F.col("keys")).alias("complete")).groupBy("complete").agg(F.count("*").alias("n"))


@query("V4_relabel_diff", """SELECT threshold, site, old, new, count(*) AS n FROM (SELECT '0.10' AS threshold, site, y AS old, CASE WHEN px%6=0 THEN pred_a ELSE y END AS new FROM v_sites
    UNION ALL SELECT '0.50', site, y, CASE WHEN px%4=0 THEN pred_b ELSE y END FROM v_sites) WHERE old<>new GROUP BY ALL""")
def _(spark, sf):
    s = V.sites(spark, sf)
    def labels(a, b):
        r = O.nest_sites(s, F.struct(F.expr(a).alias("a"), F.expr(b).alias("b")), "m")
        return r.select("scene", F.create_map(F.lit("0.10"), F.transform_values("m", lambda _, v: v["a"]), F.lit("0.50"), F.transform_values("m", lambda _, v: v["b"])).alias("labels"))
    return I.relabel_diff(labels("y", "y"), labels("CASE WHEN px%6=0 THEN pred_a ELSE y END", "CASE WHEN px%4=0 THEN pred_b ELSE y END"))


@query("V4_relabel_status", """SELECT CASE WHEN NOT (o_orderkey%3=0 OR o_orderkey%5=0) THEN 'skipped' WHEN o_custkey%11=0 THEN 'mismatch' WHEN o_custkey%2=0 THEN 'relabelled' ELSE 'unchanged' END AS status,
    count(*) AS n FROM orders GROUP BY 1""")
def _(spark, sf):
    return I.relabel_status(V.table(spark, sf, "orders").selectExpr(
        "o_orderkey%3=0 OR o_orderkey%5=0 AS affected", "CASE WHEN o_custkey%11=0 THEN 9 ELSE 0 END AS geometry_px", "o_custkey%2=0 AS changed"))


@query("V6_determinism_check", """SELECT count(*) FILTER (px%50=0) AS only_first, count(*) FILTER (px%50=0) AS only_second, count(*) FILTER (px%50=0) = 0 AS equal FROM v_sites""")
def _(spark, sf):
    s = V.sites(spark, sf)
    return I.determinism_check(s.select("scene", "site", "pred_a"), s.selectExpr("scene", "site", "CASE WHEN px%50=0 THEN pred_a + 10 ELSE pred_a END AS pred_a"))


@query("V7_source_hash", """SELECT CAST(sum(files) AS BIGINT) AS files, sha256(string_agg(h, '' ORDER BY b)) AS sha256 FROM (SELECT substr(h,1,4) AS b, count(*) AS files, sha256(string_agg(h, '' ORDER BY h)) AS h FROM (SELECT sha256(name || ' ' || sha) AS h FROM v_lock) GROUP BY 1)""")
def _(spark, sf):
    return I.source_hash(V.manifest_lock(spark, sf))


@query("J14_compare_runs", """SELECT *, class_agree >= 0.97 AND differ <= sites * 0.05 AS ok FROM (SELECT count(*) AS sites, count(*) FILTER (d > 2 OR e > 0.02) AS differ, CAST(count(*) FILTER (pred_a=pred_b) AS DOUBLE)/count(*) AS class_agree, max(m) AS max_dprob,
    CAST(count(*) FILTER (scene%50<>0) AS DOUBLE)/count(*) AS facing_agree FROM (SELECT *, greatest(abs(r_vis-t_vis), abs(r_wound-t_wound), abs(r_stump-t_stump)) AS d,
    CASE WHEN r_vis>=30 AND t_vis>=30 THEN greatest(abs(p0/(p0+p2+p3)-q0/(q0+q2+q3)), abs(p2/(p0+p2+p3)-q2/(q0+q2+q3)), abs(p3/(p0+p2+p3)-q3/(q0+q2+q3))) ELSE 0.0 END AS e, greatest(abs(p0-q0),abs(p1-q1),abs(p2-q2),abs(p3-q3)) AS m FROM v_raw))""")
def _(spark, sf):
    s = V.raw_sites(spark, sf)
    px = ["vis_px", "wound_px", "stump_px"]
    ref = s.select("scene", "site", "raw.vis_px", "raw.wound_px", "raw.stump_px", "p", "raw.p_end", "facing")
    var = s.select("scene", "site", "vis_px", "wound_px", "stump_px", F.col("q").alias("p"), F.expr("CASE WHEN vis_px >= 30 THEN array(q0/(q0+q2+q3), q2/(q0+q2+q3), q3/(q0+q2+q3)) END").alias("p_end"),
                   F.expr("CASE WHEN scene%50=0 THEN NULL ELSE facing END").alias("facing"))
    return J.compare_runs(ref, var, px)


@query("J15_nearest_neighbor", """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id, round(max(c), 6) AS best FROM (
    SELECT a.vec_id, list_cosine_similarity(a.v, b.v) AS c FROM e a JOIN e b ON a.label < 3 AND b.label >= 3) GROUP BY 1""")
def _(spark, sf):
    e = V.table(spark, sf, "embeddings")
    return N.nearest_neighbor(e.filter("label < 3"), e.filter("label >= 3"), "vec_id", "embedding").withColumn("best", F.round("best", 6))


@query("J15_neighbor_medians", """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), m AS (SELECT 'source_to_target' AS pair, a.vec_id, max(list_cosine_similarity(a.v,b.v)) AS best
    FROM e a JOIN e b ON a.label<3 AND b.label>=3 GROUP BY ALL UNION ALL SELECT 'target_to_target', a.vec_id, max(list_cosine_similarity(a.v,b.v)) FROM e a JOIN e b ON a.label>=3 AND b.label>=3 AND a.vec_id<>b.vec_id GROUP BY ALL)
    SELECT pair, count(*) AS n, round(median(best), 6) AS median FROM m GROUP BY 1""")
def _(spark, sf):
    e = V.table(spark, sf, "embeddings")
    return N.neighbor_medians(e.filter("label < 3"), e.filter("label >= 3"), "vec_id", "embedding").withColumn("median", F.round("median", 6))


@query("J17_overlap_swaps", """WITH s AS (SELECT scene//40 AS scene, gt%4 AS g, pred%4 AS p FROM v_pix), k AS (SELECT scene, g AS site, count(*) AS true_px FROM s GROUP BY ALL),
    m AS (SELECT scene, p AS site, count(*) AS pred_px, count(*) FILTER (p=g) AS own_px, count(*) FILTER (p = CASE WHEN g%2=0 THEN g+1 ELSE g-1 END) AS opp_px FROM s GROUP BY ALL)
    SELECT scene, site, own_px, opp_px, opp_px>own_px AS swap FROM k JOIN m USING (scene, site) WHERE true_px>=30 AND pred_px>=30""")
def _(spark, sf):
    px = V.pixels(spark, sf).selectExpr("scene div 40 AS scene", "gt % 4 AS g", "pred % 4 AS p")
    return X.stump_overlap_swaps(px, "p", "g").select("scene", "site", "own_px", "opp_px", "swap")


@query("J18_same_casualty_baseline", """SELECT a.site, count(*) AS n, CAST(count(*) FILTER (a.y=a.pred_a) AS DOUBLE)/count(*) AS closeup_acc, CAST(count(*) FILTER (b.y=b.pred_b) AS DOUBLE)/count(b.y) AS base_acc
    FROM v_sites a LEFT JOIN (SELECT * FROM v_sites WHERE scene%3=0) b ON b.scene=a.scene-1 AND b.site=a.site GROUP BY 1""")
def _(spark, sf):
    s = V.sites(spark, sf)
    close = s.select("site", "y", F.col("pred_a").alias("pred"), (F.col("scene") - 1).alias("base_scene"))
    base = _ledger(spark, sf, "pred_b").filter("scene % 3 = 0").select(F.col("scene").alias("base_scene"), "site", "correct")
    j = close.join(base, ["base_scene", "site"], "left")
    return j.groupBy("site").agg(F.count("*").alias("n"), M.share_if(F.col("y") == F.col("pred")).alias("closeup_acc"), M.share_if(F.col("correct"), F.col("correct").isNotNull()).alias("base_acc"))


def documents(spark, sf, pred):
    return D.to_predictions(V.sites(spark, sf).withColumnRenamed("scene", "image_id"), pred=pred)


@query("J19_evaluate_documents", """SELECT count(*) AS n, CAST(count(*) FILTER (y=pred_a) AS DOUBLE)/count(*) AS acc, (SELECT count(*) FROM orders WHERE o_orderkey%6=0) AS missing_images FROM v_sites WHERE scene%6<>0""")
def _(spark, sf):
    return D.evaluate_documents(documents(spark, sf, "pred_a").filter("image_id % 6 <> 0"), documents(spark, sf, "y")).select("n", "acc", "missing_images")


_BELOW = "[" + ", ".join(f"CAST({v!r} AS DOUBLE)" for v in poisson_steps()) + "]"
_INTERVALS = f"""WITH s AS (SELECT cust, y, pred_a AS p, count(*) AS n FROM v_sites WHERE scene%6<>0 GROUP BY ALL),
    w AS (SELECT cust, b, len(list_filter({_BELOW}, lambda v: v <= CAST('0x' || substr(md5('0|' || b || '|g|' || cust),1,13) AS UBIGINT) / 4503599627370496.0)) AS w FROM (SELECT DISTINCT cust FROM s) CROSS JOIN range(0,200) AS t(b)),
    r AS (SELECT b, y, p, CAST(sum(n*w) AS BIGINT) AS n FROM s JOIN w USING (cust) GROUP BY ALL),
    c AS (SELECT b, c, coalesce(sum(n) FILTER (y=c),0) AS s, coalesce(sum(n) FILTER (p=c),0) AS m, coalesce(sum(n) FILTER (y=c AND p=c),0) AS t FROM r CROSS JOIN range(0,4) AS k(c) GROUP BY ALL),
    f AS (SELECT b, avg(CASE WHEN s>0 THEN 2.0::DOUBLE*t/(s+m) END) AS f1 FROM c GROUP BY 1),
    a AS (SELECT b, CAST(sum(n) FILTER (y=p) AS DOUBLE)/sum(n) AS acc, CAST(sum(n * {COST_SQL}[y+1][p+1]) AS DOUBLE)/sum(n) AS cost FROM r GROUP BY 1),
    m AS (SELECT unnest(['acc','macro_f1','cost']) AS metric, unnest([acc, f1, cost]) AS v FROM a JOIN f USING (b))
    SELECT metric, round(quantile_cont(v, 0.025), 9) AS lo, round(quantile_cont(v, 0.975), 9) AS hi FROM m GROUP BY 1"""


@query("J19_document_intervals", _INTERVALS)
def _(spark, sf):
    groups = V.table(spark, sf, "orders").selectExpr("o_orderkey AS image_id", "o_custkey AS grp")
    r = D.evaluate_documents(documents(spark, sf, "pred_a").filter("image_id % 6 <> 0"), documents(spark, sf, "y"), groups=groups, replicates=200)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.round(f"{m}_lo", 9).alias("lo"), F.round(f"{m}_hi", 9).alias("hi")) for m in ("acc", "macro_f1", "cost")]))
    return r.select(each.alias("_e")).select("_e.*")


@query("J20_score_document", f"""SELECT subset, count(*) AS n, CAST(count(*) FILTER (y=pred_a) AS DOUBLE)/count(*) AS acc, CAST(count(*) FILTER (y=0) AS DOUBLE)/count(*) AS always_no_injury FROM (
    SELECT y, pred_a, unnest(['all', CASE WHEN NOT ((o_custkey%3<>1) AND (o_orderkey%4=0)) THEN 'clothed' ELSE 'unclothed' END]) AS subset FROM v_sites JOIN orders ON o_orderkey=scene) GROUP BY 1""")
def _(spark, sf):
    labels = O.nest_sites(V.sites(spark, sf), F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.col("y") + 1), "m")
    both = F.create_map(F.lit("0.10"), F.col("m"))
    cars = params(spark, sf).join(labels, "scene").select(F.col("scene").alias("image_id"), "params", both.alias("labels_by_threshold"), both.alias("labels_wound_if_present"))
    return D.score_document(documents(spark, sf, "pred_a"), cars, "0.10")


@query("J21_drift", """SELECT coalesce(l.p_name, c.p_name) AS name, CASE WHEN c.p_name IS NULL THEN 'missing' WHEN l.p_name IS NULL THEN 'extra' ELSE 'changed' END AS status
    FROM (SELECT p_name || p_partkey AS p_name, p_brand FROM part) l FULL JOIN (SELECT p_name || CASE WHEN p_partkey%31=0 THEN p_partkey+1000000 ELSE p_partkey END AS p_name,
    CASE WHEN p_size=7 THEN 'x' ELSE p_brand END AS p_brand FROM part) c ON l.p_name=c.p_name WHERE l.p_brand IS DISTINCT FROM c.p_brand""")
def _(spark, sf):
    part = V.table(spark, sf, "part")
    left = part.selectExpr("p_name || p_partkey AS name", "sha2(p_brand, 256) AS sha")
    right = part.selectExpr("p_name || CASE WHEN p_partkey%31=0 THEN p_partkey+1000000 ELSE p_partkey END AS name", "sha2(CASE WHEN p_size=7 THEN 'x' ELSE p_brand END, 256) AS sha")
    return I.manifest_diff(left, right)


@query("U1_split_leakage", """SELECT cust AS grp FROM v_sites WHERE split='dev' INTERSECT SELECT cust FROM v_sites WHERE split='eval'""")
def _(spark, sf):
    s = V.sites(spark, sf)
    return I.split_leakage(s.filter("split='dev'"), s.filter("split='eval'"), "grp")


@query("U2_set_diff", """SELECT name, sha FROM v_lock EXCEPT SELECT name, sha FROM v_cur""")
def _(spark, sf):
    return V.manifest_lock(spark, sf).select("name", "sha").exceptAll(V.manifest_current(spark, sf).select("name", "sha"))


@query("U4_common_keys", "SELECT o_orderkey AS scene FROM orders WHERE o_orderkey%2=0 AND o_orderkey%3=0")
def _(spark, sf):
    o = V.table(spark, sf, "orders").selectExpr("o_orderkey AS scene")
    return o.filter("scene % 2 = 0").intersect(o.filter("scene % 3 = 0"))


@query("U5_case_duplicates", """SELECT lower(name) AS key, count(*) AS n, count(DISTINCT name) AS spellings FROM (SELECT CASE WHEN p_partkey%2=0 THEN p_name ELSE upper(p_name) END || (p_partkey//3) AS name FROM part) GROUP BY 1 HAVING count(*) > 1""")
def _(spark, sf):
    return I.case_duplicates(V.table(spark, sf, "part").selectExpr("CASE WHEN p_partkey%2=0 THEN p_name ELSE upper(p_name) END || (p_partkey div 3) AS name"))


@query("M13_ensemble", "SELECT scene, site, round((3*p0+q0)/4,9) AS e0, round((3*p1+q1)/4,9) AS e1, round((3*p2+q2)/4,9) AS e2, round((3*p3+q3)/4,9) AS e3 FROM v_sites")
def _(spark, sf):
    s = V.sites(spark, sf)
    members = [(s.select("scene", "site", "p"), 3.0), (s.select("scene", "site", F.col("q").alias("p")), 1.0)]
    return ensemble(members).select("scene", "site", *[F.round(F.col("p")[i], 9).alias(f"e{i}") for i in range(4)])


@query("J9_flip_side_fixable", """SELECT count(*) FILTER (pred_a<>y AND side=y) AS side_fixable, count(*) FILTER (pred_a<>y AND side=y AND pred_b=y) AS fixed_by_average FROM (
    SELECT *, CASE WHEN (scene+k)%3=0 THEN y ELSE pred_a END AS side FROM v_sites)""")
def _(spark, sf):
    s = V.sites(spark, sf).selectExpr("y", "pred_a AS pred", "CASE WHEN (scene+k)%3=0 THEN y ELSE pred_a END AS pred_side", "pred_b AS pred_mean")
    return J.side_fixable(s)


def signatures(spark, sf):
    return G.signature64(V.table(spark, sf, "documents"), "doc_id", "text")


SIG_SQL = """sig AS (SELECT d.doc_id, coalesce(s.hi, 0) AS hi, coalesce(s.lo, 0) AS lo FROM documents d LEFT JOIN (SELECT doc_id,
      CAST(sum(CASE WHEN h=0 AND s>0 THEN (1::BIGINT << b) ELSE 0 END) AS BIGINT) AS hi, CAST(sum(CASE WHEN h=1 AND s>0 THEN (1::BIGINT << b) ELSE 0 END) AS BIGINT) AS lo
      FROM (SELECT doc_id, h, b, sum(CASE WHEN (w >> b) & 1 = 1 THEN n ELSE -n END) AS s FROM (
        SELECT doc_id, n, h.h, ('0x' || substr(m, 1+8*h.h, 8))::BIGINT AS w FROM (SELECT doc_id, t, md5(t) AS m, count(*) AS n FROM (
          SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+')) AS t FROM documents) WHERE t <> '' GROUP BY ALL) CROSS JOIN (VALUES (0),(1)) AS h(h))
        CROSS JOIN range(0,32) AS r(b) GROUP BY ALL) GROUP BY 1) s USING (doc_id))"""


@query("G7_signature64", f"WITH {SIG_SQL} SELECT doc_id, hi, lo FROM sig")
def _(spark, sf):
    s = signatures(spark, sf)
    return s.select("doc_id", F.shiftrightunsigned("sig", 32).alias("hi"), F.col("sig").bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo"))


@query("J16_hamming_pairs", f"""WITH {SIG_SQL}, u AS (SELECT DISTINCT hi, lo FROM sig), v AS (SELECT hi, lo, CASE WHEN hi >= 2147483648 THEN hi - 4294967296 ELSE hi END AS s FROM u)
    SELECT CASE WHEN (a.s, a.lo) < (b.s, b.lo) THEN a.hi ELSE b.hi END AS hi_a, CASE WHEN (a.s, a.lo) < (b.s, b.lo) THEN a.lo ELSE b.lo END AS lo_a,
    CASE WHEN (a.s, a.lo) < (b.s, b.lo) THEN b.hi ELSE a.hi END AS hi_b, CASE WHEN (a.s, a.lo) < (b.s, b.lo) THEN b.lo ELSE a.lo END AS lo_b,
    CAST(bit_count(xor(a.hi,b.hi)) + bit_count(xor(a.lo,b.lo)) AS INT) AS distance FROM v a JOIN v b ON (a.s, a.lo) < (b.s, b.lo) WHERE bit_count(xor(a.hi,b.hi)) + bit_count(xor(a.lo,b.lo)) <= 10""")
def _(spark, sf):
    low = F.lit(0xFFFFFFFF)
    d = G.hamming_pairs(signatures(spark, sf), 10)
    return d.select(F.shiftrightunsigned("sig_a", 32).alias("hi_a"), F.col("sig_a").bitwiseAND(low).alias("lo_a"), F.shiftrightunsigned("sig_b", 32).alias("hi_b"), F.col("sig_b").bitwiseAND(low).alias("lo_b"), "distance")


@query("G3_near_duplicate_groups", f"""WITH RECURSIVE {SIG_SQL}, u AS (SELECT hi, lo, min(doc_id) AS id FROM sig GROUP BY ALL),
    e AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON bit_count(xor(a.hi,b.hi)) + bit_count(xor(a.lo,b.lo)) <= 10),
    r AS (SELECT id AS node, id AS root FROM u UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node), c AS (SELECT node, min(root) AS root FROM r GROUP BY 1)
    SELECT s.doc_id, c.root AS grp FROM sig s JOIN u USING (hi, lo) JOIN c ON c.node = u.id""")
def _(spark, sf):
    s = signatures(spark, sf)
    g = G.near_duplicate_groups(s, "doc_id", d=10)
    name = g.groupBy("grp").agg(F.min("doc_id").alias("first"))
    return g.join(name, "grp").select("doc_id", F.col("first").alias("grp"))


@query("P_argmax_check", "SELECT pred_a AS k, count(*) AS n FROM v_sites GROUP BY 1")
def _(spark, sf):
    return V.sites(spark, sf).select(P.argmax(F.col("p")).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
