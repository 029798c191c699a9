"""Queries of ordering, ranking, folds, resampling and the failure ledger."""

from pyspark.sql import functions as F

from siteval import fixtures as V
from siteval.catalog import query
from siteval.constants import FEATURES
from siteval.functions import probs as P
from siteval.functions import text as T
from siteval.functions.rules import lying_score
from siteval.functions.hashing import crc_split, key_text, sha_split
from siteval.operators import groups as G
from siteval.operators import ledger as L
from siteval.operators import ordering as W
from siteval.operators import resampling as B
from siteval.operators import sites as O
from siteval.operators.layer import pool

_U = "(CAST('0x' || substr(md5({x}),1,13) AS UBIGINT) / 4503599627370496.0)"
_SORTED = "list_sort([{{'n': -p0, 'c': 0}}, {{'n': -p1, 'c': 1}}, {{'n': -p2, 'c': 2}}, {{'n': -p3, 'c': 3}}])".replace("{{", "{").replace("}}", "}")


@query("W1_margin", f"SELECT scene, site, s[2].n - s[1].n AS margin FROM (SELECT *, {_SORTED} AS s FROM v_sites)")
def _(spark, sf):
    return V.sites(spark, sf).select("scene", "site", P.margin(F.col("p")).alias("margin"))


@query("W2_runner_up", f"SELECT y, CASE WHEN margin < 0.2 THEN 'near' WHEN margin < 0.5 THEN 'mid' ELSE 'clear' END AS band, second, count(*) AS n FROM (SELECT y, s[2].n - s[1].n AS margin, s[2].c AS second FROM (SELECT *, {_SORTED} AS s FROM v_sites)) GROUP BY ALL")
def _(spark, sf):
    m = P.margin(F.col("p"))
    d = V.sites(spark, sf).select("y", F.when(m < 0.2, "near").when(m < 0.5, "mid").otherwise("clear").alias("band"), P.runner_up(F.col("p")).alias("second"))
    return d.groupBy("y", "band", "second").agg(F.count("*").alias("n"))


_F_SQL = """[ln(1+{v}_vis), lfrac, coalesce(bg,-1), CASE WHEN {v}_vis>=30 THEN p0/psum ELSE 0 END, CASE WHEN {v}_vis>=30 THEN p2/psum ELSE 0 END, CASE WHEN {v}_vis>=30 THEN p3/psum ELSE 0 END,
    ln(1+ext_px), ln(1+{v}_stump), CAST(e_bg AS DOUBLE)/tot, CAST(e_occ AS DOUBLE)/tot, CAST(e_torso AS DOUBLE)/tot, CAST(e_other AS DOUBLE)/tot, CAST(e_edge AS DOUBLE)/tot,
    {v}_vis/(torso*torso), CAST({v}_vis>=30 AS DOUBLE), CASE WHEN {v}_vis>=30 THEN p1 ELSE 0 END, ln(1+{v}_wound), CAST({v}_wound AS DOUBLE)/greatest({v}_vis,1), ln(1+tq_px)]"""
_FEATS = f"(SELECT *, {_F_SQL.format(v='r')} AS fr, {_F_SQL.format(v='t')} AS ft FROM (SELECT *, greatest(e_bg+e_occ+e_torso+e_other+e_edge,1) AS tot FROM v_raw))"


@query("W3_feature_delta_top3", f"""WITH f AS {_FEATS}, s AS (SELECT i, stddev_pop(fr[i]) + 1e-6 AS sd FROM f CROSS JOIN range(1,20) AS r(i) WHERE split='dev' GROUP BY 1),
    z AS (SELECT scene, site, i, (fr[i]-ft[i])/sd AS z FROM f JOIN s ON true WHERE has_true)
    SELECT scene, site, round(max(abs(z)) ,6) AS top_z, CAST(count(*) FILTER (abs(z) > 1e-12) AS BIGINT) AS moved FROM z GROUP BY ALL""")
def _(spark, sf):
    d = O.features(O.features(V.raw_sites(spark, sf), "raw", out="xp"), "raw_true", out="xt")
    sd = d.filter("split = 'dev'").agg(F.array(*[F.stddev_pop(F.col("xp")[i]) + 1e-6 for i in range(19)])).scalar()
    out = W.feature_deltas(d.filter("has_true"), "xp", "xt", FEATURES, sd, 19)
    top = F.col("feature_delta_top3")
    moved = F.aggregate(top, F.lit(0).cast("long"), lambda a, s: a + (F.abs(s["z"]) > 1e-12).cast("long"))
    return out.select("scene", "site", F.round(F.abs(top[0]["z"]), 6).alias("top_z"), moved.alias("moved"))


@query("W4_id_window_groups", """SELECT id, CASE WHEN count(*) FILTER (b) OVER () < 20 THEN id ELSE max(CASE WHEN b THEN id END) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) END AS grp, count(*) FILTER (b) OVER () < 20 AS dropped
    FROM (SELECT id, coalesce(id - lag(id) OVER (ORDER BY id) > 100, true) AS b FROM (SELECT event_id*7 + (event_id//40)*200 AS id FROM events))""")
def _(spark, sf):
    ids = V.table(spark, sf, "events").selectExpr("event_id*7 + (event_id div 40)*200 AS id")
    return W.id_window_groups(ids, "id")


@query("W4_id_window_dropped", """SELECT p_partkey AS id, p_partkey AS grp, true AS dropped FROM part""")
def _(spark, sf):
    return W.id_window_groups(V.table(spark, sf, "part").selectExpr("p_partkey AS id"), "id")


@query("W5_last_per_key", """SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1""")
def _(spark, sf):
    return W.last_per_key(V.table(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id"], ["event_id"])


@query("W7_quantile_bins", """WITH e AS (SELECT [min(wound_px), quantile_cont(wound_px,0.25), quantile_cont(wound_px,0.5), quantile_cont(wound_px,0.75), max(wound_px)] AS e FROM v_sites WHERE y=1)
    SELECT CAST(i AS INT) AS bin, count(*) AS n, CAST(count(*) FILTER (pred_a=1) AS DOUBLE)/count(*) AS recall FROM v_sites CROSS JOIN e CROSS JOIN range(0,4) AS r(i) WHERE y=1 AND wound_px >= e[i+1] AND wound_px <= e[i+2] GROUP BY 1""")
def _(spark, sf):
    d = W.quantile_bins(V.sites(spark, sf).filter("y = 1"), F.col("wound_px"))
    return d.groupBy("bin").agg(F.count("*").alias("n"), (F.count_if(F.col("pred_a") == 1) / F.count("*")).alias("recall"))


_AUC = """SELECT {by} CAST(sum(np) AS BIGINT) AS positives, CAST(sum(nn) AS BIGINT) AS negatives, round(CAST(sum(np*(2*below+nn)) AS DOUBLE)/(2.0*sum(np)*sum(nn)),9) AS auc FROM (
    SELECT *, coalesce(sum(nn) OVER ({part} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS below FROM (SELECT {by} s, count(*) FILTER (pos) AS np, count(*) FILTER (NOT pos) AS nn FROM ({src}) GROUP BY ALL)) {group}"""


@query("W8_auc", _AUC.format(by="", part="", src="SELECT p1 AS s, y=1 AS pos FROM v_sites", group=""))
def _(spark, sf):
    return W.auc(V.sites(spark, sf), F.col("y") == 1, F.col("p1")).withColumn("auc", F.round("auc", 9))


@query("W8_ovr_auc", _AUC.format(by="class,", part="PARTITION BY class", src=" UNION ALL ".join(f"SELECT {c} AS class, q{c} AS s, y={c} AS pos FROM v_sites" for c in range(4)), group="GROUP BY class"))
def _(spark, sf):
    return W.ovr_auc(V.sites(spark, sf), "y", "q").withColumn("auc", F.round("auc", 9))


@query("W9_every_nth", """SELECT o_orderkey AS scene FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey)-1 AS i, (SELECT greatest(1, count(*)//40) FROM orders) AS step FROM orders) WHERE i % step = 0 AND i < step*40""")
def _(spark, sf):
    return W.every_nth(V.table(spark, sf, "orders").selectExpr("o_orderkey AS scene"), "scene", 40)


@query("S16_shard", "SELECT o_orderkey AS scene FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey)-1 AS i FROM orders) WHERE i % 7 = 3")
def _(spark, sf):
    return W.shard(V.table(spark, sf, "orders").selectExpr("o_orderkey AS scene"), "scene", 3, 7)


@query("W10_pick_best", """SELECT position, CASE WHEN best <> 'A' AND s - inc < 0.01 THEN 'A' ELSE best END AS best FROM (SELECT position, arg_max(name, struct_pack(a := round_even(score,4), b := name='A', c := name)) AS best,
    arg_max(score, struct_pack(a := round_even(score,4), b := name='A', c := name)) AS s, max(score) FILTER (name='A') AS inc FROM (
    SELECT position, unnest(['A','B','C']) AS name, unnest([CAST(count(*) FILTER (pred_a=y) AS DOUBLE)/count(*), CAST(count(*) FILTER (pred_b=y) AS DOUBLE)/count(*), CAST(count(*) FILTER (y=0) AS DOUBLE)/count(*)]) AS score FROM v_sites GROUP BY 1) GROUP BY 1)""")
def _(spark, sf):
    d = V.sites(spark, sf).selectExpr("position", "y", "stack(3, 'A', pred_a, 'B', pred_b, 'C', 0) AS (name, pred)")
    c = d.groupBy("position", "name").agg((F.count_if(F.col("y") == F.col("pred")) / F.count("*")).alias("score"))
    return W.pick_best(c, "name", "score", "A", ("position",), 0.01).select("position", "best")


@query("W11_pick_largest_box", """SELECT scene, arg_max(k, struct_pack(a := (1+px%300+k*7)*(1+(px+k*31)%200), b := -k)) AS k FROM v_sites GROUP BY 1""")
def _(spark, sf):
    d = V.sites(spark, sf).selectExpr("scene", "k", "(1+px%300+k*7)*(1+(px+k*31)%200) AS area")
    return d.groupBy("scene").agg(F.max_by("k", F.struct("area", (-F.col("k")).alias("nk"))).alias("k"))


@query("W11_pick_casualty", """SELECT scene, round(max(score), 9) AS score, CAST(arg_max(k, score) AS INT) AS k FROM (SELECT *, area/maxa + 0.7*(1-least(greatest(sqrt(cx*cx+cy*cy)/0.7071,0),1)) + 0.8*least(greatest(legs/torso/1.5,0),1)
      + 0.3*p0 - 0.3*least(greatest(-(sy-hy)/torso,0),1) AS score FROM (SELECT *, max(area) OVER (PARTITION BY scene) AS maxa, sqrt((sx-hx)*(sx-hx)+(sy-hy)*(sy-hy))+1e-6 AS torso, sqrt((ax-hx)*(ax-hx)+(ay-hy)*(ay-hy)) AS legs,
      (x1+x2)/2/1280-0.5 AS cx, (y1+y2)/2/960-0.5 AS cy FROM (SELECT *, (x2-x1)*(y2-y1) AS area FROM (SELECT scene, k, p0, CAST(px%600 AS DOUBLE) AS x1, CAST(px%600+50+(px+k*31)%400 AS DOUBLE) AS x2, CAST(px%300 AS DOUBLE) AS y1,
      CAST(px%300+60+(px*k)%500 AS DOUBLE) AS y2, CAST(px%640 AS DOUBLE) AS sx, CAST((px+k*17)%480 AS DOUBLE) AS sy, CAST((px*3)%640 AS DOUBLE) AS hx, CAST((px*5+k)%480 AS DOUBLE) AS hy, CAST((px*7)%640 AS DOUBLE) AS ax,
      CAST((px*11)%480 AS DOUBLE) AS ay FROM v_sites)))) GROUP BY 1""")
def _(spark, sf):
    box = """named_struct('k', k, 'x1', CAST(px%600 AS DOUBLE), 'x2', CAST(px%600+50+(px+k*31)%400 AS DOUBLE), 'y1', CAST(px%300 AS DOUBLE), 'y2', CAST(px%300+60+(px*k)%500 AS DOUBLE),
        'sx', CAST(px%640 AS DOUBLE), 'sy', CAST((px+k*17)%480 AS DOUBLE), 'hx', CAST((px*3)%640 AS DOUBLE), 'hy', CAST((px*5+k)%480 AS DOUBLE), 'ax', CAST((px*7)%640 AS DOUBLE), 'ay', CAST((px*11)%480 AS DOUBLE), 'conf', p0)"""
    d = V.sites(spark, sf).groupBy("scene").agg(F.sort_array(F.collect_list(F.expr(box))).alias("boxes"))
    d = d.withColumn("scores", lying_score(F.col("boxes"), F.lit(1280), F.lit(960)))
    best = F.array_max("scores")
    return d.select("scene", F.round(best, 9).alias("score"), F.col("boxes")[F.array_position("scores", best).cast("int") - 1]["k"].cast("int").alias("k"))


@query("U3_pool", """SELECT source, w, count(*) AS n FROM (SELECT 'synthetic' AS source, CAST(1 AS DOUBLE) AS w FROM v_sites WHERE split='dev' UNION ALL SELECT 'real', CAST(3 AS DOUBLE) FROM v_sites WHERE split='eval') GROUP BY ALL""")
def _(spark, sf):
    s = V.sites(spark, sf)
    return pool(s.filter("split='dev'").select("scene", "site", "y", "p"), s.filter("split='eval'").select("scene", "site", "y", "p"), 3.0).groupBy("source", "w").agg(F.count("*").alias("n"))


@query("S7_groups_default", """SELECT count(DISTINCT grp) AS groups, count(*) AS ids FROM (SELECT CASE WHEN o_orderkey%3=0 THEN 'g' || (o_custkey%50) ELSE 's' || (o_orderkey//2) END AS grp FROM orders)""")
def _(spark, sf):
    ids = V.table(spark, sf, "orders").selectExpr("'s' || (o_orderkey div 2) || '_v' || (o_orderkey % 2) || '.png' AS id", "o_orderkey", "o_custkey")
    given = ids.filter("o_orderkey % 3 = 0").selectExpr("id", "'g' || (o_custkey % 50) AS grp")
    return G.groups_of(ids, given, "id", T.name_group(F.col("id"))).agg(F.countDistinct("grp").alias("groups"), F.count("*").alias("ids"))


@query("G1_assign_folds", "SELECT cust AS grp, n, CAST((row_number() OVER (ORDER BY n DESC, md5(CAST(cust AS VARCHAR))) - 1) % 5 AS INT) AS fold FROM (SELECT cust, count(*) AS n FROM v_sites GROUP BY 1)")
def _(spark, sf):
    return G.assign_folds(V.sites(spark, sf), "grp")


@query("M3_fold_balance", "SELECT fold, count(*) AS groups, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CAST((row_number() OVER (ORDER BY n DESC, md5(CAST(cust AS VARCHAR))) - 1) % 5 AS INT) AS fold FROM (SELECT cust, count(*) AS n FROM v_sites GROUP BY 1)) GROUP BY 1")
def _(spark, sf):
    return G.assign_folds(V.sites(spark, sf), "grp").groupBy("fold").agg(F.count("*").alias("groups"), F.sum("n").alias("n"))


@query("G1_hash_folds", "SELECT CAST(CAST('0x' || substr(md5('0|' || cust),1,13) AS UBIGINT) % 5 AS INT) AS fold, count(*) AS n FROM v_sites GROUP BY 1")
def _(spark, sf):
    return G.hash_folds(V.sites(spark, sf), "grp").groupBy("fold").agg(F.count("*").alias("n"))


@query("G2_group_split", """SELECT grp, CASE WHEN r <= round_even(n*0.7::DOUBLE,0) THEN 'train' WHEN r <= round_even(n*0.7::DOUBLE,0)+round_even(n*0.15::DOUBLE,0) THEN 'dev' ELSE 'test' END AS split
    FROM (SELECT cust AS grp, row_number() OVER (ORDER BY md5('11|' || cust)) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT cust FROM v_sites))""")
def _(spark, sf):
    return G.group_split(V.sites(spark, sf), "grp", seed=11)


@query("G6_sample_without_replacement", "SELECT o_orderkey AS scene FROM orders ORDER BY md5('5|' || o_orderkey) LIMIT 240")
def _(spark, sf):
    return G.sample_without_replacement(V.table(spark, sf, "orders").selectExpr("o_orderkey AS scene"), "scene", 240, 5)


# The Poisson count of a uniform u: how many of the cumulated probabilities it reaches.
_BOOT = f"""f AS (SELECT k, 1.0::DOUBLE AS x FROM range(0,16) AS t(k)), c AS (SELECT a.k, exp(-1.0::DOUBLE) * sum(1.0::DOUBLE / CAST(factorial(CAST(b.k AS INT)) AS DOUBLE)) AS below FROM f a JOIN f b ON b.k <= a.k GROUP BY 1), cs AS (SELECT list(below ORDER BY k) AS below FROM c),
    g AS (SELECT cust, count(*) AS n, count(*) FILTER (y=pred_a) AS ok FROM v_sites GROUP BY 1),
    r AS (SELECT b, sum(n*w) AS n, sum(ok*w) AS ok FROM (SELECT b, n, ok, len(list_filter(below, lambda v: v <= u)) AS w FROM (SELECT b, n, ok, {_U.format(x="'0|' || b || '|' || cust")} AS u FROM g CROSS JOIN range(0,500) AS t(b)) CROSS JOIN cs) GROUP BY 1)"""


@query("G4_bootstrap_ci", f"""WITH {_BOOT} SELECT (SELECT CAST(count(*) FILTER (y=pred_a) AS DOUBLE)/count(*) FROM v_sites) AS acc, round(quantile_cont(CAST(ok AS DOUBLE)/n, 0.025), 9) AS lo, round(quantile_cont(CAST(ok AS DOUBLE)/n, 0.975), 9) AS hi FROM r""")
def _(spark, sf):
    ci = B.bootstrap_ci(V.sites(spark, sf), "grp", pred="pred_a", replicates=500)
    return ci.select("acc", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"))


@query("G5_resample_to_mix", f"""WITH c AS (SELECT y, pred_a, row_number() OVER (PARTITION BY y ORDER BY md5(scene || '|' || site)) - 1 AS idx, count(*) OVER (PARTITION BY y) AS size FROM v_sites),
    a AS (SELECT y, max(size) AS size, [450,150,200,200][y+1] AS want FROM c GROUP BY 1),
    d AS (SELECT a.y, t.draw, CAST(floor({_U.format(x="'3|' || t.draw || '|' || a.y || '|' || w.i")} * a.size) AS BIGINT) AS idx FROM a CROSS JOIN range(0,20) AS t(draw) CROSS JOIN range(0,450) AS w(i) WHERE w.i < a.want)
    SELECT CAST(d.draw AS INT) AS draw, d.y, count(*) AS n, count(*) FILTER (c.pred_a = d.y) AS hits FROM d JOIN c ON c.y=d.y AND c.idx=d.idx GROUP BY ALL""")
def _(spark, sf):
    s = V.sites(spark, sf)
    r = B.resample_to_mix(s, key_text(F.col("scene"), F.col("site")), (0.45, 0.15, 0.20, 0.20), 1000, 20, keep=("pred_a",), seed=3)
    return r.groupBy("draw", "y").agg(F.count("*").alias("n"), F.count_if(F.col("pred_a") == F.col("y")).alias("hits"))


@query("F25_sha_split", "SELECT instr('0123456789abcdef', substr(sha256(CAST(o_orderkey AS VARCHAR)),64,1)) % 2 = 0 AS odd, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    return V.table(spark, sf, "orders").select((sha_split(F.col("o_orderkey")) == 1).alias("odd")).groupBy("odd").agg(F.count("*").alias("n"))


@query("F25_crc_split")
def _(spark, sf):
    return V.table(spark, sf, "orders").select(crc_split(F.col("o_orderkey"), 0.2).alias("held")).groupBy("held").agg(F.count("*").alias("n"))


def ledger_input(spark, sf):
    """Rows in the form the ledger takes, with counterfactual classes from fixed columns."""
    d = V.raw_sites(spark, sf)
    cut = """CASE WHEN NOT ({v}) THEN 3 WHEN amputated THEN 2 WHEN wound_present AND wound_px>=20 THEN 1 ELSE 0 END"""
    return d.selectExpr(
        "*", "pred_a AS pred", f"map('0.00', {cut.format(v='visible_fraction>0')}, '0.25', {cut.format(v='visible_fraction>=0.25')}) AS labels", "wound_px AS wound_visible_px",
        "CASE WHEN px % 10 <> 0 THEN named_struct('err_torso', CAST(px % 30 AS DOUBLE)/100, 'side_swap', px % 17 = 0) END AS kp",
        "CASE WHEN has_side THEN CASE WHEN (scene+k)%4=0 THEN y ELSE pred_a END END AS pred_side",
        "CASE WHEN has_true THEN CASE WHEN (px+k)%3=0 THEN y ELSE pred_a END END AS pred_true_fixed",
        "CASE WHEN has_true AND scene%2=0 THEN CASE WHEN (px+k)%5=0 THEN y ELSE pred_b END END AS pred_true_refit",
        "CASE WHEN has_true THEN map('visibility', CASE WHEN px%4=0 THEN y ELSE pred_a END, 'wound', pred_b) END AS swaps")


_CUT = "CASE WHEN NOT ({v}) THEN 3 WHEN amputated THEN 2 WHEN wound_present AND wound_px>=20 THEN 1 ELSE 0 END"
LEDGER_SQL = f"""w0 AS (SELECT *, pred_a AS pred, greatest(p0,p1,p2,p3) AS conf, [p0,p1,p2,p3][y+1] AS ptrue, {_CUT.format(v='visible_fraction>0')} AS l0, {_CUT.format(v='visible_fraction>=0.25')} AS l25,
      CASE WHEN px%10<>0 THEN CAST(px%30 AS DOUBLE)/100 END AS kerr, CASE WHEN px%10<>0 THEN px%17=0 END AS kswap,
      CASE WHEN has_side THEN CASE WHEN (scene+k)%4=0 THEN y ELSE pred_a END END AS ps, CASE WHEN has_true THEN CASE WHEN (px+k)%3=0 THEN y ELSE pred_a END END AS pf,
      CASE WHEN has_true AND scene%2=0 THEN CASE WHEN (px+k)%5=0 THEN y ELSE pred_b END END AS pr,
      CASE WHEN has_true THEN CASE y WHEN 1 THEN t_wound WHEN 2 THEN t_stump END END AS kt, CASE y WHEN 1 THEN r_wound WHEN 2 THEN r_stump END AS ks,
      CASE WHEN has_true THEN CASE pred_a WHEN 1 THEN t_wound WHEN 2 THEN t_stump END END AS ht, CASE pred_a WHEN 1 THEN r_wound WHEN 2 THEN r_stump END AS hp FROM (SELECT * EXCLUDE (cause) FROM v_raw)),
    w1 AS (SELECT *, CASE WHEN y<>pred THEN CASE WHEN conf>=0.8 OR coalesce((y=2 AND has_true AND t_stump>=300) OR (y=1 AND wound_px>=200), false) THEN 'gross' ELSE 'near' END
      WHEN coalesce(kt>=20 AND ks<=kt*0.3, false) THEN 'lucky' WHEN ptrue<0.6 THEN 'near' ELSE 'ok' END AS severity FROM w0),
    w2 AS (SELECT *, (y<>pred OR severity='lucky') AS look, (l0<>y AND l0=pred) OR (l25<>y AND l25=pred) OR coalesce(y=2 AND has_true AND t_stump=0, false) AS fl, coalesce(ps=y,false) AS fk,
      coalesce(kswap,false) OR coalesce(kerr>0.15,false) AS fp, coalesce(pf=y,false) OR coalesce(pr=y,false) AS fs FROM w1),
    led AS (SELECT *, CASE WHEN y<>pred THEN CASE WHEN fl THEN 'L' WHEN fk THEN 'K' WHEN fs THEN 'S' WHEN has_true THEN 'F' END END AS cause,
      CASE WHEN y<>pred AND NOT fl AND NOT fk AND fs THEN CASE WHEN coalesce(kt>=20 AND coalesce(ks,0)<=kt*0.3,false) THEN 'miss' WHEN coalesce(hp>=20 AND coalesce(ht,0)<=hp*0.3,false) THEN 'hall'
        WHEN has_true AND t_vis>0 AND NOT (CAST(r_vis AS DOUBLE)/greatest(t_vis,1) BETWEEN 0.5 AND 2) THEN 'extent' ELSE 'other' END END AS cause_sub,
      CASE WHEN look THEN concat_ws(',', CASE WHEN fl THEN 'L' END, CASE WHEN fk THEN 'K' END, CASE WHEN fp THEN 'K-pos' END, CASE WHEN fs THEN 'S' WHEN has_true THEN 'F' END) ELSE '' END AS flags,
      CASE WHEN look AND fs AND has_true THEN concat_ws(',', CASE WHEN (CASE WHEN px%4=0 THEN y ELSE pred_a END)=y THEN 'visibility' END, CASE WHEN pred_b=y THEN 'wound' END) ELSE '' END AS fixed_by FROM w2)"""


@query("F20_severity", f"WITH {LEDGER_SQL} SELECT scene, site, severity FROM led")
def _(spark, sf):
    return L.with_causes(ledger_input(spark, sf), ("0.00", "0.25")).select("scene", "site", "severity")


@query("F21_cause_flags", f"WITH {LEDGER_SQL} SELECT scene, site, flags, cause, cause_sub, fixed_by FROM led")
def _(spark, sf):
    d = L.with_causes(ledger_input(spark, sf), ("0.00", "0.25"))
    return d.select("scene", "site", F.array_join("flags", ",").alias("flags"), "cause", "cause_sub", F.array_join(F.array_sort("fixed_by_group"), ",").alias("fixed_by"))


@query("F22_primary_cause", f"WITH {LEDGER_SQL} SELECT cause, count(*) AS n FROM led GROUP BY 1")
def _(spark, sf):
    return L.with_causes(ledger_input(spark, sf), ("0.00", "0.25")).groupBy("cause").agg(F.count("*").alias("n"))


@query("F23_fixed_by_group", f"WITH {LEDGER_SQL} SELECT g, count(*) AS n FROM (SELECT unnest(string_split(fixed_by, ',')) AS g FROM led WHERE fixed_by <> '') GROUP BY 1")
def _(spark, sf):
    d = L.with_causes(ledger_input(spark, sf), ("0.00", "0.25"))
    return d.select(F.explode("fixed_by_group").alias("g")).groupBy("g").agg(F.count("*").alias("n"))


@query("A11_cause_pareto", f"""WITH {LEDGER_SQL} SELECT *, CAST(total AS DOUBLE)/sum(total) OVER (PARTITION BY split) AS share FROM (SELECT split, CASE WHEN cause IS NULL THEN 'unassigned' ELSE concat_ws('-', cause, cause_sub) END AS code,
    count(*) FILTER (severity='gross') AS gross, count(*) FILTER (severity<>'gross') AS near, count(*) AS total FROM led WHERE y<>pred GROUP BY ALL)""")
def _(spark, sf):
    return L.cause_pareto(L.with_causes(ledger_input(spark, sf), ("0.00", "0.25")))


@query("A12_error_pairs_with_causes", f"""WITH {LEDGER_SQL} SELECT split, y, pred, CAST(sum(k) AS BIGINT) AS n, string_agg(c || ' ' || k, ', ' ORDER BY k DESC, c) AS causes FROM (
    SELECT split, y, pred, coalesce(cause,'?') AS c, count(*) AS k FROM led WHERE y<>pred GROUP BY ALL) GROUP BY ALL""")
def _(spark, sf):
    return L.error_pairs_with_causes(L.with_causes(ledger_input(spark, sf), ("0.00", "0.25")))


@query("A13_key_pixel_ratio", f"""WITH {LEDGER_SQL} SELECT split, CASE y WHEN 1 THEN 'wound' ELSE 'amputation' END AS class, position, count(*) AS n, round(median(CAST(ks AS DOUBLE)/kt),9) AS median_ratio,
    CAST(count(*) FILTER (CAST(ks AS DOUBLE)/kt < 0.3) AS DOUBLE)/count(*) AS "under_0.3" FROM led WHERE kt > 0 GROUP BY ALL""")
def _(spark, sf):
    return L.key_pixel_ratio(ledger_input(spark, sf)).withColumn("median_ratio", F.round("median_ratio", 9))


@query("W6_top_gross", f"""WITH {LEDGER_SQL} SELECT split, scene, site, conf FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY conf DESC, scene, site) AS rk FROM led WHERE y<>pred AND severity='gross') WHERE rk <= 20""")
def _(spark, sf):
    return L.top_gross(L.with_causes(ledger_input(spark, sf), ("0.00", "0.25"))).select("split", "scene", "site", "conf")


@query("D9_ledger", f"""WITH {LEDGER_SQL} SELECT scene, site, split, CASE y WHEN 0 THEN 'no_injury' WHEN 1 THEN 'wound' WHEN 2 THEN 'amputation' ELSE 'not_testable' END AS true, y=pred AS correct, severity, cause,
    CASE ps WHEN 0 THEN 'no_injury' WHEN 1 THEN 'wound' WHEN 2 THEN 'amputation' WHEN 3 THEN 'not_testable' END AS side, r_stump AS stump_pred, CASE WHEN has_true THEN t_stump END AS stump_true FROM led""")
def _(spark, sf):
    d = L.ledger(ledger_input(spark, sf), ("0.00", "0.25"), "check")
    return d.select("scene", "site", "split", "true", "correct", "severity", "cause", F.col("counterfactual")["side"].alias("side"),
                    F.col("delta")["stump_px"]["pred"].alias("stump_pred"), F.col("delta")["stump_px"]["true"].alias("stump_true"))


@query("L_severity_counts", f"WITH {LEDGER_SQL} SELECT split, severity, y=pred AS correct, count(*) AS n FROM led GROUP BY ALL")
def _(spark, sf):
    return L.severity_counts(L.with_causes(ledger_input(spark, sf), ("0.00", "0.25")))

