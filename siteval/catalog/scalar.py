"""Queries of the scalar, array and text functions."""

from pyspark.sql import functions as F

from siteval import fixtures as V
from siteval.catalog import query
from siteval.catalog.order import _FEATS
from siteval.constants import FEATURE_GROUPS, SITES
from siteval.functions import features as X
from siteval.functions import geometry as Q
from siteval.functions import labels as L
from siteval.functions import probs as P
from siteval.functions import rules as R
from siteval.functions import stats as S
from siteval.functions import text as T
from siteval.operators import calibration as C
from siteval.operators import layer as M
from siteval.operators import metrics as A
from siteval.operators import pixels as XP
from siteval.operators import sites as O
from siteval.runtime import case


def _rounded(col, n, prefix="f", digits=9):
    return [F.round(col[i], digits).alias(f"{prefix}{i:02d}") for i in range(n)]


@query("F1_site_features", f"SELECT scene, site, {', '.join(f'round(fr[{i + 1}],9) AS f{i:02d}' for i in range(19))} FROM {_FEATS}")
def _(spark, sf):
    return V.raw_sites(spark, sf).select("scene", "site", *_rounded(X.site_features(F.col("raw")), 19))


@query("F2_limb_features", """SELECT scene, site, round(ln(1+amodal),9) AS f00, round(vom,9) AS f01, round(q0,9) AS f02, round(q0,9) AS f03, round(q1,9) AS f04, round(q2,9) AS f05, round(q3,9) AS f06, round(CAST(px%10 AS DOUBLE)/10,9) AS f07 FROM v_raw""")
def _(spark, sf):
    return V.raw_sites(spark, sf).select("scene", "site", *_rounded(X.limb_features(F.col("raw")), 8))


@query("F3_three_class_features", f"SELECT scene, site, {', '.join(f'round(fr[{i + 1}],9) AS f{i:02d}' for i in range(15))} FROM {_FEATS}")
def _(spark, sf):
    return V.raw_sites(spark, sf).select("scene", "site", *_rounded(X.three_class_features(F.col("raw")), 15))


@query("F4_visible_fraction_features", """SELECT a.scene, a.site, round(ln(1+a.r_vis),9) AS f00, round(a.r_vis/(a.torso*a.torso),9) AS f01, round(ln(1+b.r_vis),9) AS f04, round((a.r_vis+1.0)/(b.r_vis+1),9) AS f05,
    round(50.0*a.k/a.torso,9) AS f06, round(50.0*b.k/a.torso,9) AS f07, round(a.r_vis/greatest(2500.0*a.k*a.k,1.0),9) AS f08, CAST(a.k<=2 AS DOUBLE) AS f12, round(CASE WHEN a.r_vis>=30 THEN a.p2/a.psum ELSE 0 END,9) AS f16
    FROM v_raw a JOIN v_raw b ON a.scene=b.scene AND a.mk=b.k""")
def _(spark, sf):
    d = V.raw_sites(spark, sf)
    mirror = d.select("scene", L.mirror_site(F.col("site")).alias("site"), F.col("raw").alias("opp"))
    j = d.join(mirror, ["scene", "site"])
    v = X.visible_fraction_features(F.col("raw"), F.col("opp"), F.col("k") * 50.0, F.col("mk") * 50.0, F.array(F.col("p0"), F.col("p1"), F.col("p2")), L.is_upper(F.col("site")))
    return j.select("scene", "site", *[F.round(v[i], 9).alias(f"f{i:02d}") for i in (0, 1, 4, 5, 6, 7, 8, 12, 16)])


@query("F4_chain_length", """SELECT scene, site, round(sqrt(4*(px%9)*(px%9) + 9.0*(px%7)*(px%7)) + sqrt(4*(px%9)*(px%9) + 9.0*(px%7)*(px%7)), 9) AS "length" FROM v_sites""")
def _(spark, sf):
    xy = F.expr("transform(sequence(0, 16), i -> array(CAST(i*(px%9) AS DOUBLE), CAST(i*(px%7) AS DOUBLE)*1.5D))")
    length = case([(F.col("site") == s, X.chain_length(xy, s)) for s in SITES])
    return V.sites(spark, sf).select("scene", "site", F.round(length, 9).alias("length"))


@query("F5_visible_fraction_terms", """SELECT scene, site, v, round(ln(c/(1-c)),9) AS logit, CAST(v<0.1 AS DOUBLE) AS under, round(abs(ln(c/(1-c)) - ln(0.1/0.9::DOUBLE)),9) AS dist FROM (
    SELECT scene, site, visible_fraction AS v, least(greatest(visible_fraction,0.001),0.999) AS c FROM v_sites)""")
def _(spark, sf):
    v = X.visible_fraction_terms(F.col("visible_fraction"))
    return V.sites(spark, sf).select("scene", "site", v[0].alias("v"), F.round(v[1], 9).alias("logit"), v[2].alias("under"), F.round(v[3], 9).alias("dist"))


_LAYER = M.Layer([0.25, 0.25, 0.25, 0.25], [0.2, 0.1, 0.15, 0.3], [[1.0, -0.5, 0.25, 0.0], [-0.5, 1.5, 0.0, 0.25], [0.0, 0.25, 2.0, -1.0], [-0.5, -1.25, -2.25, 0.75]], [0.3, -0.1, -0.2, 0.0], 0.1)
_Z = [f"((p{i}-0.25)/{s})" for i, s in enumerate(_LAYER.scale)]
_LOGITS = [" + ".join(f"({w})*{z}" for w, z in zip(row, _Z)) + f" + ({b})" for row, b in zip(_LAYER.coef, _LAYER.intercept)]


@query("F6_softmax_linear", f"SELECT scene, site, round(e0/(e0+e1+e2+e3),9) AS s0, round(e1/(e0+e1+e2+e3),9) AS s1, round(e2/(e0+e1+e2+e3),9) AS s2, round(e3/(e0+e1+e2+e3),9) AS s3 FROM (SELECT scene, site, {', '.join(f'exp(CAST({l} AS DOUBLE)) AS e{i}' for i, l in enumerate(_LOGITS))} FROM v_sites)")
def _(spark, sf):
    return V.sites(spark, sf).withColumn("s", P.softmax_linear(F.col("p"), _LAYER)).select("scene", "site", *[F.round(F.col("s")[i], 9).alias(f"s{i}") for i in range(4)])


_BIAS = (0.0, 0.5, -0.25, 0.125)


@query("F7_decide", f"""SELECT scene, site, CASE WHEN l0>=greatest(l1,l2,l3) THEN 0 WHEN l1>=greatest(l2,l3) THEN 1 WHEN l2>=l3 THEN 2 ELSE 3 END AS call FROM (SELECT scene, site, {', '.join(f'ln(p{i})+({b}) AS l{i}' for i, b in enumerate(_BIAS))} FROM v_sites)""")
def _(spark, sf):
    return V.sites(spark, sf).select("scene", "site", P.decide(F.col("p"), _BIAS).alias("call"))


@query("F8_centred_logits", f"SELECT scene, site, round(l0-m,9) AS c0, round(l1-m,9) AS c1, round(l2-m,9) AS c2, round(l3-m,9) AS c3 FROM (SELECT *, (l0+l1+l2+l3)/4 AS m FROM (SELECT scene, site, {', '.join(f'CAST({l} AS DOUBLE) AS l{i}' for i, l in enumerate(_LOGITS))} FROM v_sites))")
def _(spark, sf):
    c = P.centred_logits(F.col("p"), _LAYER)
    return V.sites(spark, sf).withColumn("c", c).select("scene", "site", *[F.round(F.col("c")[i], 9).alias(f"c{i}") for i in range(4)])


@query("F9_entropy", "SELECT scene, site, round(-(p0*ln(p0+1e-9)+p1*ln(p1+1e-9)+p2*ln(p2+1e-9)+p3*ln(p3+1e-9)),9) AS entropy FROM v_sites")
def _(spark, sf):
    return V.sites(spark, sf).select("scene", "site", F.round(P.entropy(F.col("p")), 9).alias("entropy"))


@query("F10_check_probs", "SELECT px % 8 AS kind, bool_and(px % 8 > 4) AS ok, count(*) AS n FROM v_sites GROUP BY 1")
def _(spark, sf):
    bad = F.expr("""CASE px % 8 WHEN 0 THEN array(0.5D, 0.5D, 0.5D, 0.0D) WHEN 1 THEN array(double('NaN'), 0.0D, 0.0D, 1.0D) WHEN 2 THEN array(1.0D, 0.0D, 0.0D) WHEN 3 THEN array(-0.1D, 0.6D, 0.5D, 0.0D)
        WHEN 4 THEN NULL ELSE p END""")
    d = V.sites(spark, sf).select((F.col("px") % 8).alias("kind"), F.when(F.size(bad) == 3, F.concat(bad, F.array(F.lit(None).cast("double")))).otherwise(bad).alias("v"))
    return d.groupBy("kind").agg(F.bool_and(P.check_probs(F.col("v"))).alias("ok"), F.count("*").alias("n"))


@query("F11_encounter_id", """SELECT page_id, left(CASE WHEN c='' THEN 'img' ELSE c END, 40) || '-' || left(sha1(url), 8) AS encounter FROM (SELECT page_id, url, regexp_replace(regexp_replace(lower(url), '[^a-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g') AS c FROM pages)""")
def _(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", T.encounter_id(F.col("url")).alias("encounter"))


@query("F12_stem", """SELECT page_id, regexp_replace(regexp_replace(url, '^.*/', ''), '([^.])[.][^.]*$', '\\1') AS stem, regexp_replace(url, '[^0-9]', '', 'g') AS digits FROM pages""")
def _(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", T.stem(F.col("url")).alias("stem"), T.digits(F.col("url")).alias("digits"))


@query("F13_output_id", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN left(text, 30) || '\\xff.jpg' ELSE left(text, 30) || '.jpg' END AS name FROM documents""")
def _(spark, sf):
    raw = F.expr("CASE WHEN doc_id % 3 = 0 THEN encode(left(text, 30), 'UTF-8') || X'FF' || encode('.jpg', 'UTF-8') ELSE encode(left(text, 30) || '.jpg', 'UTF-8') END")
    return V.table(spark, sf, "documents").select("doc_id", T.output_id(raw).alias("name"))


_JOINTS = """map('LUE', map('shoulder', {j(1)}, 'elbow', {j(2)}, 'wrist', {j(3)}), 'RUE', map('shoulder', {j(4)}, 'elbow', {j(5)}, 'wrist', {j(6)}),
    'LLE', map('hip', {j(7)}, 'knee', {j(8)}, 'ankle', {j(9)}), 'RLE', map('hip', {j(10)}, 'knee', {j(11)}, 'ankle', {j(12)}))"""


def _joint(i):
    return f"named_struct('x', CAST(({i}*37 + px % 300) AS DOUBLE), 'y', CAST(({i}*53 + px % 200) AS DOUBLE), 'visible', (px + {i}) % 4 <> 0)"


def joints_column():
    out = _JOINTS
    for i in range(12, 0, -1):
        out = out.replace(f"{{j({i})}}", _joint(i))
    return out


def _gt(i):
    return f"({i}*37 + px%300)", f"({i}*53 + px%200)"


def _kp_sql():
    e, o = [], []
    for n, (kp, own, opp) in enumerate(((5, 1, 4), (7, 2, 5), (9, 3, 6))):
        x, y = f"({kp}*30.0 + px%350)", f"({kp}*20.0 + px%250)"
        use = f"(px+{own})%4<>0 AND CAST((px+{kp})%10 AS DOUBLE)/10 >= 0.3"
        (gx, gy), (hx, hy) = _gt(own), _gt(opp)
        e.append(f"CASE WHEN {use} THEN sqrt(({x}-{gx})*({x}-{gx})+({y}-{gy})*({y}-{gy})) END")
        o.append(f"CASE WHEN {use} THEN sqrt(({x}-{hx})*({x}-{hx})+({y}-{hy})*({y}-{hy})) END")
    return e, o


_KE, _KO = _kp_sql()


@query("F14_kp_error", f"""SELECT scene, round(list_median(list_filter(e, lambda v: v IS NOT NULL))/greatest(sqrt((37*2.5-37*8.5)*(37*2.5-37*8.5)+(53*2.5-53*8.5)*(53*2.5-53*8.5)),1),6) AS err_torso, CAST(len(list_filter(e, lambda v: v IS NOT NULL)) AS INT) AS n_joints,
    list_median(list_filter(o, lambda v: v IS NOT NULL)) < list_median(list_filter(e, lambda v: v IS NOT NULL)) AS side_swap FROM (SELECT scene, [{', '.join(_KE)}] AS e, [{', '.join(_KO)}] AS o FROM v_sites WHERE k=1)
    WHERE len(list_filter(e, lambda v: v IS NOT NULL)) > 0""")
def _(spark, sf):
    d = V.sites(spark, sf).filter("k = 1").selectExpr(
        "scene", "transform(sequence(0, 22), i -> array(CAST(i*30 + px%350 AS DOUBLE), CAST(i*20 + px%250 AS DOUBLE))) AS xy", "transform(sequence(0, 22), i -> CAST((px+i)%10 AS DOUBLE)/10) AS score", f"{joints_column()} AS joints")
    d = d.select("scene", Q.kp_error(F.col("xy"), F.col("score"), F.col("joints"), "LUE").alias("e")).filter("e IS NOT NULL")
    return d.select("scene", F.round("e.err_torso", 6).alias("err_torso"), "e.n_joints", "e.side_swap")


@query("F15_joint_state", """SELECT state, count(*) AS n FROM (SELECT CASE WHEN px%7=0 THEN 'absent' WHEN px%5=0 THEN 'out_of_frame' WHEN px%3=0 THEN 'visible' ELSE 'occluded' END AS state FROM v_sites) GROUP BY 1""")
def _(spark, sf):
    d = V.sites(spark, sf).select(Q.joint_state(F.col("px") % 7 != 0, F.col("px") % 5 != 0, F.col("px") % 3 == 0).alias("state"))
    return d.groupBy("state").agg(F.count("*").alias("n"))


_PT = "named_struct('x', CAST({x} AS DOUBLE), 'y', CAST({y} AS DOUBLE), 'conf', {c})"


@query("F16_laterality_swap", """SELECT scene, site, n > 0 AND far < near*0.6 AS swapped FROM (SELECT scene, site, CAST(p0>=0.3 AS INT)+CAST(p1>=0.3 AS INT)+CAST(p2>=0.3 AS INT) AS n,
    CASE WHEN p0>=0.3 THEN sqrt(pow(px%50-px%80,2)+pow(px%60-px%90,2)) ELSE 0 END + CASE WHEN p1>=0.3 THEN sqrt(pow(px%51-px%81,2)+pow(px%61-px%91,2)) ELSE 0 END + CASE WHEN p2>=0.3 THEN sqrt(pow(px%52-px%82,2)+pow(px%62-px%92,2)) ELSE 0 END AS near,
    CASE WHEN p0>=0.3 THEN sqrt(pow(px%50-px%70,2)+pow(px%60-px%75,2)) ELSE 0 END + CASE WHEN p1>=0.3 THEN sqrt(pow(px%51-px%71,2)+pow(px%61-px%76,2)) ELSE 0 END + CASE WHEN p2>=0.3 THEN sqrt(pow(px%52-px%72,2)+pow(px%62-px%77,2)) ELSE 0 END AS far FROM v_sites)""")
def _(spark, sf):
    def points(a, b):
        return "array(" + ", ".join(_PT.format(x=f"px%{a + i}", y=f"px%{b + i}", c=f"p{i}") for i in range(3)) + ")"
    d = V.sites(spark, sf).selectExpr("scene", "site", points(50, 60) + " AS pr", points(80, 90) + " AS own", points(70, 75) + " AS opp")
    return d.select("scene", "site", Q.laterality_swap(F.col("pr"), F.col("own"), F.col("opp")).alias("swapped"))


_LGAMMA = "lgamma(CAST(n+1 AS DOUBLE)) - lgamma(CAST(i+1 AS DOUBLE)) - lgamma(CAST(n-i+1 AS DOUBLE))"


@query("F18_sign_p", f"""SELECT grp, fixed, broken, round(CASE WHEN fixed+broken=0 THEN 1.0::DOUBLE ELSE least(1.0, 2*(SELECT sum(exp({_LGAMMA} - n*ln(2.0))) FROM range(0, least(fixed,broken)+1) AS r(i))) END + 1e-10, 7) AS p FROM (
    SELECT cust AS grp, count(*) FILTER (pred_a<>y AND pred_b=y) AS fixed, count(*) FILTER (pred_a=y AND pred_b<>y) AS broken, count(*) FILTER ((pred_a=y)<>(pred_b=y)) AS n FROM v_sites GROUP BY 1)""")
def _(spark, sf):
    d = V.sites(spark, sf).groupBy("grp").agg(A.count_if((F.col("pred_a") != F.col("y")) & (F.col("pred_b") == F.col("y"))).alias("fixed"), A.count_if((F.col("pred_a") == F.col("y")) & (F.col("pred_b") != F.col("y"))).alias("broken"))
    return d.withColumn("p", F.round(S.sign_p(F.col("fixed"), F.col("broken")) + 1e-10, 7))


@query("F19_visibility_band", """SELECT CASE WHEN visible_fraction<0.10 THEN '<0.10' WHEN visible_fraction<0.25 THEN '0.10-0.25' WHEN visible_fraction<0.5 THEN '0.25-0.50' ELSE '>=0.50' END AS band, count(*) AS n FROM v_sites GROUP BY 1""")
def _(spark, sf):
    return V.sites(spark, sf).groupBy(L.visibility_band(F.col("visible_fraction")).alias("band")).agg(F.count("*").alias("n"))


@query("F24_colour_codes", """SELECT code, count(*) AS n FROM (SELECT (CASE WHEN r>220 THEN 2 WHEN r>90 THEN 1 ELSE 0 END)*9 + (CASE WHEN g>220 THEN 2 WHEN g>90 THEN 1 ELSE 0 END)*3 + (CASE WHEN b>220 THEN 2 WHEN b>90 THEN 1 ELSE 0 END) AS code FROM (
    SELECT (l_partkey*37)%256 AS r, (l_orderkey*11)%256 AS g, (l_suppkey*91)%256 AS b FROM lineitem)) GROUP BY 1""")
def _(spark, sf):
    d = V.table(spark, sf, "lineitem").selectExpr("(l_partkey*37)%256 AS r", "(l_orderkey*11)%256 AS g", "(l_suppkey*91)%256 AS b")
    return d.groupBy(XP.colour_code(F.col("r"), F.col("g"), F.col("b")).alias("code")).agg(F.count("*").alias("n"))


@query("F26_signal_ratios", """SELECT mask, CAST(h AS DOUBLE)/greatest(t,1) AS recall, CAST(h AS DOUBLE)/greatest(m,1) AS "precision" FROM (SELECT 'u' AS mask, count(*) FILTER (l_suppkey%3=0 AND l_partkey%2=0) AS h, count(*) FILTER (l_suppkey%3=0) AS t, count(*) FILTER (l_partkey%2=0) AS m FROM lineitem
    UNION ALL SELECT 'r', count(*) FILTER (l_suppkey%3=0 AND l_partkey%10=0), count(*) FILTER (l_suppkey%3=0), count(*) FILTER (l_partkey%10=0) FROM lineitem)""")
def _(spark, sf):
    d = V.table(spark, sf, "lineitem").selectExpr("l_suppkey%3=0 AS hidden", "l_partkey%2=0 AS u", "l_partkey%10=0 AS r")
    return XP.signal_ratios(d, "hidden", ["u", "r"])


@query("F27_axis_error", """SELECT CAST(count(*) AS BIGINT) AS n, count(*) FILTER (e<90) AS head_end_right, count(*) FILTER (e<30) AS within_30 FROM (SELECT degrees(acos(least(greatest(cos(px%628/100.0)*cos(scene%628/100.0)+sin(px%628/100.0)*sin(scene%628/100.0),-1),1))) AS e FROM v_sites)""")
def _(spark, sf):
    d = V.sites(spark, sf).selectExpr("CAST(px%628 AS DOUBLE)/100 AS a", "CAST(scene%628 AS DOUBLE)/100 AS b")
    e = Q.axis_error(F.cos("a"), F.sin("a"), F.cos("b"), F.sin("b"))
    return d.select(e.alias("e")).agg(F.count("*").alias("n"), A.count_if(F.col("e") < 90).alias("head_end_right"), A.count_if(F.col("e") < 30).alias("within_30"))


@query("F28_facing_from_counts", """SELECT scene, site, CASE WHEN px%9=0 THEN NULL WHEN CAST(px%200 AS DOUBLE)/greatest(px%200+px%170,1) > 0.5 THEN 'front' ELSE 'back' END AS facing,
    CASE WHEN px%9=0 THEN NULL ELSE greatest(CAST(px%200 AS DOUBLE)/greatest(px%200+px%170,1), 1-CAST(px%200 AS DOUBLE)/greatest(px%200+px%170,1)) END AS conf FROM v_sites""")
def _(spark, sf):
    facing, conf = R.front_share_facing(F.expr("CASE WHEN px%9<>0 THEN px%200 END"), F.expr("px%200 + px%170"))
    return V.sites(spark, sf).select("scene", "site", facing.alias("facing"), conf.alias("conf"))


@query("F29_view_map", """SELECT view, count(*) AS n FROM (SELECT CASE px%5 WHEN 0 THEN 'anterior' WHEN 1 THEN 'posterior' WHEN 2 THEN 'oblique' ELSE 'unknown' END AS view FROM v_sites) GROUP BY 1""")
def _(spark, sf):
    from siteval.operators.events import view_of
    facing = F.expr("CASE px%5 WHEN 0 THEN 'front' WHEN 1 THEN 'back' WHEN 2 THEN 'edge' WHEN 3 THEN 'sideways' END")
    return V.sites(spark, sf).groupBy(view_of(facing).alias("view")).agg(F.count("*").alias("n"))


@query("F30_box_area_share", """SELECT scene, max(s) AS area_1, round(arg_max(s2, r), 12) AS area_2 FROM (SELECT *, s AS s2, CASE rk WHEN 2 THEN 1 ELSE 0 END AS r FROM (SELECT scene, CAST((px%300+k)*(px%200+k*3) AS DOUBLE)/(1280*960) AS s,
    row_number() OVER (PARTITION BY scene ORDER BY (px%300+k)*(px%200+k*3) DESC) AS rk FROM v_sites)) GROUP BY 1""")
def _(spark, sf):
    box = "named_struct('x1', 0.0D, 'y1', 0.0D, 'x2', CAST(px%300+k AS DOUBLE), 'y2', CAST(px%200+k*3 AS DOUBLE))"
    d = V.sites(spark, sf).groupBy("scene").agg(F.collect_list(F.expr(box)).alias("b"))
    s = X.box_area_share(F.col("b"), F.lit(1280.0), F.lit(960.0))
    return d.select("scene", s[0].alias("area_1"), F.round(s[1], 12).alias("area_2"))


@query("M1_standardise", """WITH m AS (SELECT avg(p0) AS m0, stddev_pop(p0) AS s0, avg(visible_fraction) AS m1, stddev_pop(visible_fraction) AS s1 FROM v_sites)
    SELECT scene, site, round((p0-m0)/s0,6) AS z0, round((visible_fraction-m1)/s1,6) AS z1, CAST(0.0 AS DOUBLE) AS z2 FROM v_sites CROSS JOIN m""")
def _(spark, sf):
    d = V.sites(spark, sf).withColumn("x", F.array("p0", "visible_fraction", F.lit(7.0)))
    z, _, _ = M.standardise(d, "x", 3)
    return z.select("scene", "site", F.round(F.col("z")[0], 6).alias("z0"), F.round(F.col("z")[1], 6).alias("z1"), F.col("z")[2].alias("z2"))


_VIS = FEATURE_GROUPS["visibility"]


@query("M7_group_swap", f"SELECT scene, site, {', '.join(f'round({chr(102)}{chr(116) if i in _VIS else chr(114)}[{i + 1}],9) AS f{i:02d}' for i in range(19))} FROM {_FEATS} WHERE has_true")
def _(spark, sf):
    d = O.features(O.features(V.raw_sites(spark, sf).filter("has_true"), "raw", out="xp"), "raw_true", out="xt")
    s = X.swap_group(F.col("xp"), F.col("xt"), FEATURE_GROUPS["visibility"], 19)
    return d.withColumn("s", s).select("scene", "site", *_rounded(F.col("s"), 19))


_RECAL = M.Layer([0.0] * 4, [1.0] * 4, [[1.2, 0.1, -0.3, 0.0], [0.2, 0.9, 0.1, -0.4], [-0.6, 0.3, 1.1, 0.2], [-0.8, -1.3, -0.9, 0.2]], [0.05, -0.15, 0.2, -0.1], 0.1, _LAYER)


@query("M10_fold_recal", f"""SELECT scene, site, round(e0/(e0+e1+e2+e3),9) AS s0, round(e1/(e0+e1+e2+e3),9) AS s1, round(e2/(e0+e1+e2+e3),9) AS s2, round(e3/(e0+e1+e2+e3),9) AS s3 FROM (SELECT scene, site, {', '.join('exp(CAST(' + ' + '.join(f'({w})*(l{j}-m)' for j, w in enumerate(row)) + f' + ({b}) AS DOUBLE)) AS e{i}' for i, (row, b) in enumerate(zip(_RECAL.coef, _RECAL.intercept)))} FROM (
    SELECT *, (l0+l1+l2+l3)/4 AS m FROM (SELECT scene, site, {', '.join(f'CAST({l} AS DOUBLE) AS l{i}' for i, l in enumerate(_LOGITS))} FROM v_sites)))""")
def _(spark, sf):
    folded = M.fold_recal(_RECAL)
    return V.sites(spark, sf).withColumn("s", folded.proba(F.col("p"))).select("scene", "site", *[F.round(F.col("s")[i], 9).alias(f"s{i}") for i in range(4)])


def _em_sql(prior, iters, floor):
    steps = ["pi0 AS (SELECT " + ", ".join(f"CAST({v} AS DOUBLE) AS x{i}" for i, v in enumerate(prior)) + ")", "pr AS MATERIALIZED (SELECT p0, p1, p2, p3 FROM v_sites)"]
    a = [f"p{i}*(x{i}/{prior[i]})" for i in range(4)]
    s = "(" + "+".join(a) + ")"
    for t in range(iters):
        steps.append(f"pi{t + 1} AS MATERIALIZED (SELECT " + ", ".join(f"m{i}/(m0+m1+m2+m3) AS x{i}" for i in range(4)) + " FROM (SELECT " + ", ".join(f"greatest(avg({a[i]}/{s}),{floor}) AS m{i}" for i in range(4)) + f" FROM pr CROSS JOIN pi{t}))")
    return "WITH " + ", ".join(steps) + " SELECT " + ", ".join(f"round(x{i},6) AS x{i}" for i in range(4)) + f" FROM pi{iters}"


_PRIOR = (0.55, 0.12, 0.15, 0.18)


@query("M12_em_prior", _em_sql(_PRIOR, 20, 0.001))
def _(spark, sf):
    _, pi = C.em_prior(V.sites(spark, sf).select("p"), _PRIOR)
    one = spark.createDataFrame([tuple(pi)], "x0 double, x1 double, x2 double, x3 double")
    return one.select(*[F.round(f"x{i}", 6).alias(f"x{i}") for i in range(4)])


@query("M12_em_adjusted", _em_sql(_PRIOR, 20, 0.001).split(" SELECT round(x0")[0] + " SELECT k, count(*) AS n FROM (SELECT CASE WHEN a0>=greatest(a1,a2,a3) THEN 0 WHEN a1>=greatest(a2,a3) THEN 1 WHEN a2>=a3 THEN 2 ELSE 3 END AS k FROM (SELECT "
       + ", ".join(f"p{i}*(x{i}/{_PRIOR[i]}) AS a{i}" for i in range(4)) + " FROM pr CROSS JOIN pi20)) GROUP BY 1")
def _(spark, sf):
    rows, _ = C.em_prior(V.sites(spark, sf).select("p"), _PRIOR)
    return rows.groupBy(P.argmax(F.col("p")).alias("k")).agg(F.count("*").alias("n"))


def _bias_sql(floor=0.5, rounds=3):
    head = ["ps AS MATERIALIZED (SELECT y, ln(p0) AS l0, ln(p1) AS l1, ln(p2) AS l2, ln(p3) AS l3 FROM v_sites)",
            "s0 AS (SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS b3)"]
    n = 0
    for _ in range(rounds):
        for c in (1, 2, 3):
            cols = ", ".join(f"CASE WHEN g.o >= 0 AND {i} = {c} THEN -3 + 0.25*g.o ELSE b{i} END AS b{i}" for i in range(4))
            head.append(f"""s{n + 1} AS MATERIALIZED (SELECT b0, b1, b2, b3 FROM (SELECT o, b0, b1, b2, b3, CAST(count(*) FILTER (y=k) AS DOUBLE)/count(*) AS acc,
                least(CAST(count(*) FILTER (y=0 AND k=0) AS DOUBLE)/count(*) FILTER (y=0), CAST(count(*) FILTER (y=1 AND k=1) AS DOUBLE)/count(*) FILTER (y=1), CAST(count(*) FILTER (y=2 AND k=2) AS DOUBLE)/count(*) FILTER (y=2),
                CAST(count(*) FILTER (y=3 AND k=3) AS DOUBLE)/count(*) FILTER (y=3)) AS low FROM (SELECT c.*, y, CASE WHEN l0+b0>=greatest(l1+b1,l2+b2,l3+b3) THEN 0 WHEN l1+b1>=greatest(l2+b2,l3+b3) THEN 1 WHEN l2+b2>=l3+b3 THEN 2 ELSE 3 END AS k
                FROM ps CROSS JOIN (SELECT g.o, {cols} FROM s{n} CROSS JOIN range(-1,25) AS g(o)) c) GROUP BY ALL) ORDER BY (low >= {floor}) DESC, CASE WHEN low >= {floor} THEN acc ELSE low END DESC, o LIMIT 1)""")
            n += 1
    return "WITH " + ", ".join(head) + f" SELECT b0, b1, b2, b3 FROM s{n}"


@query("M11_fit_bias", _bias_sql())
def _(spark, sf):
    r = C.fit_bias(V.sites(spark, sf).select("y", "p"))
    return spark.createDataFrame([tuple(r["bias"])], "b0 double, b1 double, b2 double, b3 double")


@query("M17_verdict", """SELECT position, CASE WHEN acc>=base+0.10 AND CAST(a0>=0.75 AS INT)+CAST(a2>=0.75 AS INT)+CAST(a3>=0.75 AS INT)>=2 THEN 'SIGNAL' WHEN acc<=base+0.05 AND greatest(a0,a1,a2,a3)<0.65 THEN 'NO_SIGNAL' ELSE 'PARTIAL' END AS verdict FROM (
    SELECT position, CAST(count(*) FILTER (y=pred_a) AS DOUBLE)/count(*) AS acc, CAST(count(*) FILTER (y=0) AS DOUBLE)/count(*) AS base, avg(p0) FILTER (y=0) AS a0, avg(p1) FILTER (y=1) AS a1, avg(p2) FILTER (y=2) AS a2, avg(p3) FILTER (y=3) AS a3 FROM v_sites GROUP BY 1)""")
def _(spark, sf):
    names = ("no_injury", "wound", "amputation", "not_testable")
    d = V.sites(spark, sf).groupBy("position").agg(A.share_if(F.col("y") == F.col("pred_a")).alias("acc"), A.share_if(F.col("y") == 0).alias("base"), *[F.avg(F.when(F.col("y") == i, F.col(f"p{i}"))).alias(n) for i, n in enumerate(names)])
    return d.select("position", C.verdict(F.col("acc"), F.col("base"), {n: F.col(n) for n in names}).alias("verdict"))
