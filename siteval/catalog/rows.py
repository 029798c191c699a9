"""Queries of the row-level operators: sources in record form, predicates, label rules."""

from pyspark.sql import functions as F

from siteval import fixtures as V
from siteval.catalog import query
from siteval.constants import SITES
from siteval.functions import labels as L
from siteval.functions import rules as R
from siteval.functions import text as T
from siteval.operators import sites as O

_PER_SITE = ("raw", "raw_true", "y", "visible_fraction", "amputated", "wound_present", "wound_px", "stump_px", "cause", "tourniquet")


def records(spark, sf, fields=_PER_SITE):
    """Scene records (labels by rule, site maps of measurements) nested from the site view. What is nested is shuffled whole, so a query that
    uses some fields only names them."""
    rows = V.raw_sites(spark, sf)
    return O.nest_sites(rows, F.struct(*fields), "sites", ("scene", "split", "grp", "position", "facing"))


_RULE_SQL = """
  CASE WHEN NOT (CASE WHEN {cut} = 0 THEN visible_fraction > 0 ELSE visible_fraction >= {cut} END) THEN 3
       WHEN amputated THEN CASE WHEN '{amp}' = 'any' OR stump_px >= 20 OR cause = 'amputated_visible' THEN 2 ELSE 3 END
       WHEN wound_present AND ('{wound}' = 'present' OR wound_px >= 20) THEN 1 ELSE 0 END"""
_RULES_SQL = " UNION ALL ".join(
    f"SELECT scene, site, '{n}' AS rule, {_RULE_SQL.format(cut=c, wound=w, amp=a)} AS y FROM v_raw"
    for n, c, w, a in (("v3_compat", 0.10, "visible", "any"), ("guide_primary", 0, "visible", "observable"),
                       ("guide_wound_present", 0, "present", "observable"), ("guide_amp_any", 0, "visible", "any")))


@query("P1_explode_sites", "SELECT scene, split, site, r_vis AS vis_px, r_wound AS wound_px, y FROM v_raw")
def _(spark, sf):
    rows = O.explode_sites(records(spark, sf), ("sites",), None)
    return rows.select("scene", "split", "site", "sites.raw.vis_px", "sites.raw.wound_px", "sites.y")


@query("P2_apply_label_rules", _RULES_SQL)
def _(spark, sf):
    return O.apply_label_rules(V.raw_sites(spark, sf))


_THR = """CASE WHEN NOT (CASE WHEN c = 0 THEN visible_fraction > 0 ELSE visible_fraction >= c END) THEN 3 WHEN amputated THEN 2
          WHEN wound_present{extra} THEN 1 ELSE 0 END"""
_THR_SQL = (f"SELECT scene, site, lpad(CAST(CAST(c AS DECIMAL(4,2)) AS VARCHAR), 4, '0') AS cut, {_THR.format(extra=' AND wound_px >= 20')} AS label, "
            f"{_THR.format(extra='')} AS label_if_present FROM v_raw CROSS JOIN (VALUES (0.0), (0.10), (0.25), (0.50)) AS t(c)")


@query("P3_labels_by_threshold", _THR_SQL)
def _(spark, sf):
    return _threshold_rows(V.raw_sites(spark, sf))


def _threshold_rows(truth):
    keep = ("scene", "site", "visible_fraction", "amputated", "wound_present", "wound_px")
    seen = O.labels_by_threshold(truth, keep=keep).withColumnRenamed("labels", "seen")
    both = O.labels_by_threshold(seen, keep=("scene", "site", "seen"), wound_if_present=True)
    return (both.select("scene", "site", "labels", F.explode("seen").alias("cut", "label"))
            .select("scene", "site", "cut", "label", F.col("labels")[F.col("cut")].alias("label_if_present")))


@query("P4_relabel", """SELECT scene, site, CASE WHEN scene % 2 = 0 THEN 3 - y ELSE y END AS headline, y AS other FROM v_sites""")
def _(spark, sf):
    rows = V.sites(spark, sf)
    stored = O.nest_sites(rows, F.col("y"), "by_site").select(
        "scene", F.create_map(F.lit("0.10"), F.col("by_site"), F.lit("0.50"), F.col("by_site")).alias("labels"))
    new = O.nest_sites(rows.filter("scene % 2 = 0"), (F.lit(3) - F.col("y")), "new_labels")
    out = O.relabel(stored, new, "0.10")
    return out.select("scene", F.explode(F.col("labels")["0.10"]).alias("site", "headline"), "labels").select(
        "scene", "site", "headline", F.col("labels")["0.50"][F.col("site")].alias("other"))


_PARAMS = """named_struct(
    'wounds', map_from_entries(filter(array(struct('LUE' AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'burn' END AS v),
                                            struct('RLE' AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'laceration' END AS v)), e -> e.v IS NOT NULL)),
    'amputations', map_from_entries(filter(array(struct('RUE' AS k, CASE WHEN o_custkey % 4 = 0 THEN 'distal' END AS v)), e -> e.v IS NOT NULL)),
    'tourniquets', CASE WHEN o_custkey % 6 = 0 THEN array('LUE', 'LLE') ELSE array() END,
    'occluder', CASE o_orderstatus WHEN 'F' THEN 'blanket' WHEN 'O' THEN 'none' ELSE 'gear_bag' END,
    'occ_target', CASE WHEN o_orderkey % 7 = 0 THEN 'limb_end' END, 'body_position', o_orderpriority,
    'garments', named_struct('top', CASE o_custkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'long' END,
                             'bottom', CASE WHEN o_orderkey % 4 = 0 THEN 'none' ELSE 'shorts' END))"""


def params(spark, sf):
    """Scene parameters (struct with maps and arrays) derived from orders."""
    return V.table(spark, sf, "orders").selectExpr("o_orderkey AS scene", f"{_PARAMS} AS params",
                                                   "CASE WHEN o_custkey % 10 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS facing_true")


@query("P5_derive_clothed", """SELECT clothed, count(*) AS n FROM (SELECT
    NOT ((o_custkey % 3 <> 1) AND (o_orderkey % 4 = 0)) AS clothed FROM orders) GROUP BY 1""")
def _(spark, sf):
    g = F.col("params.garments")
    return params(spark, sf).select(L.clothed(g["top"], g["bottom"]).alias("clothed")).groupBy("clothed").agg(F.count("*").alias("n"))


@query("P6_truth_context", """SELECT o_orderkey AS scene, s.site, (s.site='LUE' AND o_orderkey%3=0) OR (s.site='RLE' AND o_orderkey%5=0) AS wound_true,
    s.site='RUE' AND o_custkey%4=0 AS amputation_true, s.site IN ('LUE','LLE') AND o_custkey%6=0 AS tourniquet_true,
    CASE o_orderstatus WHEN 'F' THEN 'blanket' WHEN 'O' THEN 'none' ELSE 'gear_bag' END AS occluder, o_orderkey%7=0 AS occluder_at_end,
    CASE WHEN o_custkey%10=0 THEN NULL WHEN o_orderkey%2=0 THEN 'front' ELSE 'back' END AS view
    FROM orders CROSS JOIN (VALUES ('LUE'),('RUE'),('LLE'),('RLE')) AS s(site)""")
def _(spark, sf):
    rows = params(spark, sf).select("*", F.explode(F.array(*[F.lit(s) for s in SITES])).alias("site"))
    return O.truth_context(rows).select("scene", "site", "wound_true", "amputation_true", "tourniquet_true", "occluder", "occluder_at_end", "view")


@query("P7_filter_splits", "SELECT split, site, count(*) AS n FROM v_sites WHERE split IN ('dev','eval') GROUP BY ALL")
def _(spark, sf):
    return O.filter_splits(V.sites(spark, sf), "dev", "eval").groupBy("split", "site").agg(F.count("*").alias("n"))


@query("P8_hand_rule", """SELECT site, call, count(*) AS n FROM (SELECT site, CASE WHEN r_vis < 30 THEN 3 WHEN p2/psum > 0.5 THEN 2
    WHEN p1 > 0.5 OR r_wound >= 20 THEN 1 ELSE 0 END AS call FROM v_raw) GROUP BY ALL""")
def _(spark, sf):
    r = F.col("raw")
    rows = V.raw_sites(spark, sf).select("site", R.hand_rule(r["vis_px"], r["p_end"], r["p_wound"], r["wound_px"]).alias("call"))
    return rows.groupBy("site", "call").agg(F.count("*").alias("n"))


@query("P9_rule_area", """SELECT call, y, count(*) AS n FROM (SELECT y, CASE WHEN r_vis < 30 THEN 3 WHEN bg >= 0.60 AND lfrac < 0.75 THEN 2
    WHEN lfrac >= 0.10 THEN 0 ELSE 3 END AS call FROM v_raw) GROUP BY ALL""")
def _(spark, sf):
    r = F.col("raw")
    return (V.raw_sites(spark, sf).select("y", R.rule_area(r["vis_px"], r["bg_frac"], r["Lfrac"]).alias("call"))
            .groupBy("call", "y").agg(F.count("*").alias("n")))


@query("P10_rule_presence", """SELECT presence, stump, absence, count(*) AS n FROM (SELECT presence, CASE WHEN r_vis >= 30 AND r_stump >= 30 THEN 2 ELSE presence END AS stump,
      CASE WHEN r_vis < 30 THEN 3 WHEN q2 > 0.5 THEN 2 WHEN lfrac >= 0.10 THEN 0 ELSE 3 END AS absence
    FROM (SELECT *, CASE WHEN r_vis < 30 THEN 3 WHEN ext_px >= 50 THEN CASE WHEN lfrac >= 0.10 THEN 0 ELSE 3 END
      WHEN bg >= 0.60 THEN 2 WHEN lfrac >= 0.10 THEN 0 ELSE 3 END AS presence FROM v_raw)) GROUP BY ALL""")
def _(spark, sf):
    r = F.col("raw")
    present = r["ext_px"] >= 50
    rows = V.raw_sites(spark, sf).select(
        R.rule_presence(r["vis_px"], r["bg_frac"], r["Lfrac"], present).alias("presence"),
        R.rule_stump_override(r["vis_px"], r["bg_frac"], r["Lfrac"], present, r["stump_px"]).alias("stump"),
        R.rule_absence(r["vis_px"], r["Lfrac"], F.col("q2") > 0.5).alias("absence"))
    return rows.groupBy("presence", "stump", "absence").agg(F.count("*").alias("n"))


def joints4(x="px % 700", y="px % 500"):
    return [f"named_struct('x', CAST({x} + {i}*40 - 60 AS DOUBLE), 'y', CAST({y} + {i}*30 - 40 AS DOUBLE), 'conf', p{i})" for i in range(4)]


@query("P11_rule_keypoints", """SELECT call, y, count(*) AS n FROM (SELECT y, CASE
      WHEN NOT ((p0>=0.2 AND in0) OR (p1>=0.2 AND in1) OR (p2>=0.2 AND in2) OR (p3>=0.2 AND in3)) THEN 3
      WHEN p0>=0.2 AND in0 AND in3 AND p3 < 0.3 THEN 2 ELSE 0 END AS call FROM (SELECT *,
      px%700-60>=0 AND px%700-60<640 AND px%500-40>=0 AND px%500-40<480 AS in0, px%700-20>=0 AND px%700-20<640 AND px%500-10>=0 AND px%500-10<480 AS in1,
      px%700+20>=0 AND px%700+20<640 AND px%500+20>=0 AND px%500+20<480 AS in2, px%700+60>=0 AND px%700+60<640 AND px%500+50>=0 AND px%500+50<480 AS in3
      FROM v_sites)) GROUP BY ALL""")
def _(spark, sf):
    rows = V.sites(spark, sf).selectExpr("y", f"array({', '.join(joints4())}) AS j")
    return (rows.select("y", R.rule_keypoints(F.col("j"), 0.2, 0.3, 640, 480).alias("call")).groupBy("call", "y").agg(F.count("*").alias("n")))


@query("P12_reading", """SELECT as_labeled, threshold, count(*) AS n FROM (SELECT CASE WHEN a_r <> 'unsure' THEN a_r END AS as_labeled,
    CASE WHEN a_r = 'unsure' THEN NULL WHEN n_chars % 7 = 0 THEN 'not_testable' ELSE a_r END AS threshold FROM v_readers) GROUP BY ALL""")
def _(spark, sf):
    d = V.readers(spark, sf).withColumn("vis", F.expr("CASE WHEN n_chars % 7 = 0 THEN 'under 10%' ELSE 'over 50%' END"))
    return (d.select(L.reading(F.col("a_r"), F.col("vis")).alias("as_labeled"), L.reading(F.col("a_r"), F.col("vis"), "threshold").alias("threshold"))
            .groupBy("as_labeled", "threshold").agg(F.count("*").alias("n")))


@query("P13_usable_filter", """SELECT count(*) AS n, count(DISTINCT pair) AS photos FROM v_readers WHERE usable_a AND n_chars % 2 = 0""")
def _(spark, sf):
    both_passes = F.expr("n_chars % 2 = 0")
    return V.readers(spark, sf).filter(F.col("usable_a") & both_passes).agg(F.count("*").alias("n"), F.countDistinct("pair").alias("photos"))


@query("P14_mirror_sites", """SELECT a.scene, a.site, b.site AS mirror, b.y AS swapped
    FROM v_sites a JOIN v_sites b ON a.scene = b.scene AND a.mk = b.k""")
def _(spark, sf):
    rec = O.nest_sites(V.sites(spark, sf), F.col("y"), "m").select("scene", L.swap_sites(F.array(*[F.col("m")[s] for s in SITES])).alias("sw"))
    rows = rec.select("scene", F.posexplode("sw").alias("i", "swapped"))
    site = F.element_at(F.array(*[F.lit(s) for s in SITES]), F.col("i") + 1)
    return rows.select("scene", site.alias("site"), "swapped").select("scene", "site", L.mirror_site(F.col("site")).alias("mirror"), "swapped")


CONDITION_COLUMNS = dict(
    sleeve="CASE px % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'long' ELSE 'short' END", boots="px % 5 = 0 AND k > 2",
    at_end="px % 7 = 0", occluder="CASE facing WHEN 'F' THEN 'blanket' WHEN 'O' THEN 'none' ELSE 'gear_bag' END")


def with_conditions(df):
    d = df.selectExpr("*", *[f"{e} AS {c}" for c, e in CONDITION_COLUMNS.items()])
    return d.withColumn("conditions", R.confuser_conditions(
        F.col("tourniquet"), F.col("px") % 6 == 0, F.col("amputated"), F.col("y"), F.col("sleeve"), F.col("boots"), F.col("at_end"),
        F.col("visible_fraction"), F.col("stump_px"), F.col("occluder")))


CONDITION_SQL = """(SELECT *, unnest(list_filter([
      'all', CASE WHEN tourniquet THEN 'tourniquet_on_limb' END, CASE WHEN tourniquet AND px%6=0 AND y=0 THEN 'tourniquet_and_hidden_wound' END,
      CASE WHEN NOT tourniquet AND px%6=0 AND y=0 THEN 'hidden_wound_no_tq' END,
      CASE WHEN NOT tourniquet AND px%6<>0 AND NOT amputated THEN 'no_tq_no_wound_true' END,
      CASE WHEN px%3=1 THEN 'sleeve_or_trouser_long' END, CASE WHEN px%3=0 THEN 'bare_limb' END, CASE WHEN px%5=0 AND k>2 THEN 'boots' END,
      CASE WHEN px%7=0 THEN 'occluder_aimed_at_limb_end' END,
      CASE WHEN visible_fraction<0.5 AND stump_px=0 THEN 'foreshortened_vf<0.5_no_stump' END,
      'occluder=' || CASE facing WHEN 'F' THEN 'blanket' WHEN 'O' THEN 'none' ELSE 'gear_bag' END], lambda x: x IS NOT NULL)) AS condition FROM v_sites)"""


@query("P15_confuser_conditions", f"SELECT condition, count(*) AS n, CAST(sum(y) AS BIGINT) AS sum_y FROM {CONDITION_SQL} GROUP BY 1")
def _(spark, sf):
    d = with_conditions(V.sites(spark, sf)).select(F.explode("conditions").alias("condition"), "y")
    return d.groupBy("condition").agg(F.count("*").alias("n"), F.sum("y").alias("sum_y"))


@query("P16_affected_scenes", """SELECT o_orderkey AS scene FROM orders WHERE (o_orderkey%3=0 OR o_orderkey%5=0)
    AND NOT ((o_custkey%3<>1) AND (o_orderkey%4=0))""")
def _(spark, sf):
    return params(spark, sf).filter(O.affected_scenes(F.col("params"))).select("scene")


@query("P17_policy_deny", """SELECT denied, count(*) AS n FROM (SELECT lower(p_name || ' ' || CASE p_size % 10 WHEN 0 THEN 'ArcFace-r50'
      WHEN 1 THEN 'person_ReID' ELSE p_brand END) SIMILAR TO '.*(arcface|facenet|insightface|face_recognition|reid|re-id|person_reid|deepface|vggface|adaface).*'
      AS denied FROM part) GROUP BY 1""")
def _(spark, sf):
    parts = V.table(spark, sf, "part").selectExpr("array(p_name, CASE p_size % 10 WHEN 0 THEN 'ArcFace-r50' WHEN 1 THEN 'person_ReID' ELSE p_brand END) AS c")
    return parts.select(T.policy_denied(F.col("c")).alias("denied")).groupBy("denied").agg(F.count("*").alias("n"))


@query("J1_attach_counterfactuals", """SELECT scene, site, r_vis AS vis_px, CASE WHEN has_side THEN s_vis END AS side_px,
    CASE WHEN has_true THEN t_vis END AS true_px FROM v_raw""")
def _(spark, sf):
    rows = V.raw_sites(spark, sf)
    side = rows.filter("has_side").select("scene", "site", "raw_side")
    truth = rows.filter("has_true").select("scene", "site", "raw_true")
    out = O.attach_counterfactuals(rows.select("scene", "site", "raw"), side, truth)
    return out.select("scene", "site", "raw.vis_px", F.col("raw_side.vis_px").alias("side_px"), F.col("raw_true.vis_px").alias("true_px"))


@query("J2_attach_sidecar", """SELECT scene, site, y, CASE WHEN o_orderkey IS NOT NULL THEN o_orderpriority END AS body_position
    FROM v_sites LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 9 <> 0) ON o_orderkey = scene""")
def _(spark, sf):
    cars = params(spark, sf).filter("scene % 9 <> 0").select("scene", "params.body_position")
    return O.attach_sidecar(V.sites(spark, sf).select("scene", "site", "y"), cars)


@query("J3_design", """SELECT scene AS id, site, CASE WHEN scene % 5 = 0 THEN scene ELSE grp END AS grp, y, round(ln(1+r_vis), 9) AS x0, round(q3, 9) AS x_last,
    NULL::DOUBLE AS flip0 FROM v_raw WHERE y <> 3""")
def _(spark, sf):
    base = V.raw_sites(spark, sf)
    rows = O.nest_sites(base, F.col("raw"), "sites", ("scene",)).select(F.col("scene").alias("id"), "sites")
    flips = O.nest_sites(base.filter("has_side"), F.col("raw_side"), "sites_flip", ("scene",)).withColumnRenamed("scene", "id")
    labels = base.select(F.col("scene").alias("id"), "site", F.expr("CASE WHEN y < 3 THEN y END").alias("y"))
    groups = V.table(spark, sf, "orders").filter("o_orderkey % 5 <> 0").selectExpr("o_orderkey AS id", "o_custkey AS grp")
    d = O.design(rows.join(flips, "id", "left"), labels, groups)
    return d.select("id", "site", "grp", "y", F.round(F.col("x")[0], 9).alias("x0"), F.round(F.col("x")[25], 9).alias("x_last"), F.col("x_flip")[0].alias("flip0"))


@query("J8_context_features", """SELECT a.scene, a.site, round(ln(1+a.r_vis),9) AS own0, round(ln(1+b.r_vis),9) AS mirror0, o.v AS other_lfrac,
    CAST(a.k <= 2 AS DOUBLE) AS upper, CAST(a.site[1]='L' AS DOUBLE) AS left_side
    FROM v_raw a JOIN v_raw b ON a.scene=b.scene AND a.mk=b.k JOIN (SELECT scene, k<=2 AS up, max(lfrac) AS v FROM v_raw GROUP BY ALL) o
    ON o.scene=a.scene AND o.up = (a.k>2)""")
def _(spark, sf):
    x = O.features(V.raw_sites(spark, sf), "raw")
    c = O.context_features(x, "x", 19)
    v = F.col("context")
    return c.select("scene", "site", F.round(v[0], 9).alias("own0"), F.round(v[19], 9).alias("mirror0"), v[39].alias("other_lfrac"),
                    v[57].alias("upper"), v[59].alias("left_side"))


@query("D4_records_nested", """SELECT split, count(DISTINCT scene) AS scenes, count(*) AS sites, CAST(sum(r_vis) AS BIGINT) AS vis FROM v_raw GROUP BY 1""")
def _(spark, sf):
    rec = records(spark, sf)
    return rec.select("split", "scene", F.size("sites").alias("k"), F.expr("aggregate(map_values(sites), 0L, (a, v) -> a + v.raw.vis_px)").alias("v")).groupBy(
        "split").agg(F.count("*").alias("scenes"), F.sum("k").cast("long").alias("sites"), F.sum("v").alias("vis"))

