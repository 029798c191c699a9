"""Queries of the parameter sampler, over ids that come from the orders table."""

from pyspark.sql import functions as F

from siteval import fixtures as V
from siteval.catalog import query
from siteval.constants import SITES
from siteval.functions.hashing import uniform
from siteval.operators import sampler as S

_U = "(CAST('0x' || substr(md5({x}),1,13) AS UBIGINT) / 4503599627370496.0)"


def ids(spark, sf):
    return V.table(spark, sf, "orders").selectExpr("o_orderkey AS id")


@query("X1_quota_mix", """SELECT id, CASE WHEN r <= a THEN 'none' WHEN r <= a+b THEN 'blanket' WHEN r <= a+2*b THEN 'gear_bag' WHEN r <= a+3*b THEN 'strap' WHEN r <= a+4*b THEN 'medic_arm' ELSE 'none' END AS occluder FROM (
    SELECT o_orderkey AS id, row_number() OVER (ORDER BY md5('7|occluder|' || o_orderkey)) AS r, round_even(count(*) OVER () * 0.4::DOUBLE, 0) AS a, round_even(count(*) OVER () * 0.15::DOUBLE, 0) AS b FROM orders)""")
def _(spark, sf):
    return S.quota_mix(ids(spark, sf), "id", S.OCCLUDER_MIX, "occluder", 7)


@query("X2_cycle", "SELECT o_orderkey AS id, ['supine','prone','left_lateral','right_lateral','semi_seated'][o_orderkey%5+1] AS body_position, [85,60,45,30,15][o_orderkey%5+1] AS elevation FROM orders")
def _(spark, sf):
    return ids(spark, sf).select("id", S.cycle(F.col("id"), S.POSITIONS).alias("body_position"), S.cycle(F.col("id"), S.ELEVATIONS).alias("elevation"))


@query("X3_categorical", f"""SELECT id, CASE WHEN u < 0.15 THEN 'none' WHEN u < 0.15+0.25 THEN 'shorts' ELSE 'long' END AS bottom, v < CASE WHEN u >= 0.15+0.25 THEN 0.5 ELSE 0.25 END AS boots FROM (
    SELECT o_orderkey AS id, {_U.format(x="'1|bottom|' || o_orderkey")} AS u, {_U.format(x="'1|boots|' || o_orderkey")} AS v FROM orders)""")
def _(spark, sf):

    d = ids(spark, sf).withColumn("bottom", S.categorical(S.BOTTOM_MIX, 1, "bottom", F.col("id")))
    return d.withColumn("boots", uniform(1, "boots", F.col("id")) < F.when(F.col("bottom") == "long", 0.5).otherwise(0.25))


@query("X4_choose_k", """SELECT id, string_agg(s, ',' ORDER BY h) AS sites FROM (SELECT o_orderkey AS id, o_orderkey%3 AS k, s, md5('2|pick|' || o_orderkey || '|' || s) AS h, row_number() OVER (PARTITION BY o_orderkey ORDER BY md5('2|pick|' || o_orderkey || '|' || s)) AS r
    FROM orders CROSS JOIN (VALUES ('LUE'),('RUE'),('LLE'),('RLE')) AS t(s)) WHERE r <= k GROUP BY 1""")
def _(spark, sf):
    d = ids(spark, sf).withColumn("s", S.choose_k(F.array(*[F.lit(s) for s in SITES]), (F.col("id") % 3).cast("int"), 2, "pick", F.col("id")))
    return d.filter(F.size("s") > 0).select("id", F.array_join("s", ",").alias("sites"))


@query("X5_paired_scenarios", """SELECT 'P' || lpad(CAST(p+1 AS VARCHAR),2,'0') AS pair, m AS member, occluder, amputation, count(*) AS n FROM (SELECT o_orderkey%10 AS p, m, CASE WHEN o_orderkey%10=2 AND m='a' THEN 'medic_arm' WHEN o_orderkey%10=3 AND m='a' THEN 'gear_bag' ELSE 'none' END AS occluder,
    CASE o_orderkey%10 WHEN 0 THEN CASE WHEN m='b' THEN 'RLE:below_joint' END WHEN 1 THEN CASE WHEN m='b' THEN 'LUE:below_joint' END WHEN 3 THEN 'RUE:below_joint' WHEN 8 THEN CASE WHEN m='a' THEN 'LUE:below_joint' ELSE 'RUE:below_joint' END WHEN 9 THEN 'LLE:above_joint' END AS amputation
    FROM orders CROSS JOIN (VALUES ('a'),('b')) AS t(m)) GROUP BY ALL""")
def _(spark, sf):
    return S.paired_scenarios(ids(spark, sf)).groupBy("pair", "member", "occluder", "amputation").agg(F.count("*").alias("n"))


def full_params(spark, sf, seed=3):
    return S.wound_params(S.base_params(ids(spark, sf), seed=seed), seed=seed)


@query("X6_base_params")
def _(spark, sf):
    d = full_params(spark, sf)
    return d.groupBy("occluder", "framing").agg(F.count("*").alias("n"), F.sum(F.size("amputations")).alias("amputations"), F.sum(F.size("wounds")).alias("wounds"), F.sum(F.size("tourniquets")).alias("tourniquets"))


@query("X6_closeup_mix")
def _(spark, sf):
    d = S.closeup_mix(full_params(spark, sf), seed=3)
    return d.groupBy("framing").agg(F.count("*").alias("n"), F.count("closeup_site").alias("closeups"), F.count("blood_smear").alias("smears"), F.avg("closeup_dist").alias("mean_dist"))


@query("X6_challenge_mix", """SELECT ['treatment_cue_without_visible_injury','tq_no_wound','hidden_wound','occluded_end','crossing_limbs'][o_orderkey%5+1] AS confuser, count(*) AS n, count(*) FILTER (o_orderkey%5<>4) AS with_site FROM orders GROUP BY 1""")
def _(spark, sf):
    d = S.challenge_mix(full_params(spark, sf), seed=3)
    return d.groupBy("confuser").agg(F.count("*").alias("n"), F.count("confuser_site").alias("with_site"))


@query("X7_mix_shape")
def _(spark, sf):
    return S.mix_shape(S.scene_mix(full_params(spark, sf), seed=3))


@query("X7_mix_bounds", "SELECT unnest(['supine','alone','known_view','closeup','stray_pool']) AS name, true AS ok")
def _(spark, sf):
    return S.mix_shape(S.scene_mix(full_params(spark, sf), seed=3)).select("name", "ok")


@query("X8_stratified_set", """SELECT block, count(*) AS n, count(*) FILTER (amp='none') AS none, count(*) FILTER (amp='double') AS double, count(DISTINCT pos) AS positions FROM (SELECT o_orderkey//20 AS block, o_orderkey%5 AS pos,
    CASE WHEN r<=8 THEN 'none' WHEN r<=16 THEN 'single' ELSE 'double' END AS amp FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey//20 ORDER BY md5('20|amputation_kind|' || o_orderkey)) AS r FROM orders)) GROUP BY 1""")
def _(spark, sf):
    d = S.stratified_set(ids(spark, sf))
    return d.groupBy("block").agg(F.count("*").alias("n"), F.count_if(F.col("amputation_kind") == "none").alias("none"), F.count_if(F.col("amputation_kind") == "double").alias("double"), F.countDistinct("body_position").alias("positions"))


@query("X8_stratified_coverage")
def _(spark, sf):
    d = S.stratified_set(ids(spark, sf))
    return d.groupBy("block").agg(*[F.countDistinct(c).alias(c) for c in ("body_position", "limb_pose", "azimuth", "elevation", "framing", "occluder")])
