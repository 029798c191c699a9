"""Queries of the event log and the prediction documents."""

from pyspark.sql import functions as F

from siteval import fixtures as V
from siteval.catalog import query
from siteval.catalog.pair import documents
from siteval.functions import probs as P
from siteval.operators import documents as D
from siteval.operators import events as E
from siteval.operators import integrity as I
from siteval.operators.reports import requirement_status

_REGION = "CASE WHEN k<=2 THEN 'upper_extremity' ELSE 'lower_extremity' END"
_SIDE = "CASE WHEN k%2=1 THEN 'left' ELSE 'right' END"


def image_rows(spark, sf):
    return V.sites(spark, sf).select(F.concat(F.col("scene").cast("string"), F.lit(".jpg")).alias("image_id"), "scene", "site", "p", "y", F.col("pred_a").alias("pred"))


@query("E1_site_events", f"""WITH b AS (SELECT *, left(scene || '.jpg', 40) || '-' || left(sha1(scene || '.jpg'), 8) AS encounter, greatest(p0,p1,p2,p3) AS top, {_REGION} AS body_region, {_SIDE} AS laterality FROM v_sites)
    SELECT encounter, site, body_region, laterality, 'vis-' || lower(site) AS event_id, 'site_visibility' AS type, 'present' AS assertion, pred_a<>3 AS visible, NULL::VARCHAR AS injury_class,
      CAST(round(CASE WHEN pred_a<>3 THEN 1-p3 ELSE p3 END * 10000) AS BIGINT) AS conf FROM b
    UNION ALL SELECT encounter, site, body_region, laterality, 'inj-' || lower(site), 'injury', CASE WHEN pred_a=0 THEN 'absent' ELSE 'present' END, NULL, CASE pred_a WHEN 2 THEN 'amputation' WHEN 1 THEN 'other' ELSE 'none' END, CAST(round(top*10000) AS BIGINT) FROM b WHERE pred_a<>3""")
def _(spark, sf):
    ev = E.site_events(image_rows(spark, sf))
    return ev.select("encounter", "site", "body_region", "laterality", "event_id", "type", "assertion", "visible", "injury_class", F.round(F.col("confidence") * 10000).cast("long").alias("conf"))


@query("E1_state_events", """SELECT view_of, CASE WHEN view_of='unknown' THEN 'unknown' ELSE 'present' END AS assertion, count(*) AS n, round(max(conf), 4) AS top FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'anterior' WHEN 'O' THEN 'posterior' ELSE 'unknown' END AS view_of,
    CASE WHEN o_orderstatus IN ('F','O') THEN CAST(o_custkey%100 AS DOUBLE)/100 ELSE 0 END AS conf FROM orders) GROUP BY ALL""")
def _(spark, sf):
    img = V.table(spark, sf, "orders").selectExpr("o_orderkey AS image_id", "CASE o_orderstatus WHEN 'F' THEN 'front' WHEN 'O' THEN 'back' END AS facing", "CAST(o_custkey%100 AS DOUBLE)/100 AS facing_conf")
    return E.state_events(img).groupBy("view_of", "assertion").agg(F.count("*").alias("n"), F.round(F.max("confidence"), 4).alias("top"))


@query("E1_rejected_probs", "SELECT scene AS image_id, site FROM v_sites WHERE px % 21 = 0")
def _(spark, sf):
    d = V.sites(spark, sf).select(F.col("scene").alias("image_id"), "site", F.when(F.col("px") % 21 == 0, F.array(*[F.lit(0.5)] * 4)).otherwise(F.col("p")).alias("p"))
    return E.rejected_probs(d)


_LIVE = """live AS (SELECT e.* FROM v_elog e WHERE e.type <> 'retraction' AND NOT EXISTS (SELECT 1 FROM v_elog x WHERE x.encounter=e.encounter AND (x.supersedes=e.event_id OR x.retracts=e.event_id)))"""


@query("E2_live_events", f"WITH {_LIVE} SELECT event_id, encounter, type FROM live")
def _(spark, sf):
    return E.live_events(V.event_log(spark, sf)).select("event_id", "encounter", "type")


@query("E2_events_to_classes", f"""WITH {_LIVE}, p AS (SELECT encounter, site_no, arg_max(CAST(visible AS INT), seq) FILTER (type='site_visibility') AS v, arg_max(injury_class, seq) FILTER (type='injury') AS c FROM live GROUP BY ALL)
    SELECT encounter, site_no, CASE WHEN coalesce(v,0)=0 THEN 3 WHEN c='amputation' THEN 2 WHEN c='other' THEN 1 ELSE 0 END AS y FROM p""")
def _(spark, sf):
    return E.events_to_classes(V.event_log(spark, sf), ("encounter", "site_no")).select("encounter", "site_no", "y")


@query("E3_round_trip_check", "SELECT count(*) AS sites, CAST(0 AS BIGINT) AS mismatches FROM v_sites")
def _(spark, sf):
    d = image_rows(spark, sf).select("scene", "site", "pred", F.transform("p", lambda v: F.round(v, 3)).alias("p"))
    return E.round_trip_check(d)


@query("E4_event_counts", "SELECT type, count(*) AS n FROM v_elog GROUP BY 1")
def _(spark, sf):
    return E.event_counts(V.event_log(spark, sf))


@query("E5_to_predictions", f"""SELECT scene AS image_id, string_agg({_REGION} || ':' || {_SIDE} || '=' || ['no_injury','wound','amputation','not_testable'][pred_a+1], ';' ORDER BY k) AS sites FROM v_sites GROUP BY 1""")
def _(spark, sf):
    d = documents(spark, sf, "pred_a")
    return d.select("image_id", F.array_join(F.transform("sites", lambda s: F.concat(s["body_region"], F.lit(":"), s["laterality"], F.lit("="), s["injury_type"])), ";").alias("sites"))


@query("E5_from_predictions", "SELECT scene AS image_id, site, pred_a AS y FROM v_sites")
def _(spark, sf):
    return D.from_predictions(documents(spark, sf, "pred_a")).select("image_id", "site", "y")


@query("E6_fallback_fill", """SELECT scene AS image_id, site, CASE WHEN scene%17=0 OR scene%13=0 OR px%31=0 THEN 0 ELSE pred_a END AS pred, CASE WHEN scene%17=0 THEN 'missing' WHEN scene%13=0 THEN 'decode: truncated' WHEN px%31=0 THEN 'not a distribution' END AS reason FROM v_sites""")
def _(spark, sf):
    s = V.sites(spark, sf)
    got = s.filter("scene % 17 <> 0").select(F.col("scene").alias("image_id"), "site", F.expr("CASE WHEN scene%13=0 THEN NULL WHEN px%31=0 THEN array(0.9D,0.9D,0.0D,0.0D) ELSE p END").alias("p"),
                                             F.expr("CASE WHEN scene%13=0 THEN 'decode: truncated' END").alias("reason"))
    expected = V.table(spark, sf, "orders").selectExpr("o_orderkey AS image_id")
    return D.fallback_fill(expected, got, 0)


@query("E7_fallback_class", "SELECT y AS fallback FROM v_sites GROUP BY 1 ORDER BY count(*) DESC, y LIMIT 1")
def _(spark, sf):
    return spark.range(1).select(D.fallback_class(V.sites(spark, sf)).alias("fallback"))


@query("V1_validate_predictions", """SELECT image_id, problem FROM (SELECT o_orderkey AS image_id, unnest(list_filter([CASE WHEN o_orderkey%11=0 THEN 'schema_version' END, CASE WHEN o_orderkey%7=0 THEN 'submission.email' END, CASE WHEN o_orderkey%13=0 THEN 'site count' END,
      CASE WHEN o_orderkey%13=0 THEN 'site set' END, CASE WHEN o_orderkey%5=0 THEN 'injury_type' END], lambda x: x IS NOT NULL)) AS problem FROM (SELECT o_orderkey FROM orders WHERE o_orderkey%19<>0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey%23=0))
    UNION ALL SELECT o_orderkey, 'duplicate image_id' FROM orders WHERE o_orderkey%23=0 AND o_orderkey%19<>0 UNION ALL SELECT o_orderkey, 'missing' FROM orders WHERE o_orderkey%19=0 AND o_orderkey%23<>0
    UNION ALL SELECT o_orderkey, 'extra' FROM orders WHERE o_orderkey%29=0 AND (o_orderkey%19<>0 OR o_orderkey%23=0)""")
def _(spark, sf):
    d = documents(spark, sf, "pred_a")
    sites = F.expr("CASE WHEN image_id%13=0 THEN slice(sites, 1, 3) ELSE sites END")
    sites = F.when(F.col("image_id") % 5 == 0, F.transform(sites, lambda s: s.withField("injury_type", F.lit("bruise")))).otherwise(sites)
    d = d.select("image_id", sites.alias("sites"), F.expr("CASE WHEN image_id%11=0 THEN '0.9' ELSE '1.0' END").alias("schema_version"), F.lit("t").alias("team_name"), F.lit("1").alias("version"), F.expr("CASE WHEN image_id%7<>0 THEN 'a@b' END").alias("email"))
    both = d.filter("image_id % 19 <> 0").unionByName(d.filter("image_id % 23 = 0"))
    return D.validate_predictions(both, V.table(spark, sf, "orders").filter("o_orderkey % 29 <> 0 OR (o_orderkey % 19 = 0 AND o_orderkey % 23 <> 0)").selectExpr("o_orderkey AS image_id"))


@query("V5_requirement_counts", """SELECT status, count(*) AS n FROM (SELECT CASE WHEN bool_or(o_orderstatus='F') THEN 'FAILED' WHEN bool_or(o_orderstatus='P') THEN 'OPEN' ELSE 'VERIFIED' END AS status FROM orders GROUP BY o_custkey%30) GROUP BY 1""")
def _(spark, sf):
    t = V.table(spark, sf, "orders").selectExpr("concat('case[M1_', lpad(o_custkey%30, 2, '0'), ']') AS name", "CASE o_orderstatus WHEN 'F' THEN 'fail' WHEN 'P' THEN 'skip' ELSE 'pass' END AS outcome")
    return requirement_status(t, [f"M1-{i:02d}" for i in range(30)]).groupBy("status").agg(F.count("*").alias("n"))


@query("S9_list_inputs", """SELECT lower(regexp_extract(name, '([.][^./]+)$', 1)) IN ('.jpg','.jpeg','.png','.bmp','.tif','.tiff','.webp') AS is_image, count(*) AS n FROM (SELECT p_name || CASE p_partkey%5 WHEN 0 THEN '.JPG' WHEN 1 THEN '.txt' WHEN 2 THEN '.png' WHEN 3 THEN '' ELSE '.jpeg.bak' END AS name FROM part) GROUP BY 1""")
def _(spark, sf):
    d = V.table(spark, sf, "part").selectExpr("p_name || CASE p_partkey%5 WHEN 0 THEN '.JPG' WHEN 1 THEN '.txt' WHEN 2 THEN '.png' WHEN 3 THEN '' ELSE '.jpeg.bak' END AS name")
    return I.split_images(d).groupBy("is_image").agg(F.count("*").alias("n"))


@query("E_confidence_bounds", "SELECT count(*) AS events, count(*) FILTER (confidence < 0 OR confidence > 1) AS outside FROM v_elog")
def _(spark, sf):
    d = V.event_log(spark, sf)
    return d.agg(F.count("*").alias("events"), F.count_if((F.col("confidence") < 0) | (F.col("confidence") > 1)).alias("outside"))


@query("E_break_ties", "SELECT count(*) AS n, count(*) AS kept FROM v_sites")
def _(spark, sf):
    d = V.sites(spark, sf).select("pred_a", E.break_ties(F.transform("p", lambda v: F.round(v, 2)), F.col("pred_a")).alias("p"))
    return d.agg(F.count("*").alias("n"), F.count_if(P.argmax(F.col("p")) == F.col("pred_a")).alias("kept"))
