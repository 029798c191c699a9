"""Queries of the sources and sinks: tables are written in their stored form and read back whole."""

import re

from pyspark.sql import functions as F

from siteval import fixtures as V
from siteval.catalog import query
from siteval.catalog.event import documents
from siteval.catalog.rows import params, records
from siteval.catalog.scalar import joints_column
from siteval.constants import CLASSES
from siteval.operators import layer as M
from siteval.operators import ledger as L
from siteval.operators import reports as N
from siteval.operators import sites as O
from siteval.catalog.order import ledger_input
from siteval.runtime import scratch_path
from siteval.sources import readers as R
from siteval.sources import workbook as X
from siteval.sources import writers as W


def _names(spark, sf, column="y"):
    return O.nest_sites(V.sites(spark, sf), F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.col(column) + 1), "m")


@query("S1_read_sidecars", "SELECT o_orderkey::VARCHAR AS scene_id, o_orderpriority AS body_position, o_custkey%4=0 AS amputated FROM orders")
def _(spark, sf):
    path = scratch_path(spark, "cars")
    cars = params(spark, sf).select(F.col("scene").cast("string").alias("scene_id"), "params")
    # Every document goes to the folder as one line of a text file named like a sidecar would be.
    cars.write.json(path)
    d = spark.read.schema(R.S.SIDECAR).json(path)
    return d.select("scene_id", "params.body_position", F.map_contains_key("params.amputations", F.lit("RUE")).alias("amputated"))


@query("S2_read_records", "SELECT scene::VARCHAR AS scene, site, r_vis AS vis_px, CASE y WHEN 0 THEN 'no_injury' WHEN 1 THEN 'wound' WHEN 2 THEN 'amputation' ELSE 'not_testable' END AS label FROM v_raw")
def _(spark, sf):
    root = scratch_path(spark, "records")
    r = records(spark, sf).join(_names(spark, sf), "scene")
    r = r.select(F.col("scene").cast("string").alias("scene"), "split", F.create_map(F.lit("0.10"), F.col("m")).alias("labels"), F.transform_values("sites", lambda _, v: v["raw"]).alias("sites"))
    stale = r.withColumn("split", F.lit("stale"))
    stale.write.option("compression", "gzip").json(f"{root}/a")
    r.write.option("compression", "gzip").json(f"{root}/b")
    d = R.read_records(spark, [f"{root}/a", f"{root}/b"])
    d = d.filter("split <> 'stale'").select("scene", "labels", F.explode("sites").alias("site", "m"))
    return d.select("scene", "site", "m.vis_px", F.col("labels")["0.10"][F.col("site")].alias("label"))


@query("S3_read_engine_rows", "SELECT scene || '_v1' AS id, site, r_vis AS vis_px FROM v_raw WHERE scene%5<>0")
def _(spark, sf):
    path = scratch_path(spark, "rows")
    r = records(spark, sf, ["raw"]).select(F.concat(F.col("scene").cast("string"), F.lit("_v1.jpg")).alias("image_id"), F.when(F.col("scene") % 5 != 0, F.transform_values("sites", lambda _, v: v["raw"])).alias("sites"))
    r.write.option("compression", "gzip").json(path)
    return R.read_engine_rows(spark, path).select("id", F.explode("sites").alias("site", "m")).select("id", "site", "m.vis_px")


@query("S4_read_checks", "SELECT scene::VARCHAR AS scene, site, CASE WHEN has_true THEN t_vis END AS vis_px, CASE WHEN scene%2=0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS kp FROM v_raw WHERE split='dev'")
def _(spark, sf):
    path = scratch_path(spark, "checks")
    kp = "named_struct('xy', array(array({v}D, 0D)), 'score', array(0.5D))"
    r = records(spark, sf).select(F.col("scene").cast("string").alias("scene"), "split", F.expr(f"CASE WHEN scene%2=0 THEN {kp.format(v='1')} END").alias("kp"),
                                  F.transform_values("sites", lambda _, v: v["raw"]).alias("pred_sites_ceil"), F.transform_values("sites", lambda _, v: v["raw_true"]).alias("gt_sites_ceil"))
    r.write.option("compression", "gzip").json(path)
    backfill = r.select("scene", F.expr(kp.format(v="2")).alias("kp"))
    d = R.read_checks(spark, path, "gt", "dev", backfill)
    return d.select("scene", F.explode("sites").alias("site", "m"), F.col("kp.xy")[0][0].alias("kp")).select("scene", "site", "m.vis_px", "kp")


@query("S5_read_labels_csv", "SELECT scene || '' AS id, site, CASE WHEN px%9=0 THEN NULL ELSE y END AS y FROM v_sites")
def _(spark, sf):
    path = scratch_path(spark, "labels")
    s = V.sites(spark, sf)
    name = F.when(F.col("px") % 9 == 0, "unsure").otherwise(F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.col("y") + 1))
    s.select(F.concat(F.col("scene").cast("string"), F.lit(".png")).alias("image_id"), "site", name.alias("class")).write.option("header", True).csv(path)
    return R.read_labels(spark, path, "csv")


@query("S5_read_labels_document", "SELECT scene || '' AS id, site, pred_a AS y FROM v_sites")
def _(spark, sf):
    path = scratch_path(spark, "doc")
    docs = documents(spark, sf, "pred_a").withColumn("image_id", F.concat(F.col("image_id").cast("string"), F.lit(".jpg")))
    W.write_rows(docs.withColumn("part", F.pmod(F.xxhash64("image_id"), F.lit(16))).groupBy("part").agg(F.collect_list(F.struct("image_id", "sites")).alias("predictions")).select(
        F.lit("1.0").alias("schema_version"), "predictions"), path)
    rows = spark.read.schema(R.S.PREDICTIONS_DOCUMENT).json(path).select(F.explode("predictions").alias("_p")).select("_p.*")
    return R.from_predictions(rows).select(R.stem(F.col("image_id")).alias("id"), "site", "y")


_AGREED = """SELECT pair AS photo, 'LUE' AS site, CASE WHEN usable_a AND usable_b AND a_l=b_l THEN a_l END AS class FROM v_readers
    UNION ALL SELECT pair, unnest(['RUE', 'LLE']), CASE WHEN usable_a AND usable_b AND a_r=b_r AND a_r<>'unsure' THEN a_r END FROM v_readers
    UNION ALL SELECT pair, 'RLE', CASE WHEN usable_a AND usable_b AND a_l=b_r AND a_l<>'unsure' THEN a_l END FROM v_readers"""


@query("S6_read_labels_two_reader", _AGREED)
def _(spark, sf):
    root = scratch_path(spark, "sheets")
    d = V.readers(spark, sf)
    for r in "ab":
        d.select(F.col("pair").alias("n"), F.when(F.col(f"usable_{r}"), "yes").otherwise("no").alias("usable"), F.lit("full body").alias("framing"), F.lit("sure").alias("side_conf"), F.lit("u").alias("page_url"),
                 F.col(f"{r}_l").alias("LUE_class"), F.col(f"{r}_r").alias("RUE_class"), F.col(f"{r}_r").alias("LLE_class"), F.col("a_l" if r == "a" else "b_r").alias("RLE_class"), *[F.lit("x").alias(c) for c in ("LUE_visible", "RUE_visible", "LLE_visible", "RLE_visible")]).write.option("header", True).csv(f"{root}/{r}")
    return R.read_labels_two_reader(spark, f"{root}/a", f"{root}/b").select(F.col("photo").cast("long").alias("photo"), "site", "class")


@query("S6_workbook_labels", _AGREED)
def _(spark, sf):
    root = scratch_path(spark, "workbooks")
    d = V.readers(spark, sf).withColumn("part", F.floor(F.col("pair") / 500))
    sides = []
    for r, sheet in zip("ab", X.SHEETS):
        other = "a_l" if r == "a" else "b_r"
        values = {"n": F.col("pair").cast("string"), "usable": F.when(F.col(f"usable_{r}"), "yes").otherwise("no"), "LUE_class": F.col(f"{r}_l"), "RUE_class": F.col(f"{r}_r"), "LLE_class": F.col(f"{r}_r"), "RLE_class": F.col(other)}
        sides.append(d.select("part", F.lit(sheet).alias("sheet"), F.col("pair").cast("long").alias("at"), F.array(*[values.get(c, F.lit("x")) for c in X.HEADERS]).alias("cells")))
        sides.append(d.select("part").distinct().select("part", F.lit(sheet).alias("sheet"), F.lit(-1).cast("long").alias("at"), F.array(*[F.lit(h) for h in X.HEADERS.values()]).alias("cells")))
    rows = sides[0]
    for side in sides[1:]:
        rows = rows.unionByName(side)
    X.write_workbooks(rows, root)
    agreed, _ = X.read_workbook_labels(spark, root)
    return agreed.select(F.col("photo").cast("long").alias("photo"), "site", "class")


@query("S8_read_manifest", "SELECT name, sha FROM v_lock")
def _(spark, sf):
    path = scratch_path(spark, "manifest")
    lock = V.manifest_lock(spark, sf)
    lock.select(F.concat_ws("  ", "sha", F.concat(F.lit("dir/"), F.regexp_replace("name", " ", "_"))).alias("value")).write.text(path)
    return R.read_manifest(spark, path).select(F.regexp_replace("name", "_", " ").alias("name"), "sha")


@query("S10_write_ledger", "SELECT split, count(*) AS n FROM v_sites GROUP BY 1")
def _(spark, sf):
    path = scratch_path(spark, "ledger")
    W.write_ledger(L.ledger(ledger_input(spark, sf), ("0.00", "0.25"), "first"), path)
    return spark.read.parquet(path).filter("phase = 'first'").groupBy("split").agg(F.count("*").alias("n"))


@query("S11_write_predictions", "SELECT scene::VARCHAR AS image_id, site, pred_a AS y FROM v_sites")
def _(spark, sf):
    path = scratch_path(spark, "pred")
    W.write_predictions(documents(spark, sf, "pred_a"), path, "team", "a@b", "1")
    rows = spark.read.schema("schema_version string, " + R.S.PREDICTION).json(path)
    return R.from_predictions(rows).select("image_id", "site", "y")


@query("S12_write_report")
def _(spark, sf):
    d = L.with_causes(ledger_input(spark, sf), ("0.00", "0.25"))
    text = W.report("Retrospective", {"Causes": L.cause_pareto(d).orderBy("split", F.desc("total")), "Severity": L.severity_counts(d).orderBy("split", "severity")})
    return spark.createDataFrame([(i, line) for i, line in enumerate(text.splitlines())], "line int, text string")


@query("S13_export_keypoints", """SELECT scene, CAST(count(*) FILTER (vis) AS INT) AS num_keypoints, CAST(max(CASE WHEN i=1 AND vis THEN i*37+px%300 ELSE 0 END) AS DOUBLE) AS lue_shoulder_x, 399 AS "length" FROM (
    SELECT scene, px, i, true AS vis FROM v_sites CROSS JOIN range(1,13) AS r(i) WHERE k=1 AND (px+i)%5<>0) GROUP BY ALL""")
def _(spark, sf):
    col = re.sub(r"\(px \+ (\d+)\) % 4 <> 0\)", r"(px + \1) % 4 <> 0, 'exists', true, 'in_frame', (px + \1) % 5 <> 0)", joints_column())
    d = V.sites(spark, sf).filter("k = 1").selectExpr("scene", f"{col} AS sites")
    out = W.export_keypoints(d, "scene")
    return out.filter("num_keypoints > 0").select("scene", "num_keypoints", F.col("keypoints")[15].alias("lue_shoulder_x"), F.size("keypoints").alias("length"))


@query("S14_layer_round_trip", "SELECT count(*) AS n, count(*) AS same FROM v_sites")
def _(spark, sf):
    path = scratch_path(spark, "layer")
    s = V.sites(spark, sf)
    layer = M.fit_layer(s.select(F.col("p").alias("x"), "y").persist(), 0.3)
    M.export_layer(layer, spark).write.json(path)
    again = M.load_layer(spark.read.schema(M.LAYER_SCHEMA).json(path))
    d = s.select(layer.proba(F.col("p")).alias("a"), again.proba(F.col("p")).alias("b"))
    return d.agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("a")[1] - F.col("b")[1]) < 1e-9).alias("same"))


@query("S15_resume_append", "SELECT o_orderkey AS scene FROM orders WHERE o_orderkey % 4 <> 0")
def _(spark, sf):
    o = V.table(spark, sf, "orders").selectExpr("o_orderkey AS scene")
    return W.resume_append(o, o.filter("scene % 4 = 0"), "scene")


@query("S17_checks_to_records", "SELECT scene, site, r_vis AS vis_px, CASE y WHEN 0 THEN 'no_injury' WHEN 1 THEN 'wound' WHEN 2 THEN 'amputation' ELSE 'not_testable' END AS label FROM v_raw WHERE split='dev'")
def _(spark, sf):
    checks = records(spark, sf, ["raw"]).select("scene", "split", F.transform_values("sites", lambda _, v: v["raw"]).alias("pred_sites_ceil"))
    cars = _names(spark, sf).select(F.col("scene").alias("scene_id"), F.create_map(F.lit("0.10"), F.col("m")).alias("labels_by_threshold"))
    r = O.checks_to_records(checks, cars, "dev")
    return O.explode_sites(r).select("scene", "site", "sites.vis_px", F.col("labels")["0.10"].alias("label"))


@query("A36_file_stats", """SELECT count(*) AS scenes, max(b) AS bytes_max, median(b) AS bytes_median FROM (SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice) AS BIGINT)) AS BIGINT) AS b FROM lineitem GROUP BY 1)""")
def _(spark, sf):
    files = V.table(spark, sf, "lineitem").selectExpr("l_orderkey || '_' || l_linenumber || '.png' AS name", "CAST(ROUND(l_extendedprice) AS BIGINT) AS length")
    return N.file_stats(files, F.regexp_extract("name", r"^(\d+)_", 1))


@query("A29_stage_means", "SELECT event_type AS stage, round(avg(value/100 + CASE WHEN event_id%2=0 THEN 0.5 ELSE 0 END), 6) AS mean, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    d = V.table(spark, sf, "events").selectExpr("map(event_type, value/100) AS t", "CASE WHEN event_id%2=0 THEN map(event_type, 0.5D) ELSE map() END AS t_flip")
    return N.stage_means(d).select("stage", F.round("mean", 6).alias("mean"), "n")
