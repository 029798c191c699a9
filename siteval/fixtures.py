"""Evaluation tables derived from the driver's tables.

Each view is a list of stages of (column, SQL expression); the expressions are plain SQL that Spark and DuckDB read alike.
``Spark`` side: ``selectExpr`` over the whole source table. Oracle side: nested SELECTs built from the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteval.runtime import compiled_parts

_SITE_ROWS = ((1, "LUE", 2), (2, "RUE", 1), (3, "LLE", 4), (4, "RLE", 3))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_CLASS_OF = "CASE WHEN {r} <= 10 THEN 0 WHEN {r} <= 13 THEN 1 WHEN {r} <= 16 THEN 2 ELSE 3 END"
_PICK = ("CASE WHEN {a}0 >= {a}1 AND {a}0 >= {a}2 AND {a}0 >= {a}3 THEN 0 WHEN {a}1 >= {a}2 AND {a}1 >= {a}3 THEN 1 "
         "WHEN {a}2 >= {a}3 THEN 2 ELSE 3 END")

_BASE = [
    ("scene", "o_orderkey"), ("cust", "o_custkey"), ("position", "o_orderpriority"), ("facing", "o_orderstatus"),
    ("px", "CAST(ROUND(o_totalprice) AS BIGINT)"), ("k", "k"), ("site", "site"), ("mk", "mk"),
]
_SITES = [
    [("r", "(scene*7 + cust*(2*k+1) + 3*k*k) % 20"), ("rm", "(scene*7 + cust*(2*mk+1) + 3*mk*mk) % 20")],
    [("y", _CLASS_OF.format(r="r")), ("ym", _CLASS_OF.format(r="rm")),
     ("split", "CASE WHEN scene % 3 = 0 THEN 'eval' ELSE 'dev' END")],
    [("g1", "CASE WHEN (scene + 7*k + px) % 5 = 0 THEN -1 WHEN scene % 10 = 0 THEN ym ELSE y END"),
     ("g2", "CASE WHEN (scene + 3*k + px) % 6 = 0 THEN -1 WHEN scene % 15 = 0 THEN ym ELSE y END")],
    [("a0", "1 + px % 7 + CASE WHEN g1=0 THEN 12 ELSE 0 END"), ("a1", "1 + (px+cust) % 5 + CASE WHEN g1=1 THEN 12 ELSE 0 END"),
     ("a2", "1 + (px+scene) % 6 + CASE WHEN g1=2 THEN 12 ELSE 0 END"), ("a3", "1 + (px+k) % 7 + CASE WHEN g1=3 THEN 12 ELSE 0 END"),
     ("b0", "1 + px % 6 + CASE WHEN g2=0 THEN 12 ELSE 0 END"), ("b1", "1 + (px+cust) % 7 + CASE WHEN g2=1 THEN 12 ELSE 0 END"),
     ("b2", "1 + (px+scene) % 5 + CASE WHEN g2=2 THEN 12 ELSE 0 END"), ("b3", "1 + (px+k) % 5 + CASE WHEN g2=3 THEN 12 ELSE 0 END")],
    [(f"{n}{i}", f"CAST({a}{i} AS DOUBLE)/({a}0+{a}1+{a}2+{a}3)") for n, a in (("p", "a"), ("q", "b")) for i in range(4)],
    [("grp", "cust"), ("pred_a", _PICK.format(a="p")), ("pred_b", _PICK.format(a="q")),
     ("vis_px", "px % 3000"), ("wound_px", "CASE WHEN y=1 THEN px % 500 ELSE 0 END"),
     ("stump_px", "CASE WHEN y=2 THEN px % 600 ELSE 0 END"),
     ("wound_px_pred", "CASE WHEN (px+k) % 9 = 0 THEN 0 ELSE CASE WHEN y=1 THEN px % 500 ELSE 0 END END"),
     ("visible_fraction", "CAST((px + 11*k) % 101 AS DOUBLE)/100"), ("tourniquet", "(px + k) % 4 = 0"),
     ("amputated", "y=2"), ("wound_present", "y=1")],
]
SITE_COLUMNS = ["scene", "site", "k", "mk", "split", "position", "facing", "grp", "y", "p0", "p1", "p2", "p3", "q0", "q1", "q2",
                "q3", "pred_a", "pred_b", "vis_px", "wound_px", "stump_px", "wound_px_pred", "visible_fraction", "tourniquet",
                "amputated", "wound_present", "px"]

# Measurements of the predicted map (r_*), of the side-corrected map (s_*) and of the true map (t_*).
_RAW = [
    [("t_vis", "vis_px"), ("t_wound", "wound_px"), ("t_stump", "stump_px"),
     ("r_vis", "CASE WHEN (px+k) % 7 = 0 THEN CAST(FLOOR(vis_px/3) AS BIGINT) ELSE vis_px END"),
     ("r_wound", "CASE WHEN (px + 2*k) % 23 = 0 THEN 30 + px % 90 ELSE wound_px_pred END"),
     ("r_stump", "CASE WHEN (px + 3*k) % 8 = 0 THEN 0 ELSE stump_px END"),
     ("side_fixed", "(scene + k) % 6 = 0"), ("has_side", "scene % 7 <> 0"), ("has_true", "scene % 11 <> 0")],
    [("s_vis", "CASE WHEN side_fixed THEN t_vis ELSE r_vis END"), ("s_wound", "CASE WHEN side_fixed THEN t_wound ELSE r_wound END"),
     ("s_stump", "CASE WHEN side_fixed THEN t_stump ELSE r_stump END")],
    [("lfrac", "CAST(px % 97 AS DOUBLE)/100"), ("bg", "CASE WHEN px % 11 = 0 THEN NULL ELSE CAST(px % 89 AS DOUBLE)/100 END"),
     ("ext_px", "px % 700"), ("tq_px", "CASE WHEN tourniquet THEN 1 + px % 40 ELSE 0 END"), ("torso", "CAST(100 + px % 50 AS DOUBLE)"),
     ("e_bg", "px % 5"), ("e_occ", "px % 3"), ("e_torso", "CAST(FLOOR(px/10) AS BIGINT) % 4"),
     ("e_other", "CAST(FLOOR(px/100) AS BIGINT) % 3"), ("e_edge", "CAST(FLOOR(px/1000) AS BIGINT) % 2"),
     ("amodal", "vis_px + px % 300"), ("psum", "p0 + p2 + p3")],
    [("vom", "CASE WHEN amodal > 0 THEN CAST(vis_px AS DOUBLE)/amodal ELSE 0.0 END"),
     ("cause", "CASE WHEN y=2 AND px % 3 = 0 THEN 'amputated_visible' WHEN y=2 THEN 'amputated_hidden' "
               "WHEN px % 5 = 0 THEN 'occluded' WHEN px % 7 = 0 THEN 'out_of_frame' ELSE 'intact_visible' END")],
]


def _select(df: DataFrame, stages) -> DataFrame:
    for stage in stages:
        df = df.selectExpr("*", *[f"{e} AS {c}" for c, e in stage])
    return df


def _nest(source: str, stages) -> str:
    for stage in stages:
        source = f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in stage)} FROM ({source})"
    return source


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (scene, site) with truth, two models' probabilities ``p`` and ``q``, and measurements."""
    return _site_stages(spark, sf_dir).select(
        *SITE_COLUMNS, F.array("p0", "p1", "p2", "p3").alias("p"), F.array("q0", "q1", "q2", "q3").alias("q"))


def _site_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    compiled_parts(spark)
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("site"), F.lit(m).alias("mk")) for k, s, m in _SITE_ROWS])
    orders = table(spark, sf_dir, "orders").withColumn("_s", F.explode(rows)).selectExpr("*", "_s.k", "_s.site", "_s.mk")
    return _select(orders.selectExpr(*[f"{e} AS {c}" for c, e in _BASE]), _SITES)


def _sealed(df: DataFrame, columns) -> DataFrame:
    """The columns, each derived one behind a condition that always holds and that the optimizer takes for a different one in every row. So expressions over
    a column refer to its value instead of being rewritten into copies of the whole derivation, and a column that a query does not use
    is still pruned down to the scan. Only the record view needs it: the plain site view is left open."""
    return df.select(*[c if c in _PLAIN else F.when(F.monotonically_increasing_id() >= 0, F.col(c)).alias(c) for c in columns])


_PLAIN = ("scene", "site", "k", "mk", "split", "position", "facing", "grp", "px")
_MEASURES = [f"{m}_{c}" for m in "rst" for c in ("vis", "wound", "stump")] + ["lfrac", "bg", "ext_px", "tq_px", "torso", "e_bg", "e_occ", "e_torso", "e_other", "e_edge", "amodal", "psum", "vom", "cause", "has_side", "has_true"]


def raw_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sites`` plus measurement records ``raw`` (predicted), ``raw_side`` and ``raw_true`` as structs.

    The numbers are sealed, the records are built from them where a query uses them: a field of a record is a plain column."""
    df = _sealed(_select(_site_stages(spark, sf_dir), _RAW), [*SITE_COLUMNS, *_MEASURES])
    record = """named_struct('vis_px', {v}_vis, 'Lfrac', lfrac, 'bg_frac', bg,
        'end', map('BG', e_bg, 'OCC', e_occ, 'TORSO', e_torso, 'OTHER_LIMB', e_other, 'EDGE', e_edge),
        'ext_px', ext_px, 'stump_px', {v}_stump, 'torso_ext', torso,
        'p_end', CASE WHEN {v}_vis >= 30 THEN array(p0/psum, p2/psum, p3/psum) END,
        'p_wound', CASE WHEN {v}_vis >= 30 THEN array(1 - p1, p1) END,
        'wound_px', {v}_wound, 'tq_px', tq_px,
        'limb', named_struct('amodal_px', amodal, 'vis_over_amodal', vom, 'term_peak', q0,
                             'p_cause', array(q0, q1, q2, q3, CAST(px % 10 AS DOUBLE)/10)))"""
    return df.selectExpr(
        *SITE_COLUMNS, "array(p0,p1,p2,p3) AS p", "array(q0,q1,q2,q3) AS q", "cause", "has_side", "has_true",
        record.format(v="r") + " AS raw",
        "CASE WHEN has_side THEN " + record.format(v="s") + " END AS raw_side",
        "CASE WHEN has_true THEN " + record.format(v="t") + " END AS raw_true")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel table: scene, position, true and predicted code, owner bits."""
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in _PIXELS])


_PIXELS = [
    ("scene", "l_orderkey"), ("px_id", "l_partkey * 10 + l_linenumber"), ("gt", "l_partkey % 15"),
    ("pred", "CASE WHEN l_suppkey % 7 = 0 THEN (l_partkey + 1) % 15 ELSE l_partkey % 15 END"), ("owner", "l_linenumber"),
    ("visible", "l_suppkey % 3 <> 0"),
]

_ELOG = [
    ("event_id", "event_id"), ("encounter", "user_id"), ("seq", "event_id"),
    ("site_no", "event_id % 4 + 1"),
    ("type", "CASE event_type WHEN 'view' THEN 'site_visibility' WHEN 'click' THEN 'injury' WHEN 'purchase' THEN 'injury' "
             "WHEN 'signup' THEN 'injury' ELSE 'retraction' END"),
    ("injury_class", "CASE event_type WHEN 'click' THEN 'none' WHEN 'purchase' THEN 'amputation' WHEN 'signup' THEN 'other' END"),
    ("visible", "CASE WHEN event_type = 'view' THEN event_id % 3 <> 0 END"),
    ("confidence", "CASE WHEN value/500 > 1 THEN 1.0 ELSE value/500 END"),
    ("supersedes", "CASE WHEN event_type <> 'error' AND event_id % 10 = 0 AND event_id >= 600 THEN event_id - 600 END"),
    ("retracts", "CASE WHEN event_type = 'error' AND event_id >= 1200 THEN event_id - 1200 END"),
]


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only event log: one row per event; supersedes and retracts name earlier events."""
    return table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {c}" for c, e in _ELOG])


_TIMES = [
    ("image_id", "event_id"), ("stage", "event_type"), ("s", "value/100"),
    ("reason", "CASE WHEN event_id % 13 = 0 THEN 'decode: truncated file ' || CAST(event_id AS VARCHAR(20)) "
               "WHEN event_id % 17 = 0 THEN 'timeout: ' || CAST(user_id AS VARCHAR(20)) END"),
    ("predicted", "event_id % 13 <> 0 AND event_id % 17 <> 0"),
]


def run_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {c}" for c, e in _TIMES])


_LOCK = [("name", "p_name || '#' || CAST(p_partkey AS VARCHAR(20)) || '.json'"), ("key", "p_partkey"),
         ("sha", "sha2(p_name || p_brand || p_type || CAST(p_size AS VARCHAR(20)), 256)")]


def manifest_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*[f"{e} AS {c}" for c, e in _LOCK])


def manifest_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lock after drift: every 17th name gone, every 19th changed, every 23rd added again under a new name."""
    lock = manifest_lock(spark, sf_dir)
    kept = lock.filter("key % 17 <> 0").selectExpr("name", "key", "CASE WHEN key % 19 = 0 THEN sha2(sha || 'x', 256) ELSE sha END AS sha")
    added = lock.filter("key % 23 = 0").selectExpr("'new-' || name AS name", "key + 1000000 AS key", "sha")
    return kept.unionByName(added)


_READERS = [
    ("pair", "doc_id"), ("usable_a", "toxic = 0"), ("usable_b", "n_chars > 20"),
    ("a_l", "CASE quality WHEN 1 THEN CASE WHEN n_chars % 3 = 0 THEN 'wound' ELSE 'no_injury' END ELSE 'amputation' END"),
    ("a_r", "CASE WHEN n_chars % 4 = 0 THEN 'wound' WHEN n_chars % 4 = 1 THEN 'unsure' ELSE 'no_injury' END"),
]
_READERS_B = [
    ("b_l", "CASE WHEN n_chars % 5 = 0 THEN a_r WHEN n_chars % 5 = 1 THEN 'not_testable' ELSE a_l END"),
    ("b_r", "CASE WHEN n_chars % 5 = 0 THEN a_l ELSE a_r END"),
]


def readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readers' classes of one left/right pair per labelled document (wide)."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    d = d.selectExpr("n_chars", *[f"{e} AS {c}" for c, e in _READERS])
    return d.selectExpr("*", *[f"{e} AS {c}" for c, e in _READERS_B])


def reader_rows(spark: SparkSession, sf_dir: str, reader: str) -> DataFrame:
    """One reader's labels in long form: photo, site, class, usable."""
    d = readers(spark, sf_dir)
    return d.selectExpr("pair AS photo", f"usable_{reader} AS usable",
                        f"stack(2, 'LUE', {reader}_l, 'RUE', {reader}_r) AS (site, class)")


def _sql(columns, table_name: str) -> str:
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns)} FROM {table_name}"


def _oracle_sites(extra=()) -> str:
    values = ", ".join(f"({k},'{s}',{m})" for k, s, m in _SITE_ROWS)
    base = (f"SELECT {', '.join(f'{e} AS {c}' for c, e in _BASE)} FROM orders CROSS JOIN "
            f"(VALUES {values}) AS s(k, site, mk)")
    return _nest(base, [*_SITES, *extra])


#: name -> SQL of the view, for the oracle
ORACLE_VIEWS = {
    "v_sites": _oracle_sites(),
    "v_raw": _oracle_sites(_RAW),
    "v_pix": _sql(_PIXELS, "lineitem"),
    "v_elog": _sql(_ELOG, "events"),
    "v_times": _sql(_TIMES, "events"),
    "v_lock": _sql(_LOCK, "part").replace("sha2(", "sha256(").replace(", 256)", ")"),
    "v_readers": _nest("SELECT n_chars, " + ", ".join(f"{e} AS {c}" for c, e in _READERS)
                       + " FROM documents JOIN labels USING (doc_id)", [_READERS_B]),
}
ORACLE_VIEWS["v_cur"] = (
    "SELECT name, key, CASE WHEN key % 19 = 0 THEN sha256(sha || 'x') ELSE sha END AS sha FROM v_lock WHERE key % 17 <> 0 "
    "UNION ALL SELECT 'new-' || name, key + 1000000, sha FROM v_lock WHERE key % 23 = 0")
_NEEDS = {"v_cur": ("v_lock",)}


def oracle(sql: str) -> str:
    """Prefix a query with the views it names."""
    wanted = [v for v in ORACLE_VIEWS if v in sql]
    for v in list(wanted):
        wanted = [n for n in _NEEDS.get(v, ()) if n not in wanted] + wanted
    head = ", ".join(f"{v} AS ({ORACLE_VIEWS[v]})" for v in wanted)
    body = sql.strip()
    if not head:
        return body
    return f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"
