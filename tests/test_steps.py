"""Steps of long expressions: each is written once, however many places use it."""

from pyspark.sql import functions as F

from siteval.constants import JOINTS, KEYPOINTS
from siteval.functions.features import chain_length
from siteval.functions.geometry import kp_error
from siteval.operators.quantiles import exact_quantiles
from siteval.sources.writers import export_keypoints


def _times(d, text: str) -> int:
    return d._jdf.queryExecution().analyzed().toString().count(text)


def _xy():
    """Joints 30 apart along x, none for n = 0."""
    return F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(0), F.lit(22)), lambda i: F.array((i * F.col("n")).cast("double"), F.lit(0.0))))


def test_no_task_sorts_a_group_of_quantiles(spark):
    rows = spark.range(0, 1001, 1, 4).select(F.when(F.col("id") % 2 == 0, "a").alias("g"), F.col("id").cast("double").alias("v"))
    d = exact_quantiles(rows, F.col("v"), [0.5], ("g",), ["m"])
    assert {r.g: (r.n, r.m) for r in d.collect()} == {"a": (501, 500.0), None: (500, 500.0)}
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan


def test_chain_length_reads_its_keypoints_once(spark):
    d = spark.createDataFrame([(3,), (0,)], "n int").select("n", chain_length(_xy(), "LUE").alias("length"))
    a, b, c = KEYPOINTS["LUE"]
    assert {r.n: r.length for r in d.collect()} == {3: 3.0 * (abs(a - b) + abs(b - c)), 0: 0.0}
    assert _times(d, "sequence(") == 1


def test_kp_error_reads_its_inputs_once(spark):
    def truth(site, dx):
        points = [F.struct((F.lit(float(i * 30)) + dx).alias("x"), F.lit(0.0).alias("y"), F.lit(True).alias("visible")) for i in KEYPOINTS[site]]
        return F.lit(site), F.create_map(*[v for joint, p in zip(JOINTS[site[1:]], points) for v in (F.lit(joint), p)])

    joints = F.create_map(*[v for site in ("LUE", "RUE", "LLE", "RLE") for v in truth(site, F.lit(6.0))])
    d = spark.createDataFrame([(30,), (0,)], "n int").select("n", kp_error(_xy(), F.transform(F.array(*[F.lit(1.0)] * 23), lambda v: v * F.col("n")), joints, "LUE").alias("e"))
    got = {r.n: r.e for r in d.collect()}
    torso = abs((KEYPOINTS["LUE"][0] + KEYPOINTS["RUE"][0]) / 2 - (KEYPOINTS["LLE"][0] + KEYPOINTS["RLE"][0]) / 2) * 30
    assert abs(got[30].err_torso - 6.0 / torso) < 1e-12 and got[30].n_joints == 3 and not got[30].side_swap
    assert got[0] is None and _times(d, "sequence(") == 1


def test_exported_keypoints_are_looked_up(spark):
    point = F.struct(F.col("n").cast("double").alias("x"), F.lit(2.0).alias("y"), F.lit(True).alias("exists"), F.lit(True).alias("in_frame"), (F.col("n") > 4).alias("visible"))
    sites = F.create_map(F.lit("LUE"), F.create_map(F.lit(JOINTS["UE"][0]), point, F.lit(JOINTS["UE"][1]), point.withField("exists", F.lit(False))))
    d = export_keypoints(spark.createDataFrame([(3,), (5,)], "n int").select(F.col("n").alias("scene_id"), sites.alias("sites")))
    for r in d.collect():
        k = KEYPOINTS["LUE"][0]
        want = [0.0] * len(r.keypoints)
        want[3 * k : 3 * k + 3] = [float(r.scene_id), 2.0, 2.0 if r.scene_id > 4 else 1.0]
        assert r.keypoints == want and r.num_keypoints == 1
    assert _times(d, "filter(") <= 2
