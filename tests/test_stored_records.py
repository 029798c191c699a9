"""Stored records: compressed on disk, and only the arm that is asked for is read."""

import glob

from siteval.catalog import QUERIES, load
from siteval.sources import readers as R

SF = "/root/testdata/sf0.001"


def stored(spark, name):
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    return {f for f in glob.glob(f"{root}/{name}-*/**", recursive=True) if "/part-" in f}


def test_records_and_checks_are_stored_compressed(spark):
    load()
    for query, name in (("S2_read_records", "records"), ("S4_read_checks", "checks")):
        before = stored(spark, name)
        QUERIES[query](spark, SF)
        written = stored(spark, name) - before
        assert written and all(f.endswith(".json.gz") for f in written)


def test_checks_of_one_arm_leave_the_other_unread(spark, tmp_path):
    lines = ['{"scene": "s1", "split": "dev", "pred_sites_ceil": {"LUE": {"vis_px": 1}}, "gt_sites_ceil": {"LUE": {"vis_px": 2}}}',
             '{"scene": "s1", "split": "dev", "pred_sites_ceil": {"LUE": {"vis_px": 3}}, "gt_sites_ceil": {"LUE": {"vis_px": 4}}}',
             '{"scene": "s2", "split": "test", "pred_sites_ceil": {}, "gt_sites_ceil": {}}']
    (tmp_path / "checks.json").write_text("\n".join(lines) + "\n")
    for arm, other, want in (("pred", "gt", 3), ("gt", "pred", 4)):
        d = R.read_checks(spark, str(tmp_path / "checks.json"), arm, "dev")
        assert [(r.scene, r.sites["LUE"].vis_px) for r in d.collect()] == [("s1", want)]
        assert f"{other}_sites_ceil" not in d._jdf.queryExecution().executedPlan().toString()
