"""The site views: what a plan over them holds, and how their stages are compiled."""

from siteval import fixtures as V

SF = "/root/testdata/sf0.001"


def test_record_view_is_derived_once_whatever_a_filter_names(spark):
    d = V.raw_sites(spark, SF).filter("pred_a <> y AND raw.limb.term_peak < 0.9 AND raw.vis_px >= 30 AND coalesce(raw_true.stump_px, 0) < 300")
    assert d._jdf.queryExecution().optimizedPlan().toString().count("% 20)") <= 4


def test_long_stages_are_compiled_in_parts(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        V.sites(spark, SF)
        assert spark.conf.get(key) == "8000"
        spark.conf.set(key, "20000")
        V.sites(spark, SF)
        assert spark.conf.get(key) == "20000"
    finally:
        spark.conf.set(key, before)


def test_record_view_reads_only_what_a_query_uses(spark):
    plan = V.raw_sites(spark, SF).select("scene", "split").distinct()._jdf.queryExecution().executedPlan().toString()
    assert "o_orderkey" in plan and "o_totalprice" not in plan and "o_custkey" not in plan


def test_fits_read_a_written_design(spark):
    from siteval.catalog.fitting import design

    d = design(spark, SF)
    plan = d.filter("split = 'dev'").select("x", "y")._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan and "% 20)" not in plan
    assert d.count() == V.sites(spark, SF).count()


def test_records_nest_only_the_fields_a_query_uses(spark):
    from siteval.catalog import QUERIES, load

    load()
    plan = QUERIES["S17_checks_to_records"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "raw" in plan and "has_true" not in plan
