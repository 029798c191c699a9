"""Ties of the predicted class, and how often their steps are worked out."""

from pyspark.sql import functions as F

from siteval.operators.events import break_ties


def test_break_ties_works_every_step_out_once(spark):
    rows = [(1, [0.4, 0.4, 0.1, 0.1], 1), (2, [0.4, 0.4, 0.1, 0.1], 2), (3, [0.5, 0.3, 0.1, 0.1], 0), (4, [0.25] * 4, 3), (5, [0.2, None, 0.2, 0.1], 2), (6, None, 0), (7, [0.4, 0.4, 0.1, 0.1], None)]
    d = spark.createDataFrame(rows, "id int, p array<double>, pred int").select("id", break_ties(F.col("p"), F.col("pred")).alias("p"))
    got = {r.id: r.p for r in d.collect()}
    n = 1 + 1e-6
    assert got[1] == [0.4 / n, (0.4 + 1e-6) / n, 0.1 / n, 0.1 / n]
    assert got[2] == [0.4, 0.4, 0.1, 0.1] and got[3] == [0.5, 0.3, 0.1, 0.1]
    assert got[4] == [0.25 / n] * 3 + [(0.25 + 1e-6) / n]
    assert got[5] == [None] * 4 and got[6] is None
    assert got[7] == [0.4, 0.4, 0.1, 0.1]
    assert d._jdf.queryExecution().analyzed().toString().count("greatest(") == 1
