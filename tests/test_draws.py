"""Bootstrap draws made in tasks are those of the column function."""

import numpy as np
from pyspark.sql import functions as F

from siteval.functions.hashing import poisson_counts, poisson_weights
from siteval.operators.studies import _irls, pod_fits


def test_draws_in_tasks_equal_the_column_function(spark):
    keys = [None, "", "7", "8", "Zoë|1", "x" * 51, "x" * 52, "long " * 40]
    got = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string").select("i", poisson_weights(300, 5, F.col("k")).alias("w")).orderBy("i").collect()
    assert [row.w for row in got] == poisson_counts(300, 5, keys).tolist()


def test_detection_fits_count_every_row_of_a_drawn_group(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), float(s), bool(rng.random() < s / 60)) for g, s in zip(rng.integers(0, 25, 400), rng.integers(1, 50, 400))]
    df = spark.createDataFrame(rows, "g long, s double, hit boolean")
    fits = pod_fits(df, "g", F.col("s"), F.col("hit"), 20, 3)
    assert "Generate" not in fits._jdf.queryExecution().optimizedPlan().toString()
    x = np.array([round(float(np.log(s + 1)), 3) for _, s, _ in rows])
    hit = np.array([h for *_, h in rows], float)
    got = {r.b: (r.slope, r.intercept) for r in fits.collect()}
    assert len(got) == 20
    for b in range(20):
        w = np.array([poisson_counts(20, 3, [str(g)])[0][b] for g, *_ in rows], float)
        at = np.unique(x)
        n, h = (np.array([v[x == a].sum() for a in at]) for v in (w, w * hit))
        assert np.allclose(got[b], _irls(at[n > 0], n[n > 0], h[n > 0]), rtol=1e-6)
