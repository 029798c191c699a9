"""Cosines of very small and very large vectors."""

from siteval.llm import lattice


def test_links_do_not_depend_on_length(spark):
    rows = [(1, [1e-200, 0.0], 1), (2, [1e-200, 0.0], 1), (3, [2e-200, 0.0], 1), (4, [1e200, 0.0], 1), (5, [2e200, 0.0], 1), (6, [0.0, 3e-180], 1), (7, [1e-5, 1e300], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {**{i: (4, 1) for i in range(1, 6)}, 6: (1, 6), 7: (1, 6)}
