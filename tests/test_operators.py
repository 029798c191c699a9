"""Hand-computed tables, skewed inputs and properties."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteval.constants import SITES
from siteval.functions import probs as P
from siteval.functions import stats
from siteval.functions import text as T
from siteval.functions.labels import swap_sites
from siteval.operators import calibration, events, groups, integrity, layer, ledger, metrics, multifit, ordering, pairing, resampling, sites
from siteval.operators.neighbors import nearest_neighbor
from siteval.operators.quantiles import exact_quantiles
from siteval.sources import writers


def onehot(k):
    return [1.0 if i == k else 0.0 for i in range(4)]


def test_quantiles_match_numpy_with_a_hot_group(spark):
    rng = np.random.default_rng(1)
    hot = rng.normal(size=4000).round(2)
    cold = {f"g{i}": rng.normal(size=1 + i) for i in range(12)}
    rows = [("hot", float(v)) for v in hot] + [(g, float(v)) for g, vs in cold.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(8)
    got = {r["g"]: r for r in exact_quantiles(df, F.col("v"), [0.0, 0.025, 0.5, 0.9, 1.0], ["g"], ["a", "b", "c", "d", "e"]).collect()}
    for g, vs in {"hot": hot, **cold}.items():
        want = np.quantile(vs, [0.0, 0.025, 0.5, 0.9, 1.0])
        assert np.allclose([got[g][c] for c in "abcde"], want), g
        assert got[g]["n"] == len(vs)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "v double")
    assert [r["q500"] for r in exact_quantiles(df, F.col("v"), [0.5]).collect()] == [None]


def test_hamming_pairs_against_brute_force(spark):
    rnd = random.Random(3)
    centre = rnd.getrandbits(63)
    sigs = {rnd.getrandbits(63) for _ in range(150)}
    for _ in range(150):                      # a dense group of near copies
        s = centre
        for _ in range(rnd.randint(0, 4)):
            s ^= 1 << rnd.randint(0, 62)
        sigs.add(s)
    df = spark.createDataFrame([(s,) for s in sigs for _ in range(2)], "sig long")
    want = {(min(a, b), max(a, b), bin(a ^ b).count("1")) for a in sigs for b in sigs if a < b and bin(a ^ b).count("1") <= 6}
    got = {tuple(r) for r in groups.hamming_pairs(df, 6).collect()}
    assert got == want
    links = groups.near_links(df, 6)
    assert _components({(a, b) for a, b, _ in want}, sigs) == _components({(r["a"], r["b"]) for r in links.collect()}, sigs)


def _components(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        parent[find(a)] = find(b)
    out = {}
    for n in nodes:
        out.setdefault(find(n), set()).add(n)
    return {frozenset(v) for v in out.values()}


def test_connected_components_on_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5000, 5001)]
    got = {r["node"]: r["root"] for r in groups.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(80)) and got[5001] == 5000


def test_known_pairs_join_groups(spark):
    items = spark.createDataFrame([(1, 0), (2, (1 << 60) - 1), (3, 1)], "id long, sig long")
    known = spark.createDataFrame([(1, 2)], "a long, b long")
    g = {r["id"]: r["grp"] for r in groups.near_duplicate_groups(items, "id", d=3, known=known).collect()}
    assert len(set(g.values())) == 1


def test_sign_test_is_exact(spark):
    cases = [(0, 0), (1, 0), (3, 9), (5, 5), (40, 61), (900, 1100), (0, 20)]
    got = spark.createDataFrame(cases, "a long, b long").select("a", "b", stats.sign_p(F.col("a"), F.col("b")).alias("p")).collect()
    for r in got:
        n = r["a"] + r["b"]
        want = min(1.0, 2 * sum(math.comb(n, i) for i in range(min(r["a"], r["b"]) + 1)) / 2 ** n) if n else 1.0
        assert r["p"] == pytest.approx(want, rel=1e-9)


def test_bad_distributions_are_rejected(spark):
    bad = [[0.5, 0.5, 0.5, 0.0], [float("nan"), 0.0, 0.0, 1.0], [-0.1, 0.6, 0.5, 0.0], [1.0, 0.0, 0.0, None], None]
    rows = spark.createDataFrame([(v,) for v in bad] + [(onehot(2),)], "p array<double>").select(P.check_probs(F.col("p")).alias("ok")).collect()
    assert [r["ok"] for r in rows] == [False] * 5 + [True]


def test_swap_twice_is_identity(spark):
    r = spark.createDataFrame([([1, 2, 3, 4],)], "v array<int>").select(swap_sites(F.col("v")).alias("a"), swap_sites(swap_sites(F.col("v"))).alias("b")).first()
    assert r["a"] == [2, 1, 4, 3] and r["b"] == [1, 2, 3, 4]


def test_ids_are_legal_and_distinct(spark):
    names = ["A B.jpg", "a-b.jpg", "Ünïcode é.PNG", "x" * 300 + ".jpg", "...", "0.jpg"]
    ids = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(T.encounter_id(F.col("n"))).collect()]
    import re
    assert len(set(ids)) == len(names) and all(re.match(r"^[a-z0-9][a-z0-9._:-]{0,63}$", i) for i in ids)


def test_events_round_trip_supersede_and_retract(spark):
    rows = spark.createDataFrame([("x.jpg", s, onehot(0)) for s in SITES], "image_id string, site string, p array<double>")
    log = events.as_log(events.site_events(rows))
    assert {r["y"] for r in events.events_to_classes(log).collect()} == {0}
    enc = log.first()["encounter"]
    cols = "encounter string, site string, event_id string, type string, seq long, visible boolean, injury_class string, supersedes string, retracts string"
    later = spark.createDataFrame([(enc, "LUE", "vis-lue-2", "site_visibility", 1, False, None, "vis-lue", None), (enc, "RLE", "ret-1", "retraction", 1, None, None, None, "inj-rle")], cols)
    got = {r["site"]: r["class"] for r in events.events_to_classes(log.unionByName(later)).collect()}
    assert got["LUE"] == "not_testable" and got["RLE"] == "no_injury"


def test_random_posteriors_round_trip(spark):
    rng = np.random.default_rng(7)
    rows = [(f"s{n}.jpg", s, [float(v) for v in rng.dirichlet(np.ones(4))]) for n in range(100) for s in SITES]
    df = spark.createDataFrame(rows, "image_id string, site string, p array<double>")
    back = events.events_to_classes(events.as_log(events.site_events(df)))
    want = {(T_id, s): int(np.argmax(p)) for T_id, s, p in rows}
    enc = {r["e"]: r["image_id"] for r in df.select("image_id", T.encounter_id(F.col("image_id")).alias("e")).distinct().collect()}
    assert {(enc[r["encounter"]], r["site"]): r["y"] for r in back.collect()} == want


def test_not_testable_site_has_no_injury_event(spark):
    df = spark.createDataFrame([("x.jpg", "LUE", onehot(3))], "image_id string, site string, p array<double>")
    rows = events.site_events(df).collect()
    assert [r["type"] for r in rows] == ["site_visibility"] and rows[0]["visible"] is False and rows[0]["confidence"] == 1.0


def test_empty_split_stops_the_run(spark):
    df = spark.createDataFrame([("dev3", 1)], "split string, y int")
    with pytest.raises(sites.EmptySplit, match="dev3"):
        sites.filter_splits(df, "dev3", "test4")


def test_confusion_sums_to_n_and_f1_variants(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (3, 2)], "y int, pred int")
    assert metrics.confusion(df).agg(F.sum("n")).first()[0] == 4
    r = metrics.macro_f1(df).first()
    f1 = [2 * 1 / 3, 2 * 1 / 3, 0.0, 0.0]
    assert r["macro_f1_either"] == pytest.approx(sum(f1) / 4) and r["macro_f1_truth"] == pytest.approx((f1[0] + f1[1] + f1[3]) / 3)


def test_swaps_count_sites_and_pairs(spark):
    df = spark.createDataFrame([(1, "LUE", 0, 2), (1, "RUE", 2, 0), (1, "LLE", 1, 1), (1, "RLE", 0, 1)], "scene int, site string, y int, pred int")
    r = pairing.laterality_swaps(df).first()
    assert (r["sites"], r["pairs"], r["site_rate"]) == (2, 1, 0.5)
    w = pairing.wrong_side_amputations(df).first()
    assert (w["strict"], w["loose"]) == (1, 1)


def test_severity_and_causes_by_hand(spark):
    raw = "struct<vis_px: long, wound_px: long, stump_px: long>"
    schema = (f"id int, y int, pred int, p array<double>, labels map<string,int>, raw {raw}, raw_true {raw}, wound_visible_px long, kp struct<err_torso: double, side_swap: boolean>, "
              "pred_side int, pred_true_fixed int, pred_true_refit int, swaps map<string,int>")
    rows = [
        (1, 2, 0, [0.9, 0.05, 0.03, 0.02], {"0.00": 2}, (500, 0, 0), (500, 0, 100), 0, None, 0, 2, None, {"end_state": 2, "wound": 0}),      # missed stump, fixed by the true map
        (2, 1, 0, [0.5, 0.3, 0.1, 0.1], {"0.00": 0}, (500, 0, 0), (500, 50, 0), 50, (0.3, False), None, None, None, None),                  # alternate rule agrees
        (3, 1, 1, [0.1, 0.7, 0.1, 0.1], {"0.00": 1}, (500, 5, 0), (500, 90, 0), 90, None, 1, 1, 1, {"wound": 1}),                           # lucky
        (4, 0, 3, [0.1, 0.1, 0.1, 0.7], {"0.00": 0}, (100, 0, 0), (900, 0, 0), 0, None, 0, 3, 3, {"wound": 3}),                             # side fixes it
        (5, 0, 1, [0.2, 0.6, 0.1, 0.1], {"0.00": 0}, (100, 0, 0), (100, 0, 0), 0, None, 1, 1, 1, {"wound": 1}),                             # wrong even on true inputs
        (6, 0, 0, [0.55, 0.4, 0.03, 0.02], {"0.00": 0}, (100, 0, 0), None, 0, None, None, None, None, None),                               # near, right
    ]
    got = {r["id"]: r for r in ledger.with_causes(spark.createDataFrame(rows, schema), ("0.00",)).collect()}
    assert [got[i]["severity"] for i in range(1, 7)] == ["gross", "near", "lucky", "near", "near", "near"]
    assert [got[i]["cause"] for i in range(1, 7)] == ["S", "L", None, "K", "F", None]
    assert got[1]["cause_sub"] == "miss" and got[1]["fixed_by_group"] == ["end_state"]
    assert got[2]["flags"] == ["L", "K-pos", "F"] and got[3]["flags"] == ["K", "S"] and got[6]["flags"] == []


def test_quantile_bins_count_edge_rows_twice(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5)], "v double")
    n = {r["bin"]: r["count"] for r in ordering.quantile_bins(df, F.col("v")).groupBy("bin").count().collect()}
    assert n == {0: 2, 1: 2, 2: 2, 3: 2}


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, s double")
    assert ordering.auc(df, F.col("y") == 1, F.col("s")).first()["auc"] == pytest.approx(0.875)


def test_id_windows_span_bucket_edges(spark):
    # Enough ids for many ranges: groups of 7 neighbours cross the edges of ranges, gaps of 101 end groups and gaps of 100 do not.
    ids, at = [], 0
    for i in range(3000):
        ids.append(at)
        at += 101 if i % 7 == 6 else 100
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    got = {r["id"]: r["grp"] for r in ordering.id_window_groups(df, "id", 100, 2).collect()}
    assert got == {v: ids[i - i % 7] for i, v in enumerate(ids)}
    few = spark.createDataFrame([(i,) for i in (0, 90, 180, 400, 460, 1000)], "id long")
    assert {r["id"]: r["grp"] for r in ordering.id_window_groups(few, "id", 100, 2).collect()} == {0: 0, 90: 0, 180: 0, 400: 400, 460: 400, 1000: 1000}
    assert all(r["dropped"] for r in ordering.id_window_groups(few, "id", 100, 20).collect())


def test_fits_reach_the_same_optimum(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(600, 5))
    y = (X @ rng.normal(size=(5, 4)) + rng.gumbel(size=(600, 4))).argmax(1)
    rows = [([float(v) for v in x], int(c), i % 3, False) for i, (x, c) in enumerate(zip(X, y))]
    df = spark.createDataFrame(rows, "x array<double>, y int, fold int, src boolean").repartition(4).persist()
    for balanced in (False, True):
        many = multifit.fit_many(df, {"m": multifit.Fit(0.3, balanced=balanced)}, 5)["m"]
        one = layer.fit_layer(df, 0.3, balanced=balanced, n=5, max_iter=500, tol=1e-12)
        assert np.allclose(many.coef, one.coef, atol=2e-3) and np.allclose(many.intercept, one.intercept, atol=2e-3)
    best = _objective(many, X, y, 0.3, True)
    for _ in range(50):
        other = layer.Layer(many.mean, many.scale, (np.array(many.coef) + rng.normal(scale=0.01, size=(4, 5))).tolist(), many.intercept, 0.3)
        assert _objective(other, X, y, 0.3, True) >= best - 1e-9


def test_many_fits_share_few_passes_and_end_at_their_optima(spark, monkeypatch):
    rng = np.random.default_rng(6)
    X = rng.normal(size=(4000, 6)) * [1, 10, 0.1, 1, 1, 1] + [1e4, 0, 5, 0, 0, 0]  # a large offset must not spoil the moments
    y = ((X - X.mean(0)) / X.std(0) @ rng.normal(size=(6, 4)) + rng.gumbel(size=(4000, 4))).argmax(1)
    rows = [([float(v) for v in x], int(c), i % 5, False) for i, (x, c) in enumerate(zip(X, y))] + [([float(v) for v in x + 1], int(c), -1, True) for x, c in zip(X[:300], y)]
    df = spark.createDataFrame(rows, "x array<double>, y int, fold int, src boolean").repartition(4).persist()
    monkeypatch.setattr(multifit, "_START_ROWS", 500)
    base = multifit.fit_many(df, {"m": multifit.Fit(0.1)}, 6)["m"]
    fits = {(C, f): multifit.Fit(C, f) for C in (0.003, 0.1, 3.0) for f in (*range(5), None)}
    fits |= {("pool", f): multifit.Fit(0.1, f, source_w=1.0, real_w=10.0) for f in range(5)} | {("recal", f): multifit.Fit(0.1, f, base=base) for f in range(5)}
    log = []
    got = multifit.fit_many(df, fits, 6, log=log)
    assert len(log) <= 30 and all(m.gradient <= multifit.GRADIENT for m in got.values())
    fold = np.arange(4000) % 5
    for C in (0.003, 0.1, 3.0):
        m = got[C, 2]
        own = fold != 2
        assert np.allclose(m.mean, X[own].mean(0)) and np.allclose(m.scale, X[own].std(0), rtol=1e-6)
        best = _objective(m, X[own], y[own], C, False)
        for _ in range(20):
            other = layer.Layer(m.mean, m.scale, (np.array(m.coef) + rng.normal(scale=0.003, size=(4, 6))).tolist(), m.intercept, C)
            assert _objective(other, X[own], y[own], C, False) >= best - 1e-7
    with pytest.raises(ValueError, match="1 labels are missing or outside"):
        multifit.fit_many(spark.createDataFrame([*rows[:50], ([0.0] * 6, None, 0, False)], df.schema), {"m": multifit.Fit(0.1)}, 6)


def _objective(m, X, y, C, balanced):
    Z = (X - np.array(m.mean)) / np.array(m.scale)
    L = Z @ np.array(m.coef).T + np.array(m.intercept)
    L = L - L.max(1, keepdims=True)
    loss = np.log(np.exp(L).sum(1)) - L[np.arange(len(y)), y]
    w = len(y) / (4 * np.bincount(y, minlength=4))[y] if balanced else np.ones(len(y))
    return C * (w * loss).sum() + 0.5 * (np.array(m.coef) ** 2).sum()


def test_folded_recalibration_is_exact(spark):
    rng = np.random.default_rng(2)
    base = layer.Layer([0.1] * 3, [1.5] * 3, rng.normal(size=(4, 3)).tolist(), rng.normal(size=4).tolist(), 0.1)
    recal = layer.Layer([0.0] * 4, [1.0] * 4, rng.normal(size=(4, 4)).tolist(), rng.normal(size=4).tolist(), 0.1, base)
    df = spark.createDataFrame([([float(v) for v in r],) for r in rng.normal(size=(20, 3))], "x array<double>")
    for r in df.select(recal.proba(F.col("x")).alias("a"), layer.fold_recal(recal).proba(F.col("x")).alias("b")).collect():
        assert np.allclose(r["a"], r["b"], atol=1e-9)


def test_nearest_neighbor_is_exact(spark):
    rng = np.random.default_rng(9)
    A, B = rng.normal(size=(40, 8)), np.vstack([rng.normal(size=(60, 8)), np.tile(rng.normal(size=8), (40, 1)) + rng.normal(scale=0.01, size=(40, 8))])
    def frame(m):
        return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], "id long, v array<double>")
    got = {r["id"]: r["best"] for r in nearest_neighbor(frame(A), frame(B), "id", "v", pivots=8).collect()}
    U, W = A / np.linalg.norm(A, axis=1, keepdims=True), B / np.linalg.norm(B, axis=1, keepdims=True)
    assert np.allclose([got[i] for i in range(40)], (U @ W.T).max(1))


def test_bootstrap_interval_covers_accuracy_with_a_hot_group(spark):
    rows = [("hot", 1, int(i % 4 > 0)) for i in range(300)] + [(f"g{i}", 1, int(i % 5 > 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "grp string, y int, pred int")
    r = resampling.bootstrap_ci(df, "grp", replicates=200).first()
    assert r["lo"] <= r["acc"] <= r["hi"]


def test_em_recovers_a_shifted_prior(spark):
    rng = np.random.default_rng(4)
    y = rng.choice(4, 3000, p=[0.3, 0.4, 0.2, 0.1])
    P_ = rng.dirichlet(np.ones(4), 3000) * 0.2
    P_[np.arange(3000), y] += 0.8
    P_ /= P_.sum(1, keepdims=True)
    df = spark.createDataFrame([([float(v) for v in p],) for p in P_], "p array<double>")
    _, pi = calibration.em_prior(df, [0.25] * 4)
    assert abs(pi[1] - 0.4) < 0.05 and sum(pi) == pytest.approx(1)


def test_determinism_check_sees_multiplicity(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "v int")
    b = spark.createDataFrame([(1,), (2,), (2,)], "v int")
    r = integrity.determinism_check(a, b).first()
    assert (r["only_first"], r["only_second"], r["equal"]) == (1, 1, False)
    assert integrity.determinism_check(a, a).first()["equal"]


def test_empty_publish_set_is_refused(spark):
    images = spark.createDataFrame([], "name string, dir string")
    cars = spark.createDataFrame([], "stem string, dir string, generator string, readable boolean")
    assert integrity.guard_verdict(integrity.publish_guard(images, cars)).first()["allowed"] is False


def test_report_writes_large_tables_whole(spark):
    from siteval.sources.writers import markdown_table
    assert len(markdown_table(spark.range(1200)).splitlines()) == 1202


def test_split_is_found_among_many(spark):
    from siteval.operators import sites
    rows = spark.range(12_000).selectExpr("concat('s', id) AS split")
    assert sites.filter_splits(rows, "s11999").count() == 1


def test_rows_of_a_fold_without_layer_stay(spark):
    from siteval.operators.decision import Layer
    from siteval.operators.layer import predict_by_fold
    rows = spark.createDataFrame([(0, [1.0]), (1, [1.0]), (None, [2.0])], "fold int, x array<double>")
    layer = Layer([0.0], [1.0], [[0.0], [0.0]], [0.0, 0.0], 1.0)
    got = {r.fold: r.p for r in predict_by_fold(rows, {0: layer}).collect()}
    assert got == {0: [0.5, 0.5], 1: None, None: None}


def test_arm_scores_pool_rows_over_uneven_folds():
    from siteval.operators.layer import _fold_scores
    found = {("a", 0): (10, 10, 0.0), ("a", 1): (90, 45, 0.0)}
    assert _fold_scores(found, ["a"], 2, "acc") == {"a": 0.75} and _fold_scores(found, ["a"], 2, "acc", pooled=True) == {"a": 0.55}


def test_guard_takes_repeated_sidecars(spark):
    from siteval.operators.integrity import publish_guard
    images = spark.createDataFrame([("S001.png", "d"), ("S002.png", "d")], "name string, dir string")
    cars = spark.createDataFrame([("S001", "d", "g", True), ("S001", "d", "g", False)], "stem string, dir string, generator string, readable boolean")
    got = {r.name: r.reason for r in publish_guard(images, cars, ["e"]).collect()}
    assert got == {"S001.png": "sidecar unreadable", "S002.png": "no generator sidecar"}


def test_poisson_weights_have_mean_and_variance_one(spark):
    from siteval.functions.hashing import poisson_weights
    d = spark.range(40).select(F.explode(poisson_weights(500, 0, F.col("id"))).alias("w"))
    r = d.agg(F.avg("w").alias("m"), F.var_pop("w").alias("v"), F.max("w").alias("top")).first()
    assert abs(r.m - 1) < 0.03 and abs(r.v - 1) < 0.06 and r.top >= 5


def test_id_windows_of_sparse_ids(spark):
    from siteval.operators.ordering import id_window_groups
    ids = [g * 10**12 + i * 50 for g in range(30) for i in range(3)]
    rows = {r.id: (r.grp, r.dropped) for r in id_window_groups(spark.createDataFrame([(i,) for i in ids], "id long"), "id").collect()}
    assert rows == {i: (i // 10**12 * 10**12, False) for i in ids}


def test_predictions_are_validated_before_the_write(spark, tmp_path):
    import os

    from siteval.sources.writers import write_predictions
    sites = "array<struct<body_region:string,laterality:string,injury_type:string>>"
    bad = spark.createDataFrame([("a", [("arm", "left", "no such class")])], f"image_id string, sites {sites}")
    with pytest.raises(ValueError, match="injury_type: 1 images, first a; site count"):
        write_predictions(bad, str(tmp_path / "out"), "team", "a@b", "1")
    assert not os.path.exists(tmp_path / "out")


def test_curvature_comes_from_a_bounded_part_of_the_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    X = rng.normal(size=(3000, 4))
    y = (X @ rng.normal(size=(4, 4)) + rng.gumbel(size=(3000, 4))).argmax(1)
    rows = [([float(v) for v in x], int(c), i % 3, False) for i, (x, c) in enumerate(zip(X, y))]
    df = spark.createDataFrame(rows, "x array<double>, y int, fold int, src boolean").repartition(4).persist()
    monkeypatch.setattr(multifit, "_SHAPE_ROWS", 1000)
    real, whole = multifit._pass, []

    def spied(table, n, partitions, problems, asked, mean, scale):
        if table is df:
            whole.extend(curved for _, curved in asked.values())
        return real(table, n, partitions, problems, asked, mean, scale)

    monkeypatch.setattr(multifit, "_pass", spied)
    got = multifit.fit_many(df, {f: multifit.Fit(0.3, f) for f in (0, 1, 2, None)}, 4)
    assert whole and not any(whole) and all(m.gradient <= multifit.GRADIENT for m in got.values())
    one = layer.fit_layer(df, 0.3, n=4, max_iter=500, tol=1e-12)
    assert np.allclose(got[None].coef, one.coef, atol=2e-3)


def test_prediction_plans_do_not_grow_with_the_features(spark):
    rng = np.random.default_rng(9)

    def table(n):
        rows = [(f, None if f == 4 else [float(v) for v in rng.normal(size=n)]) for f in (0, 1, 2, 3, 4, None) for _ in range(3)]
        layers = {f: layer.Layer(rng.normal(size=n).tolist(), [2.0] * n, rng.normal(size=(4, n)).tolist(), [0.0, 0.1, -0.2, -np.inf], 0.1) for f in (0, 1, 2, 4)}
        return spark.createDataFrame(rows, "fold int, x array<double>"), layers

    sizes = []
    for n in (3, 27):
        d, layers = table(n)
        out = layer.predict_by_fold(d, layers)
        sizes.append(len(out._jdf.queryExecution().optimizedPlan().toString()))
        for r in out.collect():
            if r["fold"] not in (0, 1, 2):
                assert r["p"] is None
            else:
                m = layers[r["fold"]]
                e = np.exp((np.array(r["x"]) - m.mean) / 2 @ np.array(m.coef).T + m.intercept)
                assert np.allclose(r["p"], e / e.sum())
    assert sizes[1] < 1.2 * sizes[0]
