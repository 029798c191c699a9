"""Prediction documents: building, reading, completing, validating and scoring them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteval.constants import CLASSES, SITE_BODY, SITES
from siteval.functions import probs as P
from siteval.functions.labels import class_index, class_name, clothed
from siteval.operators import metrics as M
from siteval.operators.quantiles import with_scalars
from siteval.operators.reports import constant_accuracy
from siteval.operators.resampling import metric_intervals
from siteval.runtime import case, lookup


def body_of(site: Column) -> tuple[Column, Column]:
    return lookup(site, {s: r for s, (r, _) in SITE_BODY.items()}), lookup(site, {s: l for s, (_, l) in SITE_BODY.items()})


def site_of(region: Column, laterality: Column) -> Column:
    return case([((region == r) & (laterality == l), s) for s, (r, l) in SITE_BODY.items()])


def to_predictions(rows: DataFrame, key: str = "image_id", pred: str = "pred") -> DataFrame:
    """One record per image with its four sites in output order. Four rows per key, so the list is bounded."""
    region, side = body_of(F.col("site"))
    order = lookup(F.col("site"), {s: i for i, s in enumerate(SITES)})
    item = F.struct(order.alias("_o"), region.alias("body_region"), side.alias("laterality"), class_name(F.col(pred)).alias("injury_type"))
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_s"))
    return grouped.select(key, F.transform("_s", lambda s: F.struct(s["body_region"].alias("body_region"), s["laterality"].alias("laterality"), s["injury_type"].alias("injury_type"))).alias("sites"))


def from_predictions(docs: DataFrame, key: str = "image_id") -> DataFrame:
    """Site rows (key, site, class, y) of prediction records; unknown classes give a NULL index."""
    rows = docs.select(key, F.explode("sites").alias("_s"))
    return rows.select(key, site_of(F.col("_s.body_region"), F.col("_s.laterality")).alias("site"), F.col("_s.injury_type").alias("class"),
                       class_index(F.col("_s.injury_type")).alias("y"))


def fallback_fill(expected: DataFrame, got: DataFrame, fallback: int | Column, key: str = "image_id", bias=None) -> DataFrame:
    """Every expected (key, site) gets a class: the decided one, or the fallback with a reason.

    got: key, site, p (NULL when the image failed), reason. A left join makes dropping an input impossible."""
    wanted = expected.select(key, F.explode(F.array(*[F.lit(s) for s in SITES])).alias("site"))
    j = wanted.join(got.select(key, "site", "p", F.col("reason").alias("_why")), [key, "site"], "left")
    ok = P.check_probs(F.col("p"))
    reason = F.when(ok, None).otherwise(F.coalesce(F.col("_why"), F.when(F.col("p").isNull(), "missing").otherwise("not a distribution")))
    fb = fallback if isinstance(fallback, Column) else F.lit(fallback)
    return j.select(key, "site", F.when(ok, P.decide(F.col("p"), bias)).otherwise(fb).alias("pred"), reason.alias("reason"))


def fallback_class(df: DataFrame, y: str = "y") -> Column:
    """Majority class of the labels, as a scalar column."""
    return M.majority_baseline(df, y).select("majority").scalar()


def validate_predictions(docs: DataFrame, expected: DataFrame | None = None, version: str = "1.0", key: str = "image_id") -> DataFrame:
    """Violations as (key, problem). docs: schema_version, team_name, version, email, key, sites.

    Record-level problems come from one pass; duplicates, missing and extra ids from one full join of distinct ids."""
    sites = F.col("sites")
    got = F.array_sort(F.transform(sites, lambda s: F.concat_ws(":", s["body_region"], s["laterality"])))
    want = F.array(*[F.lit(v) for v in sorted(":".join(b) for b in SITE_BODY.values())])
    checks = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("schema_version") == version, F.lit(False)), F.lit("schema_version")),
        *[F.when(F.col(c).isNull(), F.lit(f"submission.{c}")) for c in ("team_name", "version", "email")],
        F.when(F.col(key).isNull(), F.lit("image_id missing")),
        F.when(F.coalesce(F.size(sites), F.lit(0)) != 4, F.lit("site count")),
        F.when(~F.coalesce(got == want, F.lit(False)), F.lit("site set")),
        F.when(F.exists(sites, lambda s: ~F.coalesce(s["injury_type"].isin(*CLASSES), F.lit(False))), F.lit("injury_type"))))
    found = docs.select(key, F.explode(checks).alias("problem"))
    ids = docs.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    found = found.unionByName(ids.filter("_n > 1").select(key, F.lit("duplicate image_id").alias("problem")))
    if expected is not None:
        j = expected.select(key).distinct().withColumn("_e", F.lit(True)).join(ids, key, "full")
        gap = F.when(F.col("_n").isNull(), "missing").when(F.col("_e").isNull(), "extra")
        found = found.unionByName(j.select(key, gap.alias("problem")).filter("problem IS NOT NULL"))
    return found


def evaluate_documents(pred: DataFrame, truth: DataFrame, key: str = "image_id", groups: DataFrame | None = None, replicates: int = 500, seed: int = 0) -> DataFrame:
    """Metrics and mean cost over the ids in both documents, with the number of truth ids that have no prediction.

    With ``groups`` (key, grp) also the bootstrap intervals of accuracy, macro F1 and cost over whole groups; an id without a group is one
    by itself."""
    p = from_predictions(pred, key).select(key, "site", F.col("y").alias("pred"))
    t = from_predictions(truth, key).select(key, "site", "y")
    missing = truth.select(key).distinct().join(pred.select(key), key, "left_anti").agg(F.count(F.lit(1))).scalar()
    both = t.join(p, [key, "site"])
    cost = M.cost_per_site(both).select("cost").scalar()
    out = M.score_metrics(both).select("*", cost.alias("cost"), missing.alias("missing_images"))
    if groups is None:
        return out
    own = groups.select(key, F.concat(F.lit("g|"), F.col("grp").cast("string")).alias("_g"))
    grouped = both.join(own, key, "left").withColumn("_g", F.coalesce("_g", F.concat(F.lit("i|"), F.col(key).cast("string"))))
    found = metric_intervals(grouped, "_g", replicates=replicates, seed=seed)
    wide = found.agg(*[F.max(F.when(F.col("metric") == m, F.col(e))).alias(f"{m}_{e}") for m in ("acc", "macro_f1", "cost") for e in ("lo", "hi")])
    return with_scalars(out, wide, wide.columns)


def score_document(pred: DataFrame, sidecars: DataFrame, threshold: str, wound_rule: str = "visible", key: str = "image_id") -> DataFrame:
    """A document against sidecar labels under a threshold and wound rule, overall and by clothing, beside the constant answer.

    sidecars: key, labels_by_threshold, labels_wound_if_present (threshold -> site -> class), params.garments."""
    column = {"visible": "labels_by_threshold", "present": "labels_wound_if_present"}[wound_rule]
    g = F.col("params.garments")
    cars = sidecars.select(key, F.col(column)[threshold].alias("_l"), clothed(g["top"], g["bottom"]).alias("_c"))
    rows = from_predictions(pred, key).withColumnRenamed("y", "pred").join(cars, key)
    rows = rows.select("pred", class_index(F.col("_l")[F.col("site")]).alias("y"), F.explode(F.array(F.lit("all"), F.when(F.col("_c"), "clothed").otherwise("unclothed"))).alias("subset"))
    return constant_accuracy(rows, by=("subset",))
