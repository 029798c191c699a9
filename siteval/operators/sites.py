"""From scene records to the site table, and the row-level operators on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteval.constants import LABEL_RULES, LABEL_THRESHOLDS, SITES
from siteval.functions.features import limb_features, site_features
from siteval.functions.labels import class_index, class_name, rule_class, rules_array, threshold_class


def explode_sites(records: DataFrame, site_maps=("sites",), labels: str | None = "labels", keep=("scene", "split")) -> DataFrame:
    """One row per (scene, site). Each name in ``site_maps`` is a map site -> struct; ``labels`` is rule -> site -> class."""
    def of(site):
        fields = [F.lit(site).alias("site")]
        fields += [F.col(m)[site].alias(m) for m in site_maps]
        if labels:
            fields.append(F.transform_values(labels, lambda _, by_site: by_site[site]).alias(labels))
        return F.struct(*fields)

    rows = records.select(*keep, F.explode(F.array(*[of(s) for s in SITES])).alias("_r"))
    return rows.select(*keep, "_r.*")


def nest_sites(sites: DataFrame, value: Column, name: str, keys=("scene",)) -> DataFrame:
    """The reverse: one record per scene with a map site -> value (at most four entries per scene)."""
    return sites.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("site"), value.alias("v")))).alias(name))


def apply_label_rules(truth: DataFrame, rules: dict = LABEL_RULES, keep=("scene", "site")) -> DataFrame:
    """Class of every site under every rule: (…, rule, y). Needs visible_fraction, amputated, stump_px, cause,
    wound_present, wound_px."""
    rows = truth.withColumn("_r", F.explode(rules_array(rules)))
    y = rule_class(F.col("visible_fraction"), F.col("amputated"), F.col("stump_px"), F.col("cause"), F.col("wound_present"),
                   F.col("wound_px"), F.col("_r.cut"), F.col("_r.wound_rule"), F.col("_r.amp_rule"))
    return rows.select(*keep, F.col("_r.rule").alias("rule"), y.alias("y"))


def labels_by_threshold(truth: DataFrame, cuts=LABEL_THRESHOLDS, keep=("scene", "site"), wound_if_present: bool = False) -> DataFrame:
    """Class of every site at every visibility cut-off, as a map cut -> class index."""
    entries = []
    for c in cuts:
        entries += [F.lit(f"{c:.2f}"), threshold_class(F.col("visible_fraction"), F.col("amputated"), F.col("wound_present"),
                                                       F.col("wound_px"), F.lit(float(c)), wound_if_present)]
    return truth.select(*keep, F.create_map(*entries).alias("labels"))


def relabel(records: DataFrame, new: DataFrame, rule: str, on=("scene",), labels: str = "labels", value: str = "new_labels") -> DataFrame:
    """Replace the stored labels of one rule where new ones exist; everything else is untouched."""
    merged = F.map_concat(F.map_filter(labels, lambda k, _: k != rule), F.create_map(F.lit(rule), F.col(value)))
    joined = records.join(new, list(on), "left")
    return joined.withColumn(labels, F.when(F.col(value).isNotNull(), merged).otherwise(F.col(labels))).drop(value)


def truth_context(df: DataFrame, params: str = "params", facing: str = "facing_true") -> DataFrame:
    """Membership flags of a site in its scene parameters."""
    p = F.col(params)

    def in_map(field):
        return F.coalesce(F.map_contains_key(p[field], F.col("site")), F.lit(False))

    return df.select("*", in_map("wounds").alias("wound_true"), in_map("amputations").alias("amputation_true"),
                     F.coalesce(F.array_contains(p["tourniquets"], F.col("site")), F.lit(False)).alias("tourniquet_true"),
                     p["occluder"].alias("occluder"), F.coalesce(p["occ_target"] == "limb_end", F.lit(False)).alias("occluder_at_end"),
                     p["body_position"].alias("body_position"),
                     F.when(F.col(facing) == 1, "front").when(F.col(facing) == -1, "back").alias("view"))


class EmptySplit(ValueError):
    """A split filter matched nothing."""


def filter_splits(df: DataFrame, dev: str, evaluation: str | None = None, column: str = "split") -> DataFrame:
    """Keep two splits; refuse when either is empty, naming some of the splits that exist. Only the wanted ones are counted."""
    wanted = [s for s in (dev, evaluation) if s]
    kept = df.filter(F.col(column).isin(*wanted))
    present = {r[0] for r in kept.select(column).distinct().collect()}
    for name in wanted:
        if name not in present:
            others = sorted(r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().limit(20).collect())
            raise EmptySplit(f"no rows in split {name!r}; splits present: {others}")
    return kept


def attach_counterfactuals(sites: DataFrame, side: DataFrame, truth: DataFrame, on=("scene", "site")) -> DataFrame:
    """Left equi-joins to the side-corrected and the true extraction; what is missing stays NULL."""
    return sites.join(side, list(on), "left").join(truth, list(on), "left")


def attach_sidecar(sites: DataFrame, sidecars: DataFrame, on=("scene",)) -> DataFrame:
    return sites.join(sidecars, list(on), "left")


def features(df: DataFrame, raw: str, limb_from: str | None = None, out: str = "x") -> DataFrame:
    """Feature vector of a record column; limb features, when asked for, always come from ``limb_from``."""
    x = site_features(F.col(raw))
    if limb_from:
        x = F.when(F.col(raw).isNotNull(), F.concat(x, limb_features(F.col(limb_from))))
    return df.withColumn(out, x)


def design(rows: DataFrame, labels: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Labelled sites with features, group and (only when every row has one) mirrored features.

    rows: (id, sites map, sites_flip map or NULL); labels: (id, site, y); groups: (id, grp)."""
    any_missing = rows.select(F.coalesce(F.bool_or(F.col("sites_flip").isNull()), F.lit(True)).alias("m")).scalar()
    long = explode_sites(rows, ("sites", "sites_flip"), None, ("id",))
    out = long.join(labels.filter(F.col("y").isNotNull()), ["id", "site"])
    if groups is not None:
        out = out.join(groups, "id", "left").withColumn("grp", F.coalesce(F.col("grp"), F.col("id")))
    else:
        out = out.withColumn("grp", F.col("id"))
    def x(c):
        return F.concat(site_features(F.col(c)), limb_features(F.col(c)))

    return out.select("id", "site", "grp", "y", x("sites").alias("x"), F.when(~any_missing, x("sites_flip")).alias("x_flip"))


def affected_scenes(params: Column) -> Column:
    """Scenes with any wound and any garment: candidates for relabelling."""
    g = params["garments"]
    return (F.size(params["wounds"]) > 0) & ((F.coalesce(g["top"], F.lit("none")) != "none") | (F.coalesce(g["bottom"], F.lit("none")) != "none"))


def context_features(df: DataFrame, x: str, size: int, keys=("scene",)) -> DataFrame:
    """Own features, those of the mirrored limb, the mean of the two other limbs, and a site code (upper, lower, left).

    A scene holds four rows, so one aggregation of four conditional picks replaces the self-joins."""
    picks = [F.first(F.when(F.col("site") == s, F.col(x)), ignorenulls=True).alias(f"_{s}") for s in SITES]
    wide = df.groupBy(*keys).agg(*picks)

    def vector(site):
        same, other = ("UE", "LE") if site.endswith("UE") else ("LE", "UE")
        mirror = ("R" if site[0] == "L" else "L") + same
        o1, o2 = F.col("_L" + other), F.col("_R" + other)
        mean = F.array(*[(o1[i] + o2[i]) / 2 for i in range(size)])
        code = F.array(*[F.lit(float(b)) for b in (same == "UE", same == "LE", site[0] == "L")])
        return F.struct(F.lit(site).alias("site"), F.concat(F.col(f"_{site}"), F.col(f"_{mirror}"), mean, code).alias("context"))

    rows = wide.select(*keys, F.explode(F.array(*[vector(s) for s in SITES])).alias("_v"))
    return rows.select(*keys, "_v.*").filter(F.col("context").isNotNull())


def checks_to_records(checks: DataFrame, sidecars: DataFrame, split: str) -> DataFrame:
    """Truth-check records as extraction records: one split, predicted-map sites, labels from the sidecar."""
    kept = checks.filter(F.col("split") == split).select("scene", "split", F.col("pred_sites_ceil").alias("sites"))
    return kept.join(sidecars.select(F.col("scene_id").alias("scene"), F.col("labels_by_threshold").alias("labels")), "scene")


def named(index: Column) -> Column:
    return class_name(index)


def indexed(name: Column) -> Column:
    return class_index(name)
