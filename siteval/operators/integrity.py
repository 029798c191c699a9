"""Manifests, guards, paired-scene acceptance and run equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteval.constants import GENERATOR_PATTERN, IMAGE_EXTENSIONS, PROVENANCE_KEYS, SIDE_OUTPUT_SUFFIXES
from siteval.functions.labels import mirror_site
from siteval.functions.text import stem
from siteval.operators.metrics import count_if


def missing_outputs(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """Expected ids without an output."""
    return expected.select(key).distinct().join(got.select(key), key, "left_anti")


def extra_outputs(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """Outputs nobody expected."""
    return got.select(key).distinct().join(expected.select(key), key, "left_anti")


def manifest_diff(lock: DataFrame, current: DataFrame, name: str = "name", sha: str = "sha") -> DataFrame:
    """missing / extra / changed names between a locked manifest and the current files."""
    j = lock.select(name, F.col(sha).alias("_l")).join(current.select(name, F.col(sha).alias("_c")), name, "full")
    status = F.when(F.col("_c").isNull(), "missing").when(F.col("_l").isNull(), "extra").when(F.col("_l") != F.col("_c"), "changed")
    return j.select(name, status.alias("status")).filter("status IS NOT NULL")


def manifest_ok(lock: DataFrame, current: DataFrame) -> DataFrame:
    """Counts per kind of difference and whether there are none."""
    d = manifest_diff(lock, current)
    out = d.agg(*[count_if(F.col("status") == s).alias(s) for s in ("missing", "extra", "changed")])
    return out.withColumn("ok", (F.col("missing") + F.col("extra") + F.col("changed")) == 0)


def scene_stem(path: Column) -> Column:
    """Stem of an image with generator side-output suffixes removed, in list order."""
    s = stem(path)
    for suffix in SIDE_OUTPUT_SUFFIXES:
        s = F.regexp_replace(s, f"{suffix}$", "")
    return s


def publish_guard(images: DataFrame, sidecars: DataFrame, directories=(), real_data_run: bool = False) -> DataFrame:
    """Reason to refuse each image (NULL = fine). images: name, dir. sidecars: stem, dir, generator, readable.

    The image's own directory is searched first, then ``directories`` in order; the first sidecar found decides. Of several
    sidecars of one stem in one directory an unreadable one decides, else the smallest generator."""
    cars = sidecars.groupBy("stem", "dir").agg(F.min(F.struct("readable", "generator")).alias("_car"))
    j = images.withColumn("stem", scene_stem(F.col("name"))).join(cars, ["stem", "dir"], "left")
    for i, d in enumerate(directories):
        j = j.join(cars.filter(F.col("dir") == d).select("stem", F.col("_car").alias(f"_car{i}")), "stem", "left")
    found = F.coalesce("_car", *[f"_car{i}" for i in range(len(directories))])
    reason = (F.when(F.lit(real_data_run), "real-data run").when(found.isNull(), "no generator sidecar")
              .when(~found["readable"], "sidecar unreadable")
              .when(~F.coalesce(found["generator"], F.lit("")).rlike(GENERATOR_PATTERN), "not our generator"))
    return j.select("name", reason.alias("reason"))


def guard_verdict(guarded: DataFrame) -> DataFrame:
    """One row: refused images and whether publishing is allowed. An empty set is refused."""
    return guarded.agg(F.count(F.lit(1)).alias("images"), F.count("reason").alias("refused")).withColumn(
        "allowed", (F.col("images") > 0) & (F.col("refused") == 0))


def split_images(files: DataFrame, name: str = "name", extensions=IMAGE_EXTENSIONS) -> DataFrame:
    """File listing with ``is_image`` by case-insensitive extension."""
    ext = F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))
    return files.withColumn("is_image", ext.isin(*extensions))


def case_duplicates(names: DataFrame, name: str = "name") -> DataFrame:
    """Names that differ only in case: key, how many rows, how many spellings."""
    per = names.groupBy(F.lower(name).alias("key"), name).agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy("key").agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("spellings")).filter("n > 1")


def pairwise_scene_checks(rows: DataFrame, tolerance: float = 0.02, hidden_drop: int = 20) -> DataFrame:
    """Member a against member b of every pair, per site. rows: pair, member, site, full_px, visible_px, label, amputated.

    Both members of a pair hold eight rows, so one aggregation per (pair, site) aligns them; the mirrored label comes from
    the same aggregation over the mirrored site."""
    a = rows.filter("member = 'a'").select("pair", "site", *[F.col(c).alias(f"a_{c}") for c in ("full_px", "visible_px", "label", "amputated")])
    b = rows.filter("member = 'b'").select("pair", "site", *[F.col(c).alias(f"b_{c}") for c in ("full_px", "visible_px", "label", "amputated")])
    mirrored = rows.filter("member = 'b'").select("pair", mirror_site(F.col("site")).alias("site"), F.col("label").alias("m_label"), F.col("amputated").alias("m_amputated"))
    j = a.join(b, ["pair", "site"]).join(mirrored, ["pair", "site"])
    same = F.abs(F.col("a_full_px") - F.col("b_full_px")) <= F.greatest(F.col("b_full_px"), F.lit(1)) * tolerance
    return j.select("pair", "site", same.alias("outline_same"), (F.col("a_visible_px") < F.col("b_visible_px") - hidden_drop).alias("hidden_in_a"),
                    (F.col("a_label") == F.col("m_label")).alias("label_swapped"), "a_amputated", "m_amputated")


def provenance_complete(keys: Column, need=PROVENANCE_KEYS) -> Column:
    """True when every required key is present."""
    return F.size(F.array_except(F.array(*[F.lit(k) for k in need]), keys)) == 0


def acceptance_checks(sites: DataFrame, scenes: DataFrame, regression: str = "pass", occluder_pairs=("P03", "P04"),
                      mirror_pair: str = "P09", crop_pair: str = "P10") -> DataFrame:
    """The ten named acceptance checks over paired scenes: (name, pass, bad).

    sites: pair, kind, member, site and truth columns; scenes: pair, kind, member, keys (provenance), total_s."""
    s = {c: F.col(c) for c in sites.columns}
    site_level = sites.agg(
        count_if(s["outside_share"] > 0.005).alias("amodal_containment"),
        count_if(s["amputated"] & ((s["distal_px"] > 0) | s["distal_exists"] | (s["stump_full_px"] == 0))).alias("amputation_truth"),
        count_if(s["terminal_x"].isNull() | s["terminal_y"].isNull() | s["cause"].isNull() | s["owner"].isNull()).alias("endpoint_representation"),
        count_if((s["wound_native_px"] + 5 < s["wound_px"]) | (s["tourniquet"] & (s["tq_native_px"] == 0))).alias("treatment_and_injury_truth"),
        count_if((s["kind"] == crop_pair) & (s["member"] == "b") & (s["cause"] == "out_of_frame")).alias("_oof"))
    pairs = pairwise_scene_checks(sites).join(sites.select("pair", "kind").distinct(), "pair")
    per_pair = pairs.groupBy("pair", "kind").agg(
        F.bool_and("outline_same").alias("same"), F.bool_or("hidden_in_a").alias("hidden"), F.bool_and("label_swapped").alias("swapped"),
        F.bool_or((F.col("site") == "LUE") & F.col("a_amputated") & F.col("m_amputated")).alias("amp_swapped"))
    pair_level = per_pair.agg(
        count_if(F.col("kind").isin(*occluder_pairs) & ~(F.col("same") & F.col("hidden"))).alias("hidden_intact_and_occluder_identity"),
        count_if((F.col("kind") == mirror_pair) & ~(F.col("swapped") & F.col("amp_swapped"))).alias("laterality"),
        count_if(F.col("kind") == mirror_pair).alias("_mirrors"), count_if(F.col("kind").isin(*occluder_pairs)).alias("_occluded"))
    scene_level = scenes.agg(count_if(~provenance_complete(F.col("keys"))).alias("provenance"), F.count(F.lit(1)).alias("_scenes"))

    def stacked(row, names):
        return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), ok.alias("pass"), bad.cast("long").alias("bad")) for n, ok, bad in names])).alias("_c")).select("_c.*")

    def clean(n):
        return (n, F.col(n) == 0, F.col(n))

    out = stacked(site_level, [clean("amodal_containment"), clean("amputation_truth"), clean("endpoint_representation"), clean("treatment_and_injury_truth"),
                               ("out_of_frame", F.col("_oof") > 0, F.lit(0))])
    out = out.unionByName(stacked(pair_level, [
        ("hidden_intact_and_occluder_identity", (F.col("hidden_intact_and_occluder_identity") == 0) & (F.col("_occluded") > 0), F.col("hidden_intact_and_occluder_identity")),
        ("laterality", (F.col("laterality") == 0) & (F.col("_mirrors") > 0), F.col("laterality"))]))
    return out.unionByName(stacked(scene_level, [clean("provenance"), ("performance", F.lit(True), F.lit(0)), ("regression", F.lit(regression.startswith("pass")), F.lit(0))]))


def relabel_diff(old: DataFrame, new: DataFrame, on=("scene",), labels: str = "labels") -> DataFrame:
    """Transitions per threshold, site, old and new class between two sets of labels (threshold -> site -> class)."""
    j = old.select(*on, F.col(labels).alias("_o")).join(new.select(*on, F.col(labels).alias("_n")), list(on))
    flat = j.select(*on, F.explode("_n").alias("threshold", "_by_site"), "_o").select(*on, "threshold", F.explode("_by_site").alias("site", "new"), "_o")
    was = F.col("_o")[F.col("threshold")][F.col("site")]
    return flat.select(*on, "threshold", "site", was.alias("old"), "new").filter("old <> new").groupBy("threshold", "site", "old", "new").agg(F.count(F.lit(1)).alias("n"))


def relabel_status(scenes: DataFrame) -> DataFrame:
    """skipped / mismatch / unchanged / relabelled per scene from flags affected, geometry_px, changed."""
    status = (F.when(~F.col("affected"), "skipped").when(F.col("geometry_px") > 0, "mismatch").when(F.col("changed"), "relabelled").otherwise("unchanged"))
    return scenes.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def determinism_check(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (with multiplicity) of one run that the other lacks, both ways; equal when both are 0.

    Rows are folded to counts per row value first, so repeated rows cost nothing extra."""
    cols = a.columns
    both = a.select(*cols, F.lit(1).alias("_d")).unionByName(b.select(*cols, F.lit(-1).alias("_d")))
    net = both.groupBy(*cols).agg(F.sum("_d").alias("_d"))
    plus, minus = F.sum(F.greatest(F.col("_d"), F.lit(0))), F.sum(F.greatest(-F.col("_d"), F.lit(0)))
    out = net.agg(F.coalesce(plus, F.lit(0)).cast("long").alias("only_first"), F.coalesce(minus, F.lit(0)).cast("long").alias("only_second"))
    return out.withColumn("equal", (F.col("only_first") == 0) & (F.col("only_second") == 0))


def source_hash(files: DataFrame, name: str = "name", sha: str = "sha", digits: int = 4) -> DataFrame:
    """One SHA-256 over a file set. Hashes of names and contents are combined in a two-level tree (by hash prefix), so no
    task holds the whole listing. The value differs from hashing the concatenated bytes."""
    leaf = F.sha2(F.concat_ws(" ", F.col(name), F.col(sha)), 256)
    buckets = files.select(leaf.alias("_h")).groupBy(F.substring("_h", 1, digits).alias("_b")).agg(
        F.count(F.lit(1)).alias("files"), F.sha2(F.concat_ws("", F.array_sort(F.collect_list("_h"))), 256).alias("_h"))
    return buckets.agg(F.sum("files").alias("files"), F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("_b", "_h"))), lambda s: s["_h"])), 256).alias("sha256"))


def split_leakage(a: DataFrame, b: DataFrame, group: str) -> DataFrame:
    """Groups present in both splits (must be empty)."""
    return a.select(group).intersect(b.select(group))


def guard_mismatch(lock: DataFrame, current: DataFrame, in_scope: DataFrame, name: str = "name") -> DataFrame:
    """Names in scope whose digest differs from the lock: scoring must stop when there are any."""
    return manifest_diff(lock, current, name).filter("status = 'changed'").join(in_scope.select(name).distinct(), name, "left_semi")
