"""Readers of every stored form. All schemas are explicit; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteval import schemas as S
from siteval.constants import LABEL_RULES, SITES
from siteval.functions.labels import class_index
from siteval.functions.text import digits, stem
from siteval.operators.documents import from_predictions
from siteval.operators.groups import groups_of
from siteval.operators.integrity import split_images
from siteval.operators.pairing import agree_two_readers
from siteval.operators.sites import apply_label_rules


def read_sidecars(spark: SparkSession, paths, prefix: str = "", recursive: bool = False) -> DataFrame:
    """Scene sidecars under directories, one JSON document per file."""
    return (spark.read.schema(S.SIDECAR).option("multiLine", True).option("recursiveFileLookup", recursive)
            .option("pathGlobFilter", f"{prefix}*_sidecar.json").json(paths))


def last_by_file(df: DataFrame, key: str) -> DataFrame:
    """The last record per key in file order, then line order within a file."""
    cols = [c for c in df.columns if c != key]
    tagged = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    return tagged.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct("_f", "_b", "_i")).alias("_r")).select(key, "_r.*")


def read_records(spark: SparkSession, glob, schema: str = S.RECORD, key: str = "scene") -> DataFrame:
    """Extraction records; the last record of a scene wins."""
    return last_by_file(spark.read.schema(schema).json(glob), key)


def read_engine_rows(spark: SparkSession, glob) -> DataFrame:
    """Engine row logs, plain or gzipped; rows without sites (failures) are dropped; ``id`` is the stem of the image name."""
    rows = spark.read.schema(S.ENGINE_ROW).json(glob).filter(F.size("sites") > 0)
    return last_by_file(rows.withColumn("id", stem(F.coalesce("image_id", "scene"))), "id")


def read_checks(spark: SparkSession, glob, arm: str, split: str, keypoints: DataFrame | None = None) -> DataFrame:
    """Truth-check records of one split with one arm's sites; missing keypoints come from a second source."""
    if arm not in ("pred", "gt"):
        raise ValueError(f"unknown arm {arm!r}")
    rows = spark.read.schema(S.CHECKS).json(glob).drop("gt_sites_ceil" if arm == "pred" else "pred_sites_ceil")  # not read, not dealt out
    return pick_checks(last_by_file(rows, "scene"), arm, split, keypoints)


def pick_checks(checks: DataFrame, arm: str, split: str, keypoints: DataFrame | None = None) -> DataFrame:
    rows = checks.filter(F.col("split") == split).withColumn("sites", F.col(f"{arm}_sites_ceil")).drop("pred_sites_ceil", "gt_sites_ceil")
    if keypoints is None:
        return rows
    return rows.join(keypoints.select("scene", F.col("kp").alias("_kp")), "scene", "left").withColumn("kp", F.coalesce("kp", "_kp")).drop("_kp")


def _document(spark: SparkSession, path) -> DataFrame:
    doc = spark.read.schema(S.PREDICTIONS_DOCUMENT).option("multiLine", True).json(path)
    return doc.select(F.explode("predictions").alias("_p")).select("_p.*")


def read_labels(spark: SparkSession, path, kind: str, rule: str = "0.10") -> DataFrame:
    """Labels as (id, site, y); y is NULL where the label is not a class. Kinds: document, csv, sheets, workbook, sidecars."""
    if kind == "document":
        return from_predictions(_document(spark, path)).select(stem(F.col("image_id")).alias("id"), "site", "y")
    if kind == "csv":
        rows = spark.read.schema(S.LABEL_ROWS).option("header", True).csv(path)
        return rows.select(stem(F.col("image_id")).alias("id"), "site", class_index(F.col("class")).alias("y"))
    if kind in ("sheets", "workbook"):
        if kind == "sheets":
            agreed = read_labels_two_reader(spark, *path)
        else:
            from siteval.sources.workbook import read_workbook_labels
            agreed, _ = read_workbook_labels(spark, path)
        return agreed.select(F.concat(F.lit("T5_"), F.lpad(F.col("photo").cast("string"), 3, "0")).alias("id"), "site", class_index(F.col("class")).alias("y"))
    if kind == "sidecars":
        return sidecar_labels(read_sidecars(spark, path, recursive=True), rule)
    raise ValueError(f"unknown label kind {kind!r}")


def sidecar_labels(cars: DataFrame, rule: str) -> DataFrame:
    """Stored labels of a threshold where present, else the named label rule applied to the truth."""
    if rule in LABEL_RULES:
        t = cars.select(F.col("scene_id").alias("id"), F.explode("truth").alias("site", "t"), "terminal")
        flat = t.select("id", "site", "t.visible_fraction", "t.amputated", F.col("t.stump_visible_px").alias("stump_px"), F.col("terminal")[F.col("site")]["cause"].alias("cause"), "t.wound_present",
                        F.col("t.wound_visible_px").alias("wound_px"))
        return apply_label_rules(flat, {rule: LABEL_RULES[rule]}, ("id", "site")).drop("rule")
    return cars.select(F.col("scene_id").alias("id"), F.explode(F.col("labels_by_threshold")[rule]).alias("site", "class")).select("id", "site", class_index(F.col("class")).alias("y"))


def read_sheet(spark: SparkSession, path) -> DataFrame:
    """A reader's sheet (CSV) in long form: photo, usable, site, class, visible."""
    wide = spark.read.schema(S.READER_SHEET).option("header", True).csv(path)
    return unpivot_sheet(wide)


def unpivot_sheet(wide: DataFrame) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("site"), F.col(f"{s}_class").alias("class"), F.col(f"{s}_visible").alias("visible")) for s in SITES]))
    return wide.select(F.col("n").alias("photo"), (F.col("usable") == "yes").alias("usable"), "framing", "side_conf", "page_url", rows.alias("_r")).select("photo", "usable", "framing", "side_conf", "page_url", "_r.*")


def read_labels_two_reader(spark: SparkSession, a, b) -> DataFrame:
    """Two readers' sheets: class kept only where both agree on a usable photo."""
    return agree_two_readers(read_sheet(spark, a), read_sheet(spark, b))


def read_groups(spark: SparkSession, ids: DataFrame, csv=None, key: str = "id", default: Column | None = None) -> DataFrame:
    """Group per id from a CSV, else the default (the id itself)."""
    given = None
    if csv is not None:
        given = spark.read.schema(S.GROUPS).option("header", True).csv(csv).select(stem(F.col("image_id")).alias(key), F.col("group").alias("grp"))
    return groups_of(ids, given, key, F.col(key) if default is None else default)


def read_manifest(spark: SparkSession, path) -> DataFrame:
    """Manifest lines '<sha256>  <name>' as (name, sha); names lose their directories."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    return spark.read.text(path).filter(F.trim("value") != "").select(F.regexp_replace(parts[1], r"^.*/", "").alias("name"), parts[0].alias("sha"))


def hash_files(spark: SparkSession, path, glob: str = "*") -> DataFrame:
    """(name, sha, length) of the files under a directory."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.regexp_replace("path", r"^.*/", "").alias("name"), F.sha2("content", 256).alias("sha"), "length")


def list_inputs(spark: SparkSession, path) -> DataFrame:
    """Top-level files with ``is_image``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", False).load(path).select("path", "length")
    return split_images(files.select(F.regexp_replace("path", r"^.*/", "").alias("name"), "length"))


def read_reserve(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(S.RESERVE).option("header", True).csv(path)


def photo_number(name: Column) -> Column:
    """All digits of an image name's stem, as a number."""
    return F.try_to_number(digits(stem(name)), F.lit("9999999999")).cast("int")
