"""Sinks: ledgers, rows, prediction documents, layers, keypoints and the report text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteval.constants import JOINTS, KEYPOINT_COUNT, KEYPOINTS
from siteval.functions.geometry import joint_state
from siteval.operators.documents import validate_predictions
from siteval.runtime import bound, lookup


def write_ledger(ledger: DataFrame, path: str, mode: str = "append") -> None:
    """Ledger rows as Parquet, partitioned by phase."""
    ledger.write.mode(mode).partitionBy("phase").parquet(path)


def write_rows(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows as JSON lines."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_metrics(df: DataFrame, path: str) -> None:
    write_rows(df, path, "overwrite")


def prediction_lines(records: DataFrame, team: str, email: str, version: str, key: str = "image_id") -> DataFrame:
    """One self-contained document per image: (schema_version, submission, key, sites). Rows with NULL or unknown classes
    are refused by ``write_predictions``."""
    head = F.struct(F.lit(team).alias("team_name"), F.lit(version).alias("version"), F.lit(email).alias("email"))
    return records.select(F.lit("1.0").alias("schema_version"), head.alias("submission"), F.col(key).cast("string").alias(key), "sites")


def write_predictions(records: DataFrame, path: str, team: str, email: str, version: str, expected: DataFrame | None = None) -> None:
    """Records as JSON lines, written only if ``validate_predictions`` finds nothing wrong with them (and, with ``expected``, no
    image missing or extra); Spark's commit protocol keeps readers from seeing a partial result."""
    lines = prediction_lines(records, team, email, version)
    problems = validate_predictions(lines.select("schema_version", "submission.*", "image_id", "sites"), expected)
    found = problems.groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.min("image_id").alias("first")).collect()  # a few kinds of problem
    if found:
        raise ValueError("; ".join(f"{r.problem}: {r.n} images, first {r['first']}" for r in sorted(found, key=lambda r: r.problem)))
    write_rows(lines, path, "overwrite")


def keypoint_index(site: Column, joint: Column) -> Column:
    """Position of a joint in the flat keypoint layout; NULL for joints without one."""
    names = {f"{s}.{j}": KEYPOINTS[s][i] for s in KEYPOINTS for i, j in enumerate(JOINTS[s[1:]])}
    return lookup(F.concat_ws(".", site, joint), names)


def export_keypoints(joints: DataFrame, key: str = "scene_id") -> DataFrame:
    """(key, keypoints flat array of x, y, v triples, num_keypoints, native_states) from joint truth.

    joints: key, sites: map site -> joint -> struct(x, y, exists, in_frame, visible)."""
    flat = F.flatten(F.transform(F.map_entries("sites"), lambda s: F.transform(F.map_entries(s["value"]), lambda j: F.struct(
        s["key"].alias("site"), j["key"].alias("joint"), j["value"].alias("p")))))
    marked = F.transform(flat, lambda e: F.struct(
        F.concat_ws(".", e["site"], e["joint"]).alias("name"), keypoint_index(e["site"], e["joint"]).alias("k"), e["p"]["x"].alias("x"), e["p"]["y"].alias("y"),
        joint_state(e["p"]["exists"], e["p"]["in_frame"], e["p"]["visible"]).alias("state")))
    d = joints.select(key, marked.alias("_m"))
    # Fixed values. Visibility code per state; only the first two are written with coordinates.
    code = {"visible": 2, "occluded": 1}

    def placed(v):
        at = lambda i: F.get(v["triples"], F.array_position(v["keys"], i).cast("int") - 1)
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(KEYPOINT_COUNT - 1)), lambda i: F.coalesce(at(i), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))))

    shown = F.filter("_m", lambda e: e["k"].isNotNull() & e["state"].isin(*code))
    points = bound(shown, lambda shown: bound(F.struct(
        F.transform(shown, lambda e: e["k"]).alias("keys"),
        F.transform(shown, lambda e: F.array(F.round(e["x"], 1), F.round(e["y"], 1), lookup(e["state"], code).cast("double"))).alias("triples")), placed))
    found = F.size(shown)
    return d.select(key, points.alias("keypoints"), found.alias("num_keypoints"), F.map_from_entries(F.transform("_m", lambda e: F.struct(e["name"], e["state"]))).alias("native_states"))


def resume_append(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Source rows whose key the sink does not hold yet."""
    return source.join(done.select(key).distinct(), key, "left_anti")


def markdown_table(df: DataFrame) -> str:
    """A result table as markdown, fetched a partition at a time; meant for tables that people read."""
    def cell(v):
        return "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join(cell(v) for v in r) + " |" for r in df.toLocalIterator())])


def report(title: str, sections: dict[str, DataFrame]) -> str:
    """The report text: one section per small table."""
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{markdown_table(df)}" for name, df in sections.items())]) + "\n"
