"""Session-level helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the session. Only a local session may go without: a cluster's executors could not see a private one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="siteval-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back, cutting its lineage."""
    spark = df.sparkSession
    root = checkpoint_root(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the checkpoint folder for a table written on the way."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: rows in a file of a table written on the way, so that a later pass has a task for every few files
_FILE_ROWS = 100_000


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed table under the checkpoint folder: what reads it several times neither works it out anew nor plans that again, and reads the
    columns that it uses only."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", _FILE_ROWS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: bytes of a method beyond which the JVM never compiles it, so that every row of it is interpreted
_METHOD_BYTES = 8000


def compiled_parts(spark: SparkSession) -> None:
    """From now on the session runs a stage whose generated method would be too long for the JVM's compiler operator by operator, each compiled. A limit
    that the session has set itself stays."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key) == "65535":
        spark.conf.set(key, str(_METHOD_BYTES))


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of fixed rows (rules, costs, thresholds): always small enough to broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def total(columns) -> Column:
    """Sum of a Python list of columns as one flat expression."""
    return reduce(lambda a, b: a + b, columns)


def case(pairs, otherwise=None) -> Column:
    """CASE WHEN from (condition, value) pairs."""
    out = None
    for cond, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out if otherwise is None else out.otherwise(otherwise)


def lookup(col: Column, mapping: dict, otherwise=None) -> Column:
    """Constant lookup as CASE (stays inside code generation)."""
    return case([(col == F.lit(k), v) for k, v in mapping.items()], otherwise)


def bound(value: Column, then) -> Column:
    """``then`` of a column that is worked out once per row, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), lambda one: then(one)), 1)
