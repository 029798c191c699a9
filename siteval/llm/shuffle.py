"""Two-pass external shuffle into shards of equal row counts.

Pass one scatters records uniformly into buckets that fit in memory, by a seeded hash. Pass two shuffles every bucket with a
seeded Fisher-Yates permutation and appends the buckets to one order of all rows, which is cut into shards whose row counts
differ by one at most. The shards are written as Parquet, one folder each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteval.llm.common import table
from siteval.runtime import scratch_path

SHARDS = 40
BUCKET_BYTES = 24 << 20


def _permuted(seed: int):
    def run(key, t):
        """One bucket: put in an order that depends on the records only, then shuffled; ``_place`` is the place in the global order."""
        bucket = key[0].as_py()
        t = t.take(pc.sort_indices(t, sort_keys=[("_draw", "ascending")]))
        order = np.arange(t.num_rows)
        np.random.default_rng([seed, bucket]).shuffle(order)  # Fisher-Yates
        t = t.take(pa.array(order))
        start = t["_ahead"][0].as_py()
        return t.drop_columns(["_bucket", "_ahead", "_draw"]).append_column("_place", pa.array(np.arange(start, start + t.num_rows)))
    return run


def write_shards(records: DataFrame, path: str, key: str, text: str, shards: int = SHARDS, seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write all columns of ``records`` and _slot (gapless from 0 in its shard) under ``path``/_shard=N.

    Buckets are chosen by a hash of id and text, so copies of a text scatter; records equal in both are interchangeable. Nulls are
    hashed as themselves. An empty table writes no shard."""
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 16
    whole = records.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).first()
    if not whole.n:
        records.withColumn("_slot", F.lit(0).cast("long")).withColumn("_shard", F.lit(0)).write.partitionBy("_shard").parquet(path)
        return
    buckets = max(1, -(-whole.bytes // bucket_bytes))
    draw = F.xxhash64(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    own = records.withColumn("_draw", draw).withColumn("_bucket", F.pmod(F.xxhash64("_draw"), F.lit(buckets)))
    counts = own.select("_bucket").groupBy("_bucket").agg(F.count(F.lit(1)).alias("c"))  # a row per bucket of bucket_bytes
    ahead = counts.select("_bucket", F.coalesce(F.sum("c").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("_ahead"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema)
    mixed = own.join(ahead, "_bucket").groupBy("_bucket").applyInArrow(_permuted(seed), f"{fields}, _place long")
    shard = F.floor(F.col("_place") * shards / F.lit(whole.n)).cast("int") if whole.n * shards < 1 << 53 else F.expr(f"cast(cast(_place as decimal(38,0)) * {shards} div {whole.n} as int)")
    first = F.ceil(F.col("_shard").cast("decimal(20,0)") * whole.n / shards).cast("long")
    placed = mixed.withColumn("_shard", shard).withColumn("_slot", F.col("_place") - first).drop("_place")
    placed.write.partitionBy("_shard").parquet(path)


def query(spark, sf_dir):
    path = scratch_path(spark, "shards")
    write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), path, "doc_id", "text")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return spark.read.parquet(path).select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("rows").alias("law"),
                                           F.col("_shard").cast("int").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
