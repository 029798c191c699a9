"""Packing into optimal length buckets.

A dynamic programme over the histogram of all lengths picks the bucket boundaries with the least padding in total; inside
each bucket documents are dealt in hashed order to batches of at most a token budget.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteval.llm.common import table
from siteval.llm.mixing import tokens_of

BUCKETS, BUDGET = 16, 65_536
#: documents of a bucket that one task sorts
PART = 250_000


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """At most ``buckets`` ascending boundaries out of ``lengths`` (ascending, distinct), the last one the largest: every document is
    padded to the first boundary not below its length, and the sum of paddings is the least possible. Ties take the smaller boundary."""
    n = len(lengths)
    if not n:
        return []
    docs = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    cost = np.full(n + 1, np.inf)
    cost[0] = 0.0
    back = []
    for _ in range(min(buckets, n)):
        now, how = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        now[0] = 0.0
        # The best split never moves left as j grows, so the middle one bounds those on either side.
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, least, most = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            end = min(most + 1, j)
            c = cost[least:end] + (docs[j] - docs[least:end]) * float(lengths[j - 1])
            how[j] = least + c.argmin()
            now[j] = c[how[j] - least]
            todo += [(lo, j - 1, least, int(how[j])), (j + 1, hi, int(how[j]), most)]
        cost = now
        back.append(how)
    out, j = [], n
    for how in reversed(back):
        if j:
            out.append(int(lengths[j - 1]))
            j = int(how[j])
    return sorted(set(out))


def packed(documents: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, budget: int = BUDGET, seed: int = 0) -> DataFrame:
    """One row per row: doc_id, n_tokens, bucket, boundary (padded length), batch (from 0 inside its bucket), slot (from 0 inside its batch).

    A batch holds as many documents as fit the budget when padded, one at least: a document longer than the budget is a batch of
    its own. Null and empty texts count one token (the end id). Rows with equal ids and lengths are told apart by their order;
    they stay separate documents. An empty table gives an empty result."""
    rows = documents.select(F.col(key).alias("doc_id"), F.greatest(tokens_of(F.col(text)), F.lit(1).cast("long")).alias("n_tokens"))
    # T tokens have at most the square root of 2 T distinct lengths.
    histogram = rows.groupBy("n_tokens").count().toPandas().sort_values("n_tokens")
    edges = boundaries(histogram["n_tokens"].to_numpy(np.int64), histogram["count"].to_numpy(np.int64), buckets) or [1]
    place = F.aggregate(F.array(*[F.lit(e).cast("long") for e in edges]), F.lit(0), lambda n, e: n + F.when(e < F.col("n_tokens"), 1).otherwise(0))
    total = int(histogram["count"].sum())
    parts = max(1, -(-total // PART))
    draw = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "n_tokens")
    own = rows.withColumn("bucket", place).withColumn("draw", draw).withColumn("part", F.pmod("draw", F.lit(parts)).cast("int"))
    # Rank inside a bucket: rank inside its part, behind the smaller parts.
    sizes = own.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("c"))
    ahead = sizes.select("bucket", "part", F.coalesce(F.sum("c").over(W.partitionBy("bucket").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = own.withColumn("r", F.row_number().over(W.partitionBy("bucket", "part").orderBy("draw", "doc_id")))
    rank = (F.col("ahead") + F.col("r") - 1)
    boundary = F.element_at(F.array(*[F.lit(e).cast("long") for e in edges]), F.col("bucket") + 1)
    room = F.greatest(F.floor(F.lit(budget) / F.col("boundary")), F.lit(1).cast("long"))
    got = inside.join(ahead, ["bucket", "part"]).withColumn("boundary", boundary)
    return got.select("doc_id", "n_tokens", "bucket", "boundary", F.floor(rank / room).cast("long").alias("batch"), (rank % room).cast("long").alias("slot"))


def query(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"))
