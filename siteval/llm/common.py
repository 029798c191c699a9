"""Helpers shared by the operators: tables on the way, word kernels on Arrow buffers, fetching of the texts that are needed."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteval.runtime import scratch_path

#: bytes of text that the word kernels handle at once
CHUNK = 1 << 20
#: bytes of an Arrow batch on its way to a Python worker; Spark's default of 64 MB is held by the task and by each of its workers
BATCH = 8 << 20
#: bits of the filter of needed ids; its words reach the driver, 131,072 at most
FILTER_BITS = 1 << 23
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: odd weights of the words of a shingle
_WEIGHTS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = np.arange(1, 257, dtype=np.uint64)
_VALUE[65:91] += 32
_VALUE[_SPACE] = 0
_POWERS = np.ones(1, dtype=np.uint64)


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH):
    """What runs inside sends Arrow batches of about ``size`` bytes to Python, or of a single longer row. The setting of the session comes back afterwards."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends there, and lost executors take nothing with them."""
    path = scratch_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit words (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffer_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string or binary column; nulls are empty rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def row_chunks(offs: np.ndarray, size: int = CHUNK):
    """Runs of rows (lo, hi) holding about ``size`` bytes each; a longer row is a run of its own."""
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 2 * len(_POWERS)), _MULTIPLIER | np.uint64(1), dtype=np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first byte) of every word of the rows: runs of bytes other than ASCII white space, A-Z lower-cased."""
    none = np.zeros(0, np.int64)
    space = _SPACE[data]
    start = ~space
    start[1:] &= space[:-1]
    first = offs[:-1][offs[:-1] < len(data)]
    start[first] = ~space[first]
    s = np.flatnonzero(start)
    if not len(s):
        return none.astype(np.uint64), none, none
    span = np.diff(s, append=len(data))
    at = np.arange(s[0], len(data)) - np.repeat(s, span)
    value = _VALUE[data[s[0] :]] * _powers(int(span.max()))[at]
    return mix(np.add.reduceat(value, s - s[0])), np.searchsorted(offs, s, side="right") - 1, s


def shingles(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of the ``k`` words from every word on; the last k - 1 places have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += hashes[j : j + n] * _WEIGHTS[j]
    return mix(total)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every row. A row of fewer than ``k`` words has one, of all its words; a row without words has none."""
    h, row, _ = words(data, offs)
    s = shingles(h, k)
    edge = np.searchsorted(row, np.arange(len(offs)))
    out = []
    for a, b in zip(edge, edge[1:]):
        if b - a >= k:
            x = np.sort(s[a : b - k + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        elif b > a:
            out.append(mix((h[a:b] * _WEIGHTS[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sets_of(column, k: int = 5):
    """The shingle sets of an Arrow text column, a bounded run of rows at a time."""
    data, offs = buffer_of(column)
    for lo, hi in row_chunks(offs):
        yield from shingle_sets(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], k)


def signature(x: np.ndarray) -> int:
    """A 64-bit value of a set, as a signed integer: equal sets, equal values."""
    with np.errstate(over="ignore"):
        v = mix(np.add.reduce(mix(x * _MULTIPLIER + np.uint64(1)), keepdims=True) ^ (np.uint64(len(x)) * _WEIGHTS[4]))
    return int(v.view(np.int64)[0])


def texts_of(documents: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text) of the rows of ``documents`` whose ``key`` is in ``ids`` (one column, id).

    A filter of fixed size drops most other rows before their texts are dealt out. Where so many ids are wanted that it lets
    everything pass, the join alone decides: the result is the same."""
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).cast("int")
    marks = ids.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, p & 63)")).alias("b")).toArrow()
    bits = np.zeros(FILTER_BITS >> 6, np.int64)
    bits[marks["w"].to_numpy()] = marks["b"].to_numpy()
    seen = documents.sparkSession.sparkContext.broadcast(bits.tobytes())  # FILTER_BITS / 8 bytes

    def wanted(batches):
        held = np.frombuffer(seen.value, np.uint8)
        for b in batches:
            at = b.column(2).to_numpy()
            yield b.filter(pa.array((held[at >> 3] >> (at & 7) & 1).astype(bool))).select([0, 1])

    rows = documents.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    return rows.withColumn("p", place).mapInArrow(wanted, "id long, text string").join(ids, "id")
