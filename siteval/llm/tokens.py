"""Token counts by a separator scan over flat, unindexed token files.

A flat token file holds token ids of one width and nothing else; an end-of-document id closes each document. ``write_flat``
makes such files from texts with a public tokenizer, ``document_lengths`` reads any such files back: every block of a file is
searched for the end id in one vectorised comparison, and the documents that cross blocks are put together from the blocks'
summaries by prefix sums, so no task reads more than one block and no index is needed.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteval.llm.common import table
from siteval.runtime import scratch_path

#: the public vocabulary used by the query; its folder is a parameter
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: free id of that vocabulary, which closes documents
END = 50256
BLOCK_BYTES = 8 << 20
_encoders: dict[str, object] = {}


def encoder(path: str):
    """The byte-pair encoder of a rank file, made once per process."""
    if path not in _encoders:
        import os
        import sys

        import tiktoken
        sys.path.insert(0, os.path.dirname(os.path.realpath(path)) + "/..")
        import public_tokenizers
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def write_flat(documents: DataFrame, path: str, text: str = "text", vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}", end: int = END) -> None:
    """Flat files of little-endian 16-bit ids in the order of the rows: one file per input partition, named part-NNNNN by its number.

    Spark's text writer puts down the bytes of the ids as they are, and its line separator is the end id; its committer
    keeps the files of a repeated task apart. Null and empty texts are documents of no tokens."""
    def encode(batches):
        e = encoder(vocabulary)
        for b in batches:
            yield pa.record_batch([pa.array([np.array(e.encode_ordinary(t or ""), "<u2").tobytes() for t in b.column(0).to_pylist()], pa.binary())], names=["ids"])

    separator = np.array([end], "<u2").tobytes().decode("latin-1")
    ids = documents.select(F.col(text).alias("text")).mapInArrow(encode, "ids binary").select(F.col("ids").cast("string").alias("value"))
    ids.write.option("lineSep", separator).option("encoding", "ISO-8859-1").text(path)


def opened(path: str):
    """A file of a shared folder for reading at any place."""
    if path.startswith("file:"):
        path = "file://" + path[5:].replace("///", "/", 1)
    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


def files_in(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files of a folder; their contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def _scan(width: int, end: int):
    kind = {2: "<u2", 4: "<u4"}[width]
    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("ids", pa.int64()), ("ends", pa.list_(pa.int32()))])

    def run(batches):
        for b in batches:
            for path, block, at, size in zip(*(c.to_pylist() for c in b.columns)):
                with opened(path) as f:
                    f.seek(at)
                    ids = np.frombuffer(f.read(size), kind)
                yield pa.record_batch([pa.array([path]), pa.array([block]), pa.array([len(ids)], pa.int64()), pa.array([np.flatnonzero(ids == end).astype(np.int32)], pa.list_(pa.int32()))], schema=schema)
    return run


def document_lengths(spark: SparkSession, path: str, width: int = 2, end: int = END, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document of the files under ``path``: file, doc_index (from 0), start (ids before it in the file), n_tokens, closed.

    The ids after the last end id of a file are a document that is not closed; a file that ends with the end id has none.
    Neighbouring end ids hold an empty document between them. A length that is no multiple of ``width`` is an error; an empty
    folder gives an empty result."""
    block_bytes -= block_bytes % width
    files = files_in(spark, path).filter("length > 0")
    sound = F.when(F.col("length") % width == 0, F.col("length")).otherwise(F.raise_error(F.concat(F.col("path"), F.lit(" holds a broken id"))))
    blocks = files.select("path", sound.alias("length")).select("path", "length", F.explode(F.expr(f"sequence(0L, (length - 1) div {block_bytes})")).alias("block"))
    work = blocks.select("path", "block", (F.col("block") * block_bytes).alias("at"), F.least(F.lit(block_bytes), F.col("length") - F.col("block") * block_bytes).cast("long").alias("size"))
    spread = work.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "block")
    found = spread.mapInArrow(_scan(width, end), "path string, block long, ids long, ends array<int>")
    # Prefix sums over the blocks of a file: ids and documents before a block, and the place after the last end id before it.
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    last = F.when(F.size("ends") > 0, F.col("first") + F.element_at("ends", -1) + 1)
    zero = F.lit(0).cast("long")
    placed = found.withColumn("first", F.coalesce(F.sum("ids").over(before), zero)).withColumn("docs", F.coalesce(F.sum(F.size("ends")).over(before), zero))
    placed = placed.withColumn("open", F.coalesce(F.max(last).over(before), zero)).withColumn("final", F.lead("block").over(W.partitionBy("path").orderBy("block")).isNull())
    tail = F.expr("if(final and (size(ends) = 0 or element_at(ends, -1) < ids - 1), array(cast(ids as int)), cast(array() as array<int>))")
    cut = placed.withColumn("all", F.concat("ends", tail))
    each = cut.select("path", "docs", "first", "open", "ends", F.posexplode("all").alias("i", "at"))
    start = F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("first") + F.expr("get(ends, i - 1)") + 1)
    return each.select(F.col("path").alias("file"), (F.col("docs") + F.col("i")).alias("doc_index"), start.alias("start"),
                       (F.col("first") + F.col("at") - start).alias("n_tokens"), (F.col("i") < F.size("ends")).alias("closed"))


def query(spark, sf_dir):
    """Tokens of every document, by shard (the number of the flat file) and place in it."""
    path = scratch_path(spark, "flat")
    write_flat(table(spark, sf_dir, "documents"), path)
    shard = F.regexp_extract("file", r"part-(\d+)", 1).cast("int")
    return document_lengths(spark, path).select(shard.alias("shard"), "doc_index", "start", "n_tokens", "closed")
