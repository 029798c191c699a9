"""Alignment of two tokenizers by merge-path partitioning of their token ends.

Tokenizer A sees a space and the text, B adds that space itself, so both cover the same bytes. Where a token of A and one of B
end at the same byte, all tokens up to there form a group. The sorted ends of both, laid over the bytes of a run of documents, are merged
in pieces of equal work: a binary search along each diagonal of the merge grid tells where a piece starts on both sides, so
a long document costs no more at once than many short ones. A piece emits the ends that its two sides share; an end
that the cut between two pieces divides is put together from both.

How often a pair of ids ends together in the whole corpus is counted in one aggregation. Pairs with at least one of
FREQUENT equal shares of all links are at most FREQUENT, so their counts go to every task; the others meet their counts in a join,
in which no pair has more than such a share.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteval.llm.common import buffer_of, row_chunks, settled, table
from siteval.llm.tokens import TOKENIZERS, VOCABULARY, encoder

BYTE_LEVEL, PIECES = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
#: elements of a piece of the merge
PIECE = 1 << 14
#: largest number of pairs whose counts are sent to the tasks (17 bytes each)
FREQUENT = 1 << 18
#: bytes of text aligned at once
_CHUNK = 1 << 20
#: in texts without such characters the rank file's library gives the ids of the byte-level file; it is several times faster
_RARE = re.compile("[^\t\n -~¡-ɏ]")
_loaded: dict[tuple, tuple] = {}


def _byte_level() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable in Latin-1, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _ByteLevel:
    def __init__(self, path: str, ranks: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = True
        self.fast = encoder(ranks) if ranks else None
        of = _byte_level()
        with open(path) as f:
            content = {t["id"]: t["content"].encode() for t in json.load(f)["added_tokens"]}
        named = self.exact.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(named.values()) + 1)
        for s, i in named.items():
            self.bytes[i] = content.get(i) or bytes(of[c] for c in s)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.fast.encode_ordinary(" " + t) if self.fast and not _RARE.search(t) else self.exact.encode(" " + t, add_special_tokens=False).ids for t in texts]


class _Pieces:
    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in ((i, self.model.id_to_piece(i)) for i in range(self.model.get_piece_size()))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _sides(a: str, b: str, ranks: str | None):
    """Both tokenizers, the byte widths and the decimal names of their ids; made once per process."""
    if (a, b, ranks) not in _loaded:
        made = (_ByteLevel(a, ranks), _Pieces(b))
        _loaded[a, b, ranks] = (*made, *(np.array([len(x) for x in s.bytes], np.int64) for s in made), [str(i) for i in range(max(len(s.bytes) for s in made))])
    return _loaded[a, b, ranks]


def merge_path(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) where the merge of two ascending arrays stands after every ``piece`` elements, equal ones of ``a`` first."""
    d = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    lo, hi = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (lo < hi).any():
        mid = (lo + hi) // 2
        go = (lo < hi) & (a[np.minimum(mid, len(a) - 1)] <= b[np.clip(d - 1 - mid, 0, len(b) - 1)]) if len(a) and len(b) else np.zeros(len(d), bool)
        lo, hi = np.where(go, mid + 1, lo), np.where(go, hi, np.minimum(mid, hi))
    return lo, d - lo


def shared_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Places in two strictly ascending arrays that hold equal values, piece by piece."""
    i, j = merge_path(a, b, piece)
    left, right = [], []
    for k in range(len(i) - 1):
        if i[k] and j[k] < len(b) and a[i[k] - 1] == b[j[k]]:  # the cut before this piece divides an end
            left.append(i[k : k + 1] - 1)
            right.append(j[k : k + 1])
        x, y = a[i[k] : i[k + 1]], b[j[k] : j[k + 1]]
        at = np.searchsorted(y, x)
        hit = np.flatnonzero(y[np.minimum(at, len(y) - 1)] == x) if len(y) else np.zeros(0, np.int64)
        left.append(hit + i[k])
        right.append(at[hit] + j[k])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


_SCHEMA = pa.schema([("row", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])


def _grouped(a_ids: list[str], b_ids: list[str], a_cut: list[int], b_cut: list[int]) -> str:
    out, i, j = [], 0, 0
    for x, y in zip(a_cut, b_cut):
        out.append(",".join(a_ids[i:x]) + "|" + ",".join(b_ids[j:y]))
        i, j = x, y
    return ";".join(out)


def align(texts: list[str | None], sides) -> list[tuple]:
    """(n_a, n_b, n_groups, groups, pairs, times) of every text."""
    one, two, width_a, width_b, names = sides
    out = [(0, 0, 0, "", _NO, _NO)] * len(texts)
    some = [k for k, t in enumerate(texts) if t]
    kept = []
    for k, a, b in zip(some, one.encode([texts[k] for k in some]), two.encode([texts[k] for k in some])):
        raw = b" " + texts[k].encode()
        if b"".join(map(one.bytes.__getitem__, a)) == raw == b"".join(map(two.bytes.__getitem__, b)):
            kept.append((k, a, b))
    if not kept:
        return out
    a, b = (np.concatenate([np.asarray(x[s], np.int64) for x in kept]) for s in (1, 2))
    a_from, b_from = (np.append(0, np.cumsum([len(x[s]) for x in kept])) for s in (1, 2))
    i, j = shared_ends(np.cumsum(width_a[a]), np.cumsum(width_b[b]))
    pair = a[i] * len(width_b) + b[j]
    edge = np.searchsorted(i, a_from)
    for n, (k, own, other) in enumerate(kept):
        lo, hi = edge[n], edge[n + 1]
        pairs, times = np.unique(pair[lo:hi], return_counts=True)
        text = _grouped([names[x] for x in own], [names[x] for x in other], (i[lo:hi] + 1 - a_from[n]).tolist(), (j[lo:hi] + 1 - b_from[n]).tolist())
        out[k] = (len(own), len(other), int(hi - lo), text, pairs, times)
    return out


_NO = np.zeros(0, np.int64)


def _lists(arrays, kind):
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in arrays])), pa.int32()), pa.array(np.concatenate(arrays), kind))


def _aligned(a, b, ranks):
    def run(batches):
        for batch in batches:
            _, offs = buffer_of(batch.column(1))
            for lo, hi in row_chunks(offs, _CHUNK):
                part = batch.slice(lo, hi - lo)
                got = list(zip(*align(part.column(1).to_pylist(), _sides(a, b, ranks))))
                cols = [pa.array(got[k], _SCHEMA.field(k + 1).type) for k in range(4)]
                yield pa.record_batch([part.column(0), *cols, _lists(got[4], pa.int64()), _lists(got[5], pa.int32())], schema=_SCHEMA)
    return run


def alignments(rows: DataFrame, row: str, text: str, a: str = BYTE_LEVEL, b: str = PIECES, ranks: str | None = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """One row per row: row, n_a, n_b, n_groups, groups (``a1,a2|b1;a3|b2,b3``), and the distinct pairs of ids that end together
    (A's id times B's vocabulary, plus B's) with their times.

    Special tokens' strings are plain text. Null and empty texts, and those whose tokens of either side do not spell a space and the text, have no
    tokens. ``ranks`` may name A's vocabulary as a rank file; without it the slower library does all texts."""
    return rows.select(F.col(row).cast("long").alias("row"), F.col(text).alias("text")).mapInArrow(
        _aligned(a, b, ranks), "row long, n_a long, n_b long, n_groups long, groups string, pairs array<long>, times array<int>")


def _summed(batches):
    """Links of every pair in a batch."""
    for b in batches:
        pairs, times = (np.asarray(b.column(k).flatten()) for k in range(2))
        if len(pairs):
            own, at = np.unique(pairs, return_inverse=True)
            yield pa.record_batch([pa.array(own), pa.array(np.bincount(at, times).astype(np.int64))], names=["pair", "links"])


_PART = pa.schema([("row", pa.int64()), ("count_sum", pa.int64()), ("n_best", pa.int64()), ("pair", pa.int64()), ("times", pa.int32())])


def _scored(known):
    def run(batches):
        pairs, links, best = known.value
        for b in batches:
            row, col, times = b.column(0).to_numpy(), np.asarray(b.column(1).flatten()), np.asarray(b.column(2).flatten())
            of = np.repeat(np.arange(len(row)), np.diff(np.asarray(b.column(1).offsets)))
            at = np.minimum(np.searchsorted(pairs, col), max(len(pairs) - 1, 0))
            hit = pairs[at] == col if len(pairs) else np.zeros(len(col), bool)
            got = at[hit]
            total = np.zeros((2, len(row)), np.int64)
            np.add.at(total[0], of[hit], times[hit] * links[got])
            np.add.at(total[1], of[hit], times[hit] * best[got])
            yield pa.record_batch([pa.array(row), pa.array(total[0]), pa.array(total[1]), pa.nulls(len(row), pa.int64()), pa.nulls(len(row), pa.int32())], schema=_PART)
            miss = ~hit
            if miss.any():
                none = pa.nulls(int(miss.sum()), pa.int64())
                yield pa.record_batch([pa.array(row[of[miss]]), none, none, pa.array(col[miss]), pa.array(times[miss].astype(np.int32))], schema=_PART)
    return run


def pair_counts(found: DataFrame, b_size: int) -> DataFrame:
    """pair, links (corpus-wide), best (no other pair with its B id has more)."""
    sums = found.select("pairs", "times").mapInArrow(_summed, "pair long, links long").groupBy("pair").agg(F.sum("links").alias("links"))
    most = F.max("links").over(W.partitionBy(F.col("pair") % b_size))  # at most A's vocabulary in a window
    return sums.withColumn("best", F.col("links") == most)


def aligned_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", a: str = BYTE_LEVEL, b: str = PIECES, ranks: str | None = f"{TOKENIZERS}/{VOCABULARY}",
                      frequent: int = FREQUENT) -> DataFrame:
    """One row per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, as described by ``alignments`` and ``pair_counts``.

    Every shared end is one link, for no token is without bytes. Ids may be null or repeat: rows are told apart by a number of their own, fixed
    once the alignments are written. An empty table gives an empty result; further columns are not read."""
    import sentencepiece
    spark, b_size = documents.sparkSession, sentencepiece.SentencePieceProcessor(model_file=b).get_piece_size()
    got = alignments(documents.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), "id", "text", a, b, ranks)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    found = settled(got.select(F.monotonically_increasing_id().alias("row"), F.col("row").alias("doc_id"), "n_a", "n_b", "n_groups", digest.alias("groups_sha256"), "pairs", "times"), "aligned")
    counts = settled(pair_counts(found, b_size), "pairs")
    total = counts.agg(F.sum("links")).first()[0] or 0
    known = counts.filter(F.col("links") * frequent >= total).toPandas().sort_values("pair")  # at most ``frequent`` rows
    sent = spark.sparkContext.broadcast((known["pair"].to_numpy(np.int64), known["links"].to_numpy(np.int64), known["best"].to_numpy(bool).astype(np.int64)))
    parts = settled(found.select("row", "pairs", "times").mapInArrow(_scored(sent), "row long, count_sum long, n_best long, pair long, times int"), "scored")
    sent.destroy()
    rare = parts.filter("pair is not null").select("row", "pair", "times").join(counts.filter(F.col("links") * frequent < total), "pair")
    scores = parts.filter("pair is null").select("row", "count_sum", "n_best").unionAll(rare.select("row", F.expr("times * links"), F.expr("if(best, cast(times as long), 0L)")))
    sums = scores.groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    return found.join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")


def query(spark, sf_dir):
    return aligned_documents(table(spark, sf_dir, "documents"))
