"""Periodic runs of words, found from Lyndon roots.

Phase one of Baier's suffix sorter groups the suffixes of a sequence by their longest Lyndon prefix, without ever sorting them.
What a group's suffixes share when it is taken up is that prefix, so the grouping is the Lyndon array. Every run has a root
that is the longest Lyndon word from its place on under the order of words or under the reverse order: the arrays of both
orders name all candidates, and longest common extensions to both sides make runs of them.

Only words inside five-word shingles that occur twice in their document can lie in a run of the sought kind: such a run holds each
of its shingles again one period on or back. The grouping works on stretches of these words, so unperiodic text costs one sort.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siteval.llm.common import shingles, table

#: words of the shingles that find the stretches
K = 5
#: a run has at least this many words, and at least this many periods
LEAST, TIMES = 6, 4


def lyndon_lengths(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word from every place on, for ranks 0, 1, ... without gaps; the end counts as smaller than every rank."""
    n, k = len(ranks), max(ranks, default=-1) + 1
    group, members = list(ranks), [[] for _ in range(k)]
    for i, r in enumerate(ranks):
        members[r].append(i)
    width, below, above = [1] * k, list(range(-1, k - 1)), list(range(1, k + 1))
    if k:
        above[-1] = -1
    length, back = [0] * n, [0] * n  # a place whose group has been taken up has a length; back leads to the nearest place of a lower group
    g = k - 1
    while g >= 0:
        size = width[g]
        pointed: dict[int, int] = {}
        for i in sorted(i for i in members[g] if group[i] == g):
            j, seen = i - 1, []
            while j >= 0 and length[j]:
                seen.append(j)
                j = back[j]
            for s in seen:
                back[s] = j
            back[i], length[i] = j, size
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        # Places before more members have the longer prefix; those of one group and count form a group right above their old one.
        split: dict[tuple[int, int], list[int]] = {}
        for j, times in pointed.items():
            split.setdefault((times, group[j]), []).append(j)
        for times, old in sorted(split, reverse=True):
            new, moved = len(members), split[times, old]
            members.append(moved)
            width.append(width[old] + times * size)
            for j in moved:
                group[j] = new
            up = above[old]
            below.append(old)
            above.append(up)
            above[old] = new
            if up >= 0:
                below[up] = new
        g = below[g]
    return length


class Extensions:
    """Longest common extensions of two places by the ranks of all windows of 1, 2, 4, ... words."""

    def __init__(self, ids: np.ndarray):
        self.n, self.levels = len(ids), [ids.astype(np.int32)]
        span = 1
        while 2 * span <= self.n:
            r = self.levels[-1].astype(np.int64)
            pair = r[: self.n - 2 * span + 1] * (int(r.max()) + 1) + r[span : self.n - span + 1]
            self.levels.append(np.unique(pair, return_inverse=True)[1].astype(np.int32))
            span *= 2

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words from ``i`` on that equal those from ``j`` on; i < j."""
        return self._walk(i, j, 1)

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words up to ``i`` that equal those up to ``j``, both included; i < j."""
        return self._walk(i, j, -1)

    def _walk(self, i, j, way):
        i, j, total = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            span, level = 1 << k, self.levels[k]
            a, b = (i, j) if way > 0 else (i - span + 1, j - span + 1)
            inside = (a >= 0) & (b + span <= self.n)
            same = inside & (level[np.where(inside, a, 0)] == level[np.where(inside, b, 0)])
            step = np.where(same, span, 0)
            i, j, total = i + way * step, j + way * step, total + step
        return total


def stretches(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Places (lo, hi) of the longest stretches whose words all lie in shingles that occur at least twice."""
    s = shingles(ids.astype(np.uint64) + np.uint64(1), K)
    if len(s) < 2:
        return []
    order = np.argsort(s, kind="stable")
    same = s[order][1:] == s[order][:-1]
    twice = np.zeros(len(s), np.int64)
    twice[order[1:][same]] = twice[order[:-1][same]] = 1
    if not twice.any():
        return []
    covered = np.zeros(len(ids) + 1, np.int64)
    covered[:-1][: len(s)] += twice
    covered[K : K + len(s)] -= twice
    edge = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(covered[:-1]) > 0, [0]])))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2]) if b - a >= least]


def runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of the runs of a sequence of numbers, by start and period: a smallest period, ``least`` words and ``times``
    periods or more, and no neighbour that goes on with the period. The stretches take ``least`` of 6 and ``times`` of 4 at least."""
    if least < LEAST or times < TIMES:
        raise ValueError(f"runs of fewer than {LEAST} words or {TIMES} periods may lie outside of repeated shingles")
    found = [np.zeros((0, 3), np.int64)]
    for lo, hi in stretches(ids, least):
        names, ranks = np.unique(ids[lo:hi], return_inverse=True)
        n, reach = hi - lo, Extensions(ranks)
        for order in (ranks, len(names) - 1 - ranks):
            period = np.array(lyndon_lengths(order.tolist()))
            at = np.flatnonzero(period * times <= n)
            period = period[at]
            left = reach.backward(at - 1, at + period - 1)
            length = left + period + reach.forward(at, at + period)
            good = (length >= least) & (length >= times * period)
            found.append(np.stack([at - left + lo, length, period], axis=1)[good])
    out = np.unique(np.concatenate(found), axis=0)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def collapsed(n: int, found: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay when every run keeps its first period only."""
    drop = np.zeros(n + 1, np.int64)
    np.add.at(drop, found[:, 0] + found[:, 2], 1)
    np.add.at(drop, found[:, 0] + found[:, 1], -1)
    return np.cumsum(drop[:-1]) == 0


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _of_rows(least, times):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])

    def run(batches):
        for b in batches:
            counts, spans, texts = [], [], []
            for t in b.column(1):
                w = (t.as_py() or "").encode().split()
                ids = pd.factorize(np.array(w, dtype=object))[0] if len(w) >= least else np.zeros(0, np.int64)
                found = runs(ids, least, times)
                if len(found):
                    w = [w[i] for i in np.flatnonzero(collapsed(len(w), found))]
                counts.append(len(ids) or len(w))
                spans.append([{"start": s, "length": n, "period": p} for s, n, p in found.tolist()])
                texts.append(b" ".join(w).decode())
            yield pa.record_batch([b.column(0), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(_RUN)), pa.array(texts, pa.string())], schema=schema)
    return run


def periodic_runs(documents: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row per row: doc_id, n_words, runs (start, length, period in words, by start and period) and the text with every run collapsed
    to its first period, its kept words joined by single spaces.

    Words are runs of bytes other than ASCII white space; case counts. Null and empty texts have no words, no runs and an empty
    collapsed text. Ids may be null or repeat: every row is answered by itself. An empty table gives an empty result; further
    columns are not read. One document is one unit of work, however long."""
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_of_rows(least, times), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


@F.arrow_udf(StringType())
def _repeated(text: pa.Array, seed: pa.Array) -> pa.Array:
    out = []
    for t, g in zip(text.to_pylist(), seed.to_pylist()):
        w = (t or "").encode().split()
        if t is not None and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            t = b" ".join([*w[:a], *(w[a + i % p] for i in range(len(w) - a))]).decode()
        out.append(t)
    return pa.array(out, pa.string())


def with_planted_runs(text: Column, key: Column) -> Column:
    """The text, in every tenth document (by the hash of its id) with its words from some place on replaced by repeats of the first of them."""
    h = F.crc32(key.cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    return F.when(chosen, _repeated(F.when(chosen, text), (h / 10).cast("long"))).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """The longest run of every document, and digests of all runs and of the collapsed text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    one = found.withColumn("best", best)
    return one.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.n")).alias("length"), F.col("best.p").alias("period"),
                      F.expr("(-best.n * 1000) div best.p").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def query(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    planted = documents.select("doc_id", with_planted_runs(F.col("text"), F.col("doc_id")).alias("text"))
    return digests(periodic_runs(planted))
