"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed-length windows, the largest response of each filter in a
window feeds a softmax. The network is trained in numpy on a bounded sample of labelled windows and then applied to every
window of every text; a text's probabilities are the mean over its windows, weighted by their bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteval.llm.common import buffer_of, row_chunks, table

WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS = 8
EMBED = 4
#: bounds of the training sample: languages (most frequent first), documents of a language, windows of a document
MAX_LANGUAGES, SAMPLE, PER_DOCUMENT = 64, 300, 3
EPOCHS, RATE, BATCH = 8, 0.01, 64
#: largest number of windows scored at once
_SPAN = 64
_REACH = max(WIDTHS)
_MASK = np.concatenate([np.repeat((np.arange(_REACH * EMBED) < w * EMBED)[:, None], FILTERS, 1) for w in WIDTHS], axis=1).astype(np.float32)
UNDETERMINED = "und"
#: A-Z read as a-z
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray
    filters: np.ndarray
    shift: np.ndarray
    weight: np.ndarray
    bias: np.ndarray

    def unrolled(self, windows: np.ndarray) -> np.ndarray:
        """(windows, places, reach x embedding): what the filters see at each place; bytes beyond the window are zero."""
        x = np.zeros((len(windows), WINDOW + _REACH - 1, EMBED), np.float32)
        x[:, :WINDOW] = self.embed[windows]
        a, b, c = x.strides
        return np.ascontiguousarray(np.lib.stride_tricks.as_strided(x, (len(windows), WINDOW, _REACH * EMBED), (a, b, c)))

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)))
        for i in range(0, len(windows), _SPAN):
            x = self.unrolled(windows[i : i + _SPAN])
            r = (x.reshape(-1, x.shape[2]) @ self.filters).reshape(len(x), WINDOW, -1).max(axis=1) + self.shift
            out[i : i + _SPAN] = _softmax(np.maximum(r, 0) @ self.weight + self.bias)
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(windows: np.ndarray, target: np.ndarray, languages: list[str], seed: int = 0) -> Network:
    """Train on (n, WINDOW) bytes and their language indices: Adam on the cross entropy; classes count equally.

    Half of the windows of a step are cut to a random length, so short texts are learned as well."""
    rng, windows = np.random.default_rng(seed), _FOLD[windows]
    k = len(WIDTHS) * FILTERS
    net = Network(languages, rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), (rng.normal(0, 0.4, (_REACH * EMBED, k)) * _MASK).astype(np.float32),
                  np.zeros(k, np.float32), rng.normal(0, 0.2, (k, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    net.embed[0] = 0
    params = [net.embed, net.filters, net.shift, net.weight, net.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    share = 1 / np.maximum(np.bincount(target, minlength=len(languages)), 1)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), BATCH):
            at = order[i : i + BATCH]
            w, y = windows[at], target[at]
            w[np.arange(WINDOW)[None] >= np.where(rng.random(len(at)) < 0.5, rng.integers(8, WINDOW, len(at)), WINDOW)[:, None]] = 0
            x = net.unrolled(w)
            r = (x.reshape(-1, x.shape[2]) @ net.filters).reshape(len(at), WINDOW, k)
            place = r.argmax(axis=1)
            rows = np.arange(len(at))[:, None]
            z = r[rows, place, np.arange(k)[None]] + net.shift
            h = np.maximum(z, 0)
            d = _softmax(h @ net.weight + net.bias)
            d[np.arange(len(at)), y] -= 1
            s = share[y]
            d = (d * (s / s.mean() / len(at))[:, None]).astype(np.float32)
            dh = (d @ net.weight.T) * (z > 0)
            seen = x[rows, place]  # (batch, filter, reach x embedding)
            df = np.einsum("bk,bkr->rk", dh, seen) * _MASK
            dx = (dh[:, :, None] * net.filters.T[None]).reshape(len(at), k, _REACH, EMBED)
            padded = np.zeros((len(at), WINDOW + _REACH - 1), np.int64)
            padded[:, :WINDOW] = w
            ids = padded[rows[:, :, None], place[:, :, None] + np.arange(_REACH)[None, None]].ravel()
            de = np.stack([np.bincount(ids, dx[..., e].ravel(), 256) for e in range(EMBED)], axis=1).astype(np.float32)
            de[0] = 0
            step += 1
            for p, g, m, v in zip(params, [de, df, dh.sum(0), h.T @ d, d.sum(0)], first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


def train(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", seed: int = 0) -> Network | None:
    """Learn from a bounded sample: of each of the MAX_LANGUAGES most frequent labels SAMPLE documents in hashed order, of each
    PER_DOCUMENT evenly spaced windows. Held-out documents are never read. None if no document has a label and a text."""
    rows = documents.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & (F.length("text") > 0) & F.coalesce(~held_out(F.col("id")), F.lit(False)))
    top = [r.lang for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()]
    if not top:
        return None
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("id", F.lit(seed)), "id"))
    chosen = rows.filter(F.col("lang").isin(top)).select("lang", "id").withColumn("r", rank).filter(F.col("r") <= SAMPLE).select("id").distinct()
    raw = rows.join(F.broadcast(chosen), "id").withColumn("raw", F.col("text").cast("binary"))  # MAX_LANGUAGES * SAMPLE ids at most
    spread = F.expr(f"transform(sequence(0, {PER_DOCUMENT - 1}), j -> substring(raw, 1 + cast(floor(greatest(octet_length(raw) - {WINDOW}, 0) * j / {PER_DOCUMENT - 1}) as int), {WINDOW}))")
    got = sorted((r.lang, r.id, bytes(w)) for r in raw.filter(F.col("lang").isin(top)).select("lang", "id", spread.alias("ws")).collect() for w in dict.fromkeys(map(bytes, r.ws)))
    languages = sorted(top)
    windows = np.zeros((len(got), WINDOW), np.uint8)
    for i, (_, _, w) in enumerate(got):
        windows[i, : len(w)] = np.frombuffer(w, np.uint8)
    return fit(windows, np.array([languages.index(g[0]) for g in got]), languages, seed)


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _judge(net: Network | None, column):
    """(language, score) of every row of an Arrow text column, over all windows of the whole text."""
    data, offs = buffer_of(column)
    names, scores = [UNDETERMINED] * (len(offs) - 1), np.zeros(len(offs) - 1)
    if net is None:
        return names, scores
    for lo, hi in row_chunks(offs):
        o = offs[lo : hi + 1]
        raw, size = data[o[0] : o[-1]], np.diff(o)
        o = o - o[0]
        letters = np.concatenate([[0], np.cumsum(_LETTER[raw])])[o]
        has = np.diff(letters) > 0
        for i in np.flatnonzero(~has & (size > 0)):
            has[i] = any(c.isalpha() for c in raw[o[i] : o[i + 1]].tobytes().decode("utf-8", "replace"))
        count = -(-size // WINDOW)
        base = np.concatenate([[0], np.cumsum(count)])
        flat = np.zeros(int(base[-1]) * WINDOW, np.uint8)
        flat[np.arange(len(raw)) + np.repeat(base[:-1] * WINDOW - o[:-1], size)] = _FOLD[raw]
        p = net.probabilities(flat.reshape(-1, WINDOW))
        fill = np.full(int(base[-1]), WINDOW)
        fill[base[1:][count > 0] - 1] = (size - (count - 1) * WINDOW)[count > 0]
        total = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p * fill[:, None], axis=0)])
        mean = (total[base[1:]] - total[base[:-1]]) / np.maximum(size, 1)[:, None]
        best = mean.argmax(axis=1)
        for i in np.flatnonzero(has):
            names[lo + i], scores[lo + i] = net.languages[best[i]], min(1.0, max(0.0, mean[i, best[i]]))
    return names, scores


def identify(text: Column, net: Network | None) -> Column:
    """struct(lang_pred string, score double) of a text. Null texts and texts without a letter are ``und`` with score 0."""
    @F.arrow_udf("lang_pred string, score double")
    def judge(column: pa.Array) -> pa.Array:
        names, scores = _judge(net, column)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return judge.asNondeterministic()(text)  # else a filter on the result would score every text twice


def predicted(documents: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, held_out, lang_pred, score. A null id is never held out; repeated rows get equal answers; an empty table
    gives an empty result; without any labelled text every language is ``und``; further columns are not read."""
    got = documents.select(F.col(key).alias("doc_id"), identify(F.col(text), net).alias("p"))
    return got.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "p.lang_pred", "p.score")


def query(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return predicted(documents, train(documents))
