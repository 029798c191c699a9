"""Secret scanning: fixed rules, and a character convolutional network over every candidate and what surrounds it.

Candidates are the values of the rules' findings and every other string of key characters that is long or holds a digit. A
window shows bytes before the candidate, the candidate, and bytes after it; filters of several widths slide over it, and the largest response
in each of the three parts feeds a softmax over "no secret" and the rules' kinds. The network is trained on all different windows that are not held
out: in every epoch each group of about SHARD windows starts from the same weights, and what they end with is averaged. The held out windows, all of them,
calibrate its scores (Platt) and set for each kind the highest threshold that still finds RECALL of the labelled findings. Candidates that no rule found and that reach the threshold of their kind are
added; what the rules found always stays.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteval.llm.common import buffer_of, row_chunks, settled, table
from siteval.operators.quantiles import exact_quantiles

# The rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
RULES = ("assign", "access", "hex")
#: kind of the spans that the network adds
ADDED = "network"

#: strings of key characters are candidates from so many characters on, without a digit from so many
SHORT, LONG = 8, 20
_STRING = re.compile(rf"[A-Za-z0-9+/_.=-]{{{SHORT},}}")
_DIGIT = re.compile("[0-9]")
#: bytes before, of and after the candidate in a window; longer candidates are seen piece by piece
BEFORE, OWN, AFTER = 32, 48, 16
WINDOW = BEFORE + OWN + AFTER
_PARTS = ((0, BEFORE), (BEFORE, BEFORE + OWN), (BEFORE + OWN, WINDOW))
EMBED, FILTERS, WIDTHS = 6, 12, (2, 3, 5)
_REACH = max(WIDTHS)
_MASK = np.concatenate([np.repeat((np.arange(_REACH * EMBED) < w * EMBED)[:, None], FILTERS, 1) for w in WIDTHS], axis=1).astype(np.float32)
#: windows of a group that a task trains on between two averages, at most about
SHARD = 4096
EPOCHS, RATE, BATCH = 8, 0.01, 64
#: share of the windows that calibrates, and the least share of labelled findings of a kind that its threshold must find
HELD, RECALL = 0.4, 0.95
_SPAN = 256


def rule_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, end, rule, value start, value end) of the rules' findings in code points, by start and rule."""
    out = [(m.start(), m.end(), 0, m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    out += [(m.start(), m.end(), 1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), m.end(), 2, m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def candidates(text: str, found) -> list[tuple[int, int, int]]:
    """(start, end, rule or -1) of the candidates: values of findings, and strings that no finding touches. Of equal values the first rule counts."""
    values: dict[tuple[int, int], int] = {}
    for _, _, rule, lo, hi in sorted(found, key=lambda s: s[2]):
        values.setdefault((lo, hi), rule)
    out = [(lo, hi, rule) for (lo, hi), rule in values.items()]
    at, top = 0, 0  # findings that start before the string ends, and how far they reach
    for m in _STRING.finditer(text):
        lo, hi = m.start(), m.end()
        while at < len(found) and found[at][0] < hi:
            top = max(top, found[at][1])
            at += 1
        if top > lo or not (hi - lo >= LONG or _DIGIT.search(text, lo, hi)):
            continue
        out.append((lo, hi, -1))
    return sorted(out)


def windows(text: str, lo: int, hi: int) -> list[np.ndarray]:
    """The windows of a candidate: one for every OWN characters of it."""
    out = []
    for a in range(lo, hi, OWN):
        b = min(hi, a + OWN)
        w = np.zeros(WINDOW, np.uint8)
        left, own, right = text[max(0, a - BEFORE) : a].encode()[-BEFORE:], text[a:b].encode(), text[b : b + AFTER].encode()[:AFTER]
        w[BEFORE - len(left) : BEFORE] = np.frombuffer(left, np.uint8)
        w[BEFORE : BEFORE + len(own)] = np.frombuffer(own, np.uint8)
        w[BEFORE + OWN : BEFORE + OWN + len(right)] = np.frombuffer(right, np.uint8)
        out.append(w)
    return out


def _softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Detector:
    """Class 0 is no secret, class k the rule kinds[k - 1]. ``slope`` and ``shift`` calibrate the log odds of a secret."""

    kinds: list[int]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    base: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    thresholds: tuple = ()

    def seen(self, w: np.ndarray) -> np.ndarray:
        x = np.zeros((len(w), WINDOW + _REACH - 1, EMBED), np.float32)
        x[:, :WINDOW] = self.embed[w]
        a, b, c = x.strides
        return np.ascontiguousarray(np.lib.stride_tricks.as_strided(x, (len(w), WINDOW, _REACH * EMBED), (a, b, c)))

    def responses(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of every filter in each part of the window, and its place."""
        r = (x.reshape(-1, x.shape[2]) @ self.filters).reshape(len(x), WINDOW, -1)
        place = np.concatenate([lo + r[:, lo:hi].argmax(axis=1) for lo, hi in _PARTS], axis=1)
        n = r.shape[2]
        return np.take_along_axis(np.concatenate([r] * len(_PARTS), axis=2), place[:, None, :], axis=1)[:, 0] + np.tile(self.bias[:n], len(_PARTS)), place

    def probabilities(self, w: np.ndarray) -> np.ndarray:
        out = np.empty((len(w), len(self.kinds) + 1))
        for i in range(0, len(w), _SPAN):
            z, _ = self.responses(self.seen(w[i : i + _SPAN]))
            out[i : i + _SPAN] = _softmax(np.maximum(z, 0) @ self.weight + self.base)
        return out

    def judge(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in kinds, calibrated probability of a secret) of every window."""
        p = self.probabilities(w)
        return p[:, 1:].argmax(axis=1), 1 / (1 + np.exp(-np.clip(self.slope * _odds(p) + self.shift, -50, 50)))


def _odds(p: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(1 - p[:, 0], 1e-12)) - np.log(np.maximum(p[:, 0], 1e-12))


def _parts(net: Detector) -> list[np.ndarray]:
    return [net.embed, net.filters, net.bias, net.weight, net.base]


def _flat(arrays) -> np.ndarray:
    return np.concatenate([a.ravel() for a in arrays]).astype(np.float64)


def _filled(arrays, flat) -> None:
    at = 0
    for a in arrays:
        a[...] = np.asarray(flat[at : at + a.size]).reshape(a.shape)
        at += a.size


def untrained(kinds: list[int], seed: int = 0) -> Detector:
    rng, k, n = np.random.default_rng(seed), len(WIDTHS) * FILTERS, len(kinds) + 1
    net = Detector(kinds, rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), (rng.normal(0, 0.3, (_REACH * EMBED, k)) * _MASK).astype(np.float32),
                   np.zeros(k, np.float32), rng.normal(0, 0.1, (k * len(_PARTS), n)).astype(np.float32), np.zeros(n, np.float32))
    net.embed[0] = 0
    return net


def epoch(net: Detector, first, second, w: np.ndarray, y: np.ndarray, share: np.ndarray, rng, step: int = 0) -> None:
    """One epoch over (n, WINDOW) bytes and classes, in place: Adam on the cross entropy, classes count by ``share``. In some windows of a step one side of the
    surroundings is blanked, so neither a keyword nor the candidate decides alone."""
    k, params = len(WIDTHS) * FILTERS, _parts(net)
    order = rng.permutation(len(w))
    for i in range(0, len(order), BATCH):
        at = order[i : i + BATCH]
        v, t = w[at].copy(), y[at]
        hide = rng.random(len(at))
        v[hide < 0.15, :BEFORE] = 0
        v[hide > 0.85, BEFORE + OWN :] = 0
        x = net.seen(v)
        z, place = net.responses(x)
        h = np.maximum(z, 0)
        d = _softmax(h @ net.weight + net.base)
        d[np.arange(len(at)), t] -= 1
        s = share[t]
        d = (d * (s / s.mean() / len(at))[:, None]).astype(np.float32)
        dh = (d @ net.weight.T) * (z > 0)
        rows = np.arange(len(at))[:, None]
        seen = x[rows, place]
        df = np.einsum("bk,bkr->rk", dh, seen)
        df = df.reshape(df.shape[0], len(_PARTS), k).sum(axis=1) * _MASK
        dx = (dh[:, :, None] * np.tile(net.filters.T, (len(_PARTS), 1))[None]).reshape(len(at), -1, _REACH, EMBED)
        padded = np.zeros((len(at), WINDOW + _REACH - 1), np.int64)
        padded[:, :WINDOW] = v
        ids = padded[rows[:, :, None], place[:, :, None] + np.arange(_REACH)[None, None]].ravel()
        de = np.stack([np.bincount(ids, dx[..., e].ravel(), 256) for e in range(EMBED)], axis=1).astype(np.float32)
        de[0] = 0
        step += 1
        grads = [de, df, dh.reshape(len(at), len(_PARTS), k).sum(axis=(0, 1)), h.T @ d, d.sum(0)]
        for p, g, m, q in zip(params, grads, first, second):
            m += 0.1 * (g - m)
            q += 0.01 * (g * g - q)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-8)


def fit(windows: DataFrame, kinds: list[int], share: np.ndarray, shards: int, seed: int = 0) -> Detector:
    """Train on all rows (place, seen, y) of ``windows``. The groups of an epoch start from the same weights; what they end with is averaged by their rows."""
    net = untrained(kinds, seed)
    first, second = ([np.zeros_like(p) for p in _parts(net)] for _ in range(2))
    data = windows.select(F.pmod("place", F.lit(shards)).cast("int").alias("shard"), "place", "seen", "y").persist()
    try:
        for e in range(EPOCHS):
            start = _flat([*_parts(net), *first, *second])

            def trained(key, table):
                own = untrained(kinds)
                m, q = ([np.zeros_like(p) for p in _parts(own)] for _ in range(2))
                _filled([*_parts(own), *m, *q], start)
                rows = sorted(zip(table["place"].to_pylist(), table["seen"].to_pylist(), table["y"].to_pylist()))
                w = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, WINDOW)
                epoch(own, m, q, w, np.array([r[2] for r in rows]), share, np.random.default_rng([seed, e, key[0].as_py()]), e * -(-len(rows) // BATCH))
                return pa.table({"n": [len(rows)], "v": [_flat([*_parts(own), *m, *q])]}, schema=_TRAINED)

            ends = data.groupBy("shard").applyInArrow(trained, "n long, v array<double>").select("n", F.posexplode("v").alias("i", "v"))
            mean = {r.i: r.v for r in ends.groupBy("i").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("v")).collect()}  # as many as the network has weights
            _filled([*_parts(net), *first, *second], [mean[i] for i in range(len(start))])
    finally:
        data.unpersist()
    return net


_TRAINED = pa.schema([("n", pa.int64()), ("v", pa.list_(pa.float64()))])


def calibrate(net: Detector, windows: DataFrame, counts: list[int], recall: float = RECALL) -> Detector:
    """Platt scaling of the log odds on the rows (seen, y) that training did not see (Newton steps, targets drawn in from 0 and 1), then the highest threshold of
    each kind that keeps its recall. ``counts``: rows of every class. A kind without such windows takes the highest threshold of the others."""
    def odds(batches):
        for b in batches:
            w = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, WINDOW)
            yield pa.record_batch([b.column(1), pa.array(_odds(net.probabilities(w)))], names=["y", "odds"])

    scored = windows.select("seen", "y").mapInArrow(odds, "y int, odds double").persist()
    try:
        up, down = sum(counts[1:]), counts[0]
        target, o, theta = F.when(F.col("y") > 0, (up + 1) / (up + 2)).otherwise(1 / (down + 2)), F.col("odds"), np.array([1.0, 0.0])
        for _ in range(50):
            z = F.greatest(F.least(o * float(theta[0]) + float(theta[1]), F.lit(50.0)), F.lit(-50.0))
            at = scored.select(o, target.alias("t"), (1 / (1 + F.exp(-z))).alias("p")).select(o, (F.col("p") * (1 - F.col("p"))).alias("w"), (F.col("p") - F.col("t")).alias("d"))
            r = at.agg(*[F.coalesce(F.sum(v), F.lit(0.0)) for v in (F.col("w") * o * o, F.col("w") * o, F.col("w"), F.col("d") * o, F.col("d"))]).first()
            move = np.linalg.solve(np.array([[r[0], r[1]], [r[1], r[2]]]) + 1e-6 * np.eye(2), np.array([r[3], r[4]]))
            theta = theta - np.clip(move, -2, 2)
            if np.abs(move).max() < 1e-8:
                break
        net.slope, net.shift = float(max(theta[0], 1e-3)), float(theta[1])
        cut = []
        for k, n in enumerate(counts[1:], 1):
            at = n - int(np.ceil(recall * n))  # how many may fall below
            low = exact_quantiles(scored.filter(F.col("y") == k), o, [max(0.0, at - 1e-6) / max(1, n - 1)], (), ["v"]).first()["v"] if n else None
            cut.append(None if low is None else float(1 / (1 + np.exp(-np.clip(net.slope * low + net.shift, -50, 50)))))
    finally:
        scored.unpersist()
    top = max((c for c in cut if c is not None), default=1.0)
    net.thresholds = tuple(top if c is None else c for c in cut)
    return net


def _chunks(batches):
    """(record batch, texts) of bounded runs of rows; null texts are empty."""
    for b in batches:
        _, offs = buffer_of(b.column(1))
        for lo, hi in row_chunks(offs):
            part = b.slice(lo, hi - lo)
            yield part, [t or "" for t in part.column(1).to_pylist()]


def _labelled(batches):
    """(kind, place, window) of the candidates; the place is a hash of the window."""
    import xxhash
    for _, texts in _chunks(batches):
        kinds, places, seen = [], [], []
        for t in texts:
            for lo, hi, rule in candidates(t, rule_spans(t)):
                w = windows(t, lo, hi)[0].tobytes()
                kinds.append(rule)
                places.append(xxhash.xxh64_intdigest(w) >> 1)
                seen.append(w)
        yield pa.record_batch([pa.array(kinds, pa.int32()), pa.array(places, pa.int64()), pa.array(seen, pa.binary())], names=["kind", "place", "seen"])


def labelled(documents: DataFrame, text: str = "text", seed: int = 0) -> DataFrame:
    """(kind, place, seen, held) of all different windows of every kind of candidate. The findings of the rules are the labels; candidates
    that they do not touch (kind -1) are no secrets. ``held`` is a hashed draw of a share of HELD."""
    rows = documents.select(F.lit(0).alias("one"), F.col(text).alias("text"))
    draw = F.pmod(F.xxhash64("place", F.lit(seed)), F.lit(1_000_000)) < int(HELD * 1_000_000)
    return rows.mapInArrow(_labelled, "kind int, place long, seen binary").distinct().withColumn("held", draw)


def train(documents: DataFrame, text: str = "text", recall: float = RECALL, seed: int = 0) -> Detector | None:
    """A calibrated detector; None where the documents lack secrets or other strings. Every different window trains it or, held out, calibrates it."""
    seen = settled(labelled(documents, text, seed), "windows")
    found = {(r.kind, r.held): (r.n, r.place) for r in seen.groupBy("kind", "held").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place")).collect()}
    kinds = sorted({k for k, _ in found} - {-1})
    if not kinds or not any(k == -1 for k, _ in found):
        return None
    held, n = F.col("held"), {(c, h): found.get((k, h), (0, 0))[0] for c, k in enumerate((-1, *kinds)) for h in (True, False)}
    for c, k in enumerate((-1, *kinds)):  # both parts need every class that has two windows
        for h in (True, False):
            if n[c, h] > 1 and not n[c, not h]:
                held = F.when((F.col("kind") == k) & (F.col("place") == found[k, h][1]), F.lit(not h)).otherwise(held)
                n[c, h], n[c, not h] = n[c, h] - 1, 1
                break
    if not n[0, False] or not any(n[c, False] for c in range(1, len(kinds) + 1)):
        return None
    y = F.element_at(F.create_map(*[v for c, k in enumerate((-1, *kinds)) for v in (F.lit(k), F.lit(c))]), F.col("kind"))
    rows = seen.select("place", "seen", y.alias("y"), held.alias("held"))
    size = [n[c, False] for c in range(len(kinds) + 1)]
    net = fit(rows.filter("NOT held"), kinds, 1 / np.maximum(size, 1), -(-sum(size) // SHARD), seed)
    return calibrate(net, rows.filter("held"), [n[c, True] for c in range(len(kinds) + 1)], recall)


_FINDING = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("findings", pa.list_(_FINDING))])


def _found(net: Detector | None):
    def run(batches):
        for part, texts in _chunks(batches):
            rules = [rule_spans(t) for t in texts]
            strings = [candidates(t, f) for t, f in zip(texts, rules)]
            scores: list[dict] = [{} for _ in texts]
            if net is not None:
                seen, owner = [], []
                for i, (t, cs) in enumerate(zip(texts, strings)):
                    for lo, hi, rule in cs:
                        for w in windows(t, lo, hi):
                            seen.append(w)
                            owner.append((i, lo, hi, rule))
                for a in range(0, len(seen), 4096):
                    for (i, lo, hi, rule), k, p in zip(owner[a : a + 4096], *(v.tolist() for v in net.judge(np.array(seen[a : a + 4096])))):
                        old = scores[i].get((lo, hi), (0.0, False))
                        scores[i][lo, hi] = (max(old[0], p), old[1] or rule < 0 and p >= net.thresholds[k])
            out = []
            for f, s in zip(rules, scores):
                spans = [(lo, rule, hi, RULES[rule], s.get((a, b), (None,))[0]) for lo, hi, rule, a, b in f]
                spans += [(lo, len(RULES), hi, ADDED, p) for (lo, hi), (p, new) in s.items() if new]
                out.append([{"kind": kind, "start": lo, "end": hi, "score": p} for lo, _, hi, kind, p in sorted(spans, key=lambda x: x[:3])])
            yield pa.record_batch([part.column(0), pa.array(out, pa.list_(_FINDING))], schema=_OUT)
    return run


def scanned(documents: DataFrame, net: Detector | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, findings (kind, start, end, score), by start and kind; places in code points, ends exclusive.

    The score is the calibrated probability of a secret (null without a detector). Null and empty texts have no findings; ids may be null or repeat; an
    empty table gives an empty result; further columns are not read."""
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_found(net), "doc_id long, findings array<struct<kind: string, start: long, end: long, score: double>>")


def digests(found: DataFrame) -> DataFrame:
    """Counts of the rules' findings, a digest of them, and all spans."""
    base = F.filter("findings", lambda f: f["kind"] != ADDED)
    listed = lambda spans: F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    counts = [F.expr(f"size(filter(findings, f -> f.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in RULES]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"))


def query(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return digests(scanned(documents, train(documents)))
