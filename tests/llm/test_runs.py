"""Periodic runs against brute force."""

import hashlib
import zlib

import numpy as np

from conftest import SF
from siteval.llm import runs


def brute_lengths(s):
    def lyndon(w):
        return all(w < w[i:] for i in range(1, len(w)))
    return [max(j - i for j in range(i + 1, len(s) + 1) if lyndon(s[i:j])) for i in range(len(s))]


def brute_runs(w, least=6, times=4):
    out = set()
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, times * p):
                out.add((i, j + p - i, p))
            i = max(j, i) + 1
    smallest = {}
    for s, n, p in sorted(out, key=lambda r: r[2]):
        if not any(a <= s and s + n <= a + m and p % q == 0 for (a, m), q in smallest.items()):
            smallest[s, n] = p
    return sorted((s, n, p) for (s, n), p in smallest.items())


def brute_row(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = sorted(brute_runs(w), key=lambda r: (r[0], r[2]))
    dropped = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()),
            sha(b" ".join(x for i, x in enumerate(w) if i not in dropped)))


def test_phase_one_gives_lyndon_arrays():
    rng = np.random.default_rng(3)
    for _ in range(300):
        s = np.unique(rng.integers(0, rng.integers(1, 5) + 1, rng.integers(1, 30)), return_inverse=True)[1].tolist()
        assert runs.lyndon_lengths(s) == brute_lengths(s)
    assert runs.lyndon_lengths([]) == []


def test_runs_equal_brute_force():
    rng = np.random.default_rng(4)
    for k in range(400):
        base = rng.integers(0, 3 if k % 2 else 2, rng.integers(1, 9))
        s = np.concatenate([rng.integers(0, 3, rng.integers(0, 12)), np.tile(base, rng.integers(1, 8)), np.tile(base[: rng.integers(0, len(base) + 1)], 6), rng.integers(0, 3, rng.integers(0, 12))])
        assert list(map(tuple, runs.runs(s).tolist())) == brute_runs(s.tolist())


def test_query_rows_on_odd_tables(spark):
    rng = np.random.default_rng(5)
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "A a A a A a A a", "x\x0by\x0cx y x\ry x y x y", "Ü Ü Ü Ü Ü Ü Ü", "go " * 5000, " ".join(["ab ba"] * 40 + ["zz"] + ["ab ba"] * 3)]
    texts += [" ".join(f"w{i}" for i in rng.integers(0, 40, n)) for n in (5, 6, 50, 400)]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts * 6)] + [(None, "b b b b b b b", 1, "x"), (7, "c c c c c c", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, runs string")
    planted = docs.select("doc_id", runs.with_planted_runs(docs.text, docs.doc_id).alias("text"))
    got = sorted(map(tuple, runs.digests(runs.periodic_runs(planted)).collect()), key=str)
    assert got == sorted((brute_row(i, t) for i, t, *_ in rows), key=str)
    assert runs.periodic_runs(docs.limit(0)).collect() == []


def test_query_equals_brute_force(spark):
    got = {r[0]: tuple(r) for r in runs.query(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        if len((r.text or "").split()) < 1500:
            assert got[r.doc_id] == brute_row(r.doc_id, r.text)
