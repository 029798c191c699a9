"""Deterministic draws: uniforms and splits derived from hashes of keys, so any task can recompute them."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALE = float(1 << 52)
#: largest Poisson count: more have a probability below 1e-14
POISSON_TOP = 16


def key_text(*parts) -> Column:
    return F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def hash52(*parts) -> Column:
    """52 bits of MD5 as a bigint."""
    return F.conv(F.substring(F.md5(key_text(*parts)), 1, 13), 16, 10).cast("long")


def uniform(*parts) -> Column:
    """A uniform in [0, 1) that depends only on its parts."""
    return hash52(*parts) / F.lit(_SCALE)


def pick_index(n: Column, *parts) -> Column:
    """A uniform index below ``n``."""
    return F.floor(uniform(*parts) * n).cast("long")


def poisson_steps() -> list[float]:
    """The cumulated Poisson(1) probabilities: a uniform draws as many as it reaches."""
    return [math.exp(-1) * math.fsum(1 / math.factorial(j) for j in range(k + 1)) for k in range(POISSON_TOP)]


def poisson_weights(n: int, seed, key: Column) -> Column:
    """An array of ``n`` Poisson(1) counts that depend only on seed, place and key: how often an item is drawn in each bootstrap replicate."""
    below = poisson_steps()
    drawn = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: uniform(seed, b, key))
    return F.transform(drawn, lambda u: F.size(F.filter(F.array(*[F.lit(v) for v in below]), lambda v: v <= u)))


_TURNS = [v for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for v in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
#: bytes of a text that fit one block of MD5, and texts hashed at a time
_BLOCK, _AT_ONCE = 55, 1 << 14


def _heads(texts: np.ndarray) -> np.ndarray:
    """The first 52 bits of MD5 of texts of one length (rows of bytes, at most _BLOCK of them): all rows step by step."""
    size = texts.shape[1]
    block = np.zeros((len(texts), 64), np.uint8)
    block[:, :size], block[:, size], block[:, 56], block[:, 57] = texts, 0x80, 8 * size & 255, 8 * size >> 8
    w = np.ascontiguousarray(block.view("<u4").T)
    start = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(len(texts), v) for v in start)
    f, turned = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            k = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            k = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            k = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            k = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        if k <= size // 4:  # the others are the same for all texts: zero but for the length
            f += w[k]
            f += np.uint32(_SINES[i])
        else:
            f += np.uint32((_SINES[i] + (8 * size if k == 14 else 0)) % 2**32)
        np.left_shift(f, np.uint32(_TURNS[i]), out=turned)
        f >>= np.uint32(32 - _TURNS[i])
        turned |= f
        turned += b
        a, b, c, d, turned = d, turned, b, c, a
    first, second = ((v + s).byteswap().astype(np.int64) for v, s in ((a, start[0]), (b, start[1])))
    return first << 20 | second >> 12


def poisson_counts(n: int, seed, keys) -> np.ndarray:
    """The arrays of ``poisson_weights`` of many keys, given as text, as rows: for functions that run in tasks."""
    tails = [b"" if k is None else b"|" + k.encode() for k in keys]
    heads = [f"{seed}|{b}".encode() for b in range(n)]
    drawn = np.empty((len(tails), n), np.int64)
    columns, rows = ({z: [i for i, t in enumerate(v) if len(t) == z] for z in set(map(len, v))} for v in (heads, tails))
    for x, at in columns.items():
        left = np.frombuffer(b"".join(heads[i] for i in at), np.uint8).reshape(len(at), x)
        for y, own in rows.items():
            if x + y > _BLOCK:
                drawn[np.ix_(own, at)] = [[int(hashlib.md5(heads[i] + tails[j]).hexdigest()[:13], 16) for i in at] for j in own]
                continue
            right = np.frombuffer(b"".join(tails[j] for j in own), np.uint8).reshape(len(own), y)
            step = max(1, _AT_ONCE // len(at))
            for lo in range(0, len(own), step):
                part = right[lo : lo + step]
                texts = np.concatenate([np.tile(left, (len(part), 1)), np.repeat(part, len(at), axis=0)], axis=1)
                drawn[np.ix_(own[lo : lo + step], at)] = _heads(texts).reshape(len(part), len(at))
    return np.searchsorted(poisson_steps(), drawn / _SCALE, side="right")


def sha_split(key: Column) -> Column:
    """Half split by the parity of the last hex digit of SHA-256."""
    return (F.conv(F.substring(F.sha2(key.cast("string"), 256), 64, 1), 16, 10).cast("int") % 2)


def crc_split(key: Column, share: float) -> Column:
    """True for about ``share`` of keys, by CRC-32."""
    return (F.crc32(key.cast("string").cast("binary")) % 1000) < F.lit(share * 1000)
