"""Weighted sums of bootstrap samples, with md5 worked out for arrays of keys and draws at once.

The weights are those of ``profiles.bootstrap``: Poisson, by the first 32 bits of the md5 of ``key|draw|seed``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.profiles import POISSON

_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [int(abs(math.sin(k + 1)) * (1 << 32)) & 0xFFFFFFFF for k in range(64)]
_WORDS = [k if k < 16 else (5 * k + 1) % 16 if k < 32 else (3 * k + 5) % 16 if k < 48 else 7 * k % 16 for k in range(64)]

#: Least 32-bit numbers that reach each cumulative probability.
_STEPS = [math.ceil(p * (1 << 32)) for p in POISSON]

#: Hashes that are worked out at once, so that the arrays stay in the caches.
_BLOCK = 16_384

#: Sums that a task holds; beyond that it sends them on and begins anew.
_HELD = 4_000_000


def _md5_head(message: list[np.ndarray | None], shape: tuple[int, int]) -> np.ndarray:
    """First 32 bits of the md5 of one-block messages, by their 16 words, None for 0; arrays broadcast to the shape."""
    a, b, c, d = (np.full(shape, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for k in range(64):
        if k < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif k < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif k < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, np.uint32(_SINES[k]), out=f)
        word = message[_WORDS[k]]
        if word is not None:
            np.add(f, word, out=f)
        np.left_shift(f, np.uint32(_TURNS[k]), out=t)
        np.right_shift(f, np.uint32(32 - _TURNS[k]), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=a)  # the new b; what a held is used up
        a, b, c, d = d, a, b, c
    a += np.uint32(0x67452301)
    return a.byteswap()


def _draw_words(offset: int, draws: int, seed: str) -> list[np.ndarray | None]:
    """The words of ``draw|seed`` and what ends the message, where a key and its bar take the bytes before the offset."""
    raw = np.zeros((draws, 64), np.uint8)
    for k in range(draws):
        tail = f"{k}|{seed}".encode()
        n = offset + len(tail)
        raw[k, offset:n] = np.frombuffer(tail, np.uint8)
        raw[k, n] = 0x80
        raw[k, 56:58] = np.frombuffer((8 * n).to_bytes(2, "little"), np.uint8)
    words = raw.view("<u4")
    return [np.ascontiguousarray(words[:, j]) if words[:, j].any() else None for j in range(16)]


def weights(keys: list[str], draws: int, seed: str, tails: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Which keys, and their weights in each draw as rows, for all keys; ``tails`` keeps what keys of one length share."""
    coded = [f"{k}|".encode() for k in keys]
    sizes = np.array([len(c) for c in coded])
    longest = len(f"{draws}|{seed}".encode())
    step = max(1, _BLOCK // draws)
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        if size + longest <= 55 and size not in tails:
            tails[size] = _draw_words(int(size), draws, seed)
        for s in range(0, len(own), step):
            some = own[s : s + step]
            if size in tails:
                raw = np.zeros((len(some), 64), np.uint8)
                raw[:, :size] = np.frombuffer(b"".join(coded[k] for k in some), np.uint8).reshape(len(some), size)
                head = raw.view("<u4")
                message = [None if t is None and 4 * j >= size else (head[:, j : j + 1] if t is None else t if 4 * j >= size else head[:, j : j + 1] | t) for j, t in enumerate(tails[size])]
                bits = _md5_head(message, (len(some), draws))
            else:
                heads = [hashlib.md5(coded[k] + f"{j}|{seed}".encode(), usedforsecurity=False).digest()[:4] for k in some for j in range(draws)]
                bits = np.frombuffer(b"".join(heads), ">u4").astype(np.uint32).reshape(len(some), draws)
            w = np.zeros(bits.shape, np.uint8)
            for least in _STEPS:
                w += bits >= np.uint32(least)
            yield some, w.astype(np.float64)


def correlation_of_sums() -> Column:
    """Pearson correlation from sums ``n, sx, sy, sxx, syy, sxy``."""
    n, sx, sy, sxx, syy, sxy = (F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))
    return F.try_divide(n * sxy - sx * sy, F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)))


def bootstrap_sums(df: DataFrame, key: str, stratum: str, draws: int, terms: dict[str, Column], seed: str) -> DataFrame:
    """``stratum, draw``, and for each term the sum over the rows of weight times term: nulls and rows of a null key add nothing.

    Each row costs as many hashes as there are draws, so rows are dealt to all cores, however small their file. Each task sends one row a stratum and draw. A draw's sums are of all rows of its stratum.
    """
    kind, names = dict(df.dtypes)[stratum], list(terms)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * df.sparkSession.sparkContext.defaultParallelism)
    rows = df.where(F.col(key).isNotNull()).repartition(parts, key).select(F.col(key).cast("string").alias("__key"), F.col(stratum).alias("__s"), F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in terms.values()]).alias("__t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        tails: dict = {}
        what = None

        def told():
            for s, sums in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([s] * draws, what), pa.array(np.arange(draws, dtype=np.int32)), *[pa.array(x) for x in sums]], names=[stratum, "draw", *names])

        for batch in batches:
            what = batch.schema.field(1).type
            keys = batch.column(0).to_pylist()
            values = batch.column(2).flatten().to_numpy().reshape(len(keys), len(names))
            coded = batch.column(1).dictionary_encode("encode")
            code, strata = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            for at, s in enumerate(strata):
                own = np.flatnonzero(code == at)
                sums = held.setdefault(s, np.zeros((len(names), draws)))
                for some, w in weights([keys[k] for k in own], draws, seed, tails):
                    sums += values[own[some]].T @ w
                if len(held) * len(names) * draws > _HELD:
                    yield from told()
                    held.clear()
        yield from told()

    schema = f"`{stratum}` {kind}, draw int, " + ", ".join(f"`{n}` double" for n in names)
    return rows.mapInArrow(run, schema).groupBy(stratum, "draw").agg(*[F.sum(n).alias(n) for n in names])
