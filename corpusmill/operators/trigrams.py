"""Counts of each text's trigrams and their contexts at their places, with one exchange of packed words.

A task cuts its texts into pieces of about ``PIECE`` words and deals the trigrams of a piece into slices by a hash of their first two
words. What crosses for a piece and slice is one row: the words that occur, the distinct trigrams with their counts, and the places of
each, in byte planes that compress well; some six bytes a word. A slice then has all trigrams of its contexts, so its counts are exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators.tokens import PAD

#: Words of a piece, which a task holds at once; a longer text is a piece of its own.
PIECE = 1_500_000

#: Bytes of text to a slice, on average.
SLICE = 16_000_000

#: Rows of a batch that goes back.
BATCH = 200_000

_PACKED = "slice long, n_grams int, n_places int, n_bytes int, words binary, grams binary, places binary"

#: Stands for a null id on its way.
_NULL = -(1 << 63)


def _held(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL))


def _given(id_col: str) -> Column:
    return F.nullif(F.col(id_col), F.lit(_NULL))


def _planes(*arrays: np.ndarray) -> bytes:
    raw = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes() for a in arrays)
    return pa.compress(raw, codec="zstd", asbytes=True)


def _arrays(packed: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    raw = np.frombuffer(pa.decompress(packed, n * sum(sizes), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Keys, numbers of words and words of as many texts as make a piece."""
    held, n = [], 0

    def joined():
        return np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), pa.concat_arrays([h[2] for h in held])

    for batch in batches:
        words = batch.column(1)
        size = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        key, flat, ends = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), words.flatten(), np.cumsum(size)
        first = done = 0
        while first < len(size):
            last = max(first + 1, int(np.searchsorted(ends, done + PIECE - n, "right")))
            upto = int(ends[last - 1])
            held.append((key[first:last], size[first:last], flat[done:upto]))
            n += upto - done
            first, done = last, upto
            if n >= PIECE or (first < len(size) and n):
                yield joined()
                held, n = [], 0
    if n:
        yield joined()


def _packer(slices: int, places: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, size, flat in _pieces(batches):
            coded = flat.dictionary_encode()
            c = coded.indices.to_numpy().astype(np.int64)
            words = [*coded.dictionary.to_pylist(), PAD]
            hashes = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint64, len(words))
            pad, start = len(words) - 1, np.cumsum(size) - size
            i = np.arange(len(c)) - np.repeat(start, size)
            b, a = np.empty_like(c), np.empty_like(c)
            b[1:], a[2:] = c[:-1], c[:-2]
            b[i < 1], a[i < 2] = pad, pad
            mixed = (hashes[a] * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes[b] * np.uint64(0xC2B2AE3D27D4EB4F))
            part = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64) % slices
            bits = len(words).bit_length()
            if slices.bit_length() + 3 * bits <= 63:
                order = np.argsort((((part << bits | a) << bits) | b) << bits | c)
            else:
                order = np.lexsort((c, b, a, part))
            part, a, b, c = part[order], a[order], b[order], c[order]
            new = np.ones(len(c), bool)
            new[1:] = (c[1:] != c[:-1]) | (b[1:] != b[:-1]) | (a[1:] != a[:-1])
            at = np.flatnonzero(new)
            n = np.diff(at, append=len(c))
            a, b, c = a[at], b[at], c[at]
            if places:
                ident, i = np.repeat(key, size)[order], i[order].astype("<i4")
            else:  # the key is a flag, and its sum stands for the places
                n_flagged = np.add.reduceat(np.repeat(key, size)[order], at)
            cut = np.flatnonzero(np.diff(part[at], prepend=-1))
            rows = []
            for lo, hi in zip(cut, [*cut[1:], len(at)], strict=True):
                local, codes = np.unique(np.concatenate([a[lo:hi], b[lo:hi], c[lo:hi]]), return_inverse=True)
                codes = codes.astype("<i4").reshape(3, -1)
                spelled = "\n".join([words[k] for k in local]).encode()
                u, v = int(at[lo]), int(at[hi]) if hi < len(at) else len(order)
                where = _planes(ident[u:v].astype("<i8"), i[u:v]) if places else _planes(n_flagged[lo:hi].astype("<i4"))
                rows.append((int(part[u]), hi - lo, v - u, len(spelled), pa.compress(spelled, codec="zstd", asbytes=True), _planes(*codes, n[lo:hi].astype("<i4")), where))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _PACKED.split(", ")])

    return run


def slices_of(docs: DataFrame, text_col: str = "text") -> int:
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SLICE))


def packed(docs: DataFrame, key: Column, slices: int, text_col: str = "text", places: bool = True) -> DataFrame:
    """The packed rows; ``key`` is a whole number that each word carries, or, without places, a flag of 0 or 1 of its text."""
    rows = docs.select(key.cast("long").alias("key"), T.words(F.col(text_col)).alias("words"))
    return rows.mapInArrow(_packer(slices, places), _PACKED)


def _counted(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each packed row's distinct trigrams, in order: the counts of the trigram and of its context in the slice; where each row begins."""
    spelled, a, b, c, n = [], [], [], [], []
    total = 0
    for u, w, words, grams in zip(*(rows[k].to_pylist() for k in ("n_grams", "n_bytes", "words", "grams")), strict=True):
        own = pa.decompress(words, w, codec="zstd", asbytes=True).decode().split("\n")
        x, y, z, m = _arrays(grams, u, "<i4", "<i4", "<i4", "<i4")
        spelled += own
        for to, codes in ((a, x), (b, y), (c, z)):
            to.append(codes.astype(np.int64) + total)
        n.append(m)
        total += len(own)
    coded = pa.array(spelled, pa.large_string()).dictionary_encode()
    ids, v = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    del spelled, coded
    m = np.concatenate(n).astype(np.float64)  # sums are exact up to 2 ** 53
    _, context = np.unique(ids[np.concatenate(a)] * v + ids[np.concatenate(b)], return_inverse=True)
    _, gram = np.unique(context * v + ids[np.concatenate(c)], return_inverse=True)
    begins = np.concatenate([[0], np.cumsum([len(x) for x in n])])
    return np.bincount(gram, m)[gram].astype(np.int64), np.bincount(context, m)[context].astype(np.int64), begins


def trigram_counts_at(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, i, c3, c2``: for each word, from 0 in its text, the count of the trigram that ends there and of its context, padded before a text's first.

    The id is a whole number. A slice is held packed, and its distinct trigrams unpacked.
    """

    def unpack(rows: pa.Table) -> pa.Table:
        c3, c2, begins = _counted(rows)
        out = []
        for k, (u, t, grams, places) in enumerate(zip(*(rows[x].to_pylist() for x in ("n_grams", "n_places", "grams", "places")), strict=True)):
            ident, i = _arrays(places, t, "<i8", "<i4")
            n = _arrays(grams, u, "<i4", "<i4", "<i4", "<i4")[3]
            own = slice(begins[k], begins[k + 1])
            columns = [ident, i, np.repeat(c3[own], n), np.repeat(c2[own], n)]
            out += [pa.RecordBatch.from_arrays([pa.array(x[s : s + BATCH]) for x in columns], names=[id_col, "i", "c3", "c2"]) for s in range(0, t, BATCH)]
        return pa.Table.from_batches(out)

    own = packed(docs, _held(id_col), slices_of(docs, text_col), text_col)
    return own.groupBy("slice").applyInArrow(unpack, f"`{id_col}` long, i int, c3 long, c2 long").withColumn(id_col, _given(id_col))


def trigram_count_classes(docs: DataFrame, flag: Column, text_col: str = "text") -> DataFrame:
    """``c3, c2, n``: how many words of the flagged texts end a trigram of count c3 with a context of count c2, counted over all texts."""

    def unpack(rows: pa.Table) -> pa.Table:
        c3, c2, _ = _counted(rows)
        flagged = np.concatenate([_arrays(p, u, "<i4")[0] for p, u in zip(rows["places"].to_pylist(), rows["n_grams"].to_pylist(), strict=True)])
        order = np.lexsort((c2, c3))
        c3, c2, flagged = c3[order], c2[order], flagged[order].astype(np.int64)
        first = np.flatnonzero((np.diff(c3, prepend=-1) != 0) | (np.diff(c2, prepend=-1) != 0))
        return pa.table({"c3": c3[first], "c2": c2[first], "n": np.add.reduceat(flagged, first)})

    own = packed(docs, F.coalesce(flag, F.lit(False)).cast("int"), slices_of(docs, text_col), text_col, places=False)
    return own.groupBy("slice").applyInArrow(unpack, "c3 long, c2 long, n long").where("n > 0").groupBy("c3", "c2").agg(F.sum("n").alias("n"))


def text_summaries(docs: DataFrame, size: DataFrame, k: float, tau: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_scored, mean_surprisal, var_surprisal, n_high`` of the words' add-k surprisal in bits; ``size`` is one row, the vocabulary's ``v``.

    A slice sends the counts of its places on by a hash of the text, packed again, some three bytes a word.
    """

    def reply(rows: pa.Table) -> pa.Table:
        c3, c2, begins = _counted(rows)
        out, held, n_held = [], [], 0

        def deal():
            ident, x, y = (np.concatenate(c) for c in zip(*held, strict=True))
            to = ((ident.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % slices
            order = np.lexsort((ident, to))
            to, ident, x, y = to[order], ident[order], x[order], y[order]
            cut = np.flatnonzero(np.diff(to, prepend=-1))
            for lo, hi in zip(cut, [*cut[1:], len(to)], strict=True):
                out.append((int(to[lo]), hi - lo, _planes(np.diff(ident[lo:hi], prepend=0).astype("<i8"), x[lo:hi].astype("<i8"), y[lo:hi].astype("<i8"))))

        for row, (u, t, grams, places) in enumerate(zip(*(rows[x].to_pylist() for x in ("n_grams", "n_places", "grams", "places")), strict=True)):
            ident, _ = _arrays(places, t, "<i8", "<i4")
            n = _arrays(grams, u, "<i4", "<i4", "<i4", "<i4")[3]
            own = slice(begins[row], begins[row + 1])
            held.append((ident, np.repeat(c3[own], n), np.repeat(c2[own], n)))
            n_held += t
            if n_held >= 2 * PIECE or row + 1 == len(rows):  # one row a part for so many places, not for each packed row
                deal()
                held, n_held = [], 0
        return pa.table([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["part", "n", "counts"])

    def total(rows: pa.Table) -> pa.Table:
        found = [_arrays(p, n, "<i8", "<i8", "<i8") for p, n in zip(rows["counts"].to_pylist(), rows["n"].to_pylist(), strict=True)]
        ident, at = np.unique(np.concatenate([np.cumsum(f[0]) for f in found]), return_inverse=True)
        c3, c2 = (np.concatenate([f[j] for f in found]) for j in (1, 2))
        bits = -np.log2((c3 + k) / (c2 + k * rows["v"][0].as_py()))
        n = np.bincount(at)
        mean = np.bincount(at, bits) / n
        var = np.bincount(at, (bits - mean[at]) ** 2) / np.maximum(n - 1, 1)
        return pa.table({id_col: ident, "n_scored": n, "mean_surprisal": mean, "var_surprisal": var, "n_high": np.bincount(at, bits >= tau).astype(np.int64)})

    slices = slices_of(docs, text_col)
    sent = packed(docs, _held(id_col), slices, text_col).groupBy("slice").applyInArrow(reply, "part long, n int, counts binary")
    found = sent.crossJoin(F.broadcast(size)).groupBy("part").applyInArrow(total, f"`{id_col}` long, n_scored long, mean_surprisal double, var_surprisal double, n_high long")
    return found.withColumn(id_col, _given(id_col))
