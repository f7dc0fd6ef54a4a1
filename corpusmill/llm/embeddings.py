"""Embedding near-duplicates: tiles in the order of principal components, dropped once cosine cannot reach the threshold."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import durable, require, small, small_batches, written
from corpusmill.llm.components import connected_components
from corpusmill.llm.simhash import Forest

#: Blocks into which vectors are cut at least, the least and the most vectors of a block, and those of a tile that is compared at once.
BLOCKS, LEAST, MOST, TILE = 8, 512, 131_072, 1_024

#: Leading components that cut blocks and bound them, and vectors on which the cuts are fitted, those that hash least.
LEADING, SAMPLE = 8, 16_384

#: Share of a unit vector's square that the leading dimensions hold when the bound is tried.
_STEPS = (0.25, 0.5)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares neither overflow nor vanish and no digit changes."""
    top = np.abs(x).max(1, keepdims=True, initial=0.0)
    return np.ldexp(x, -np.frexp(np.where(top == 0, 1.0, top))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class BlockTree:
    """Cuts at the median of the component that spreads most, until there are as many blocks as asked for."""

    def __init__(self, sample: np.ndarray, blocks: int):
        self.cuts: list[tuple[int, float, int, int] | int] = []
        self.blocks = 0
        self._cut(sample, blocks)

    def _cut(self, points: np.ndarray, blocks: int) -> int:
        at = len(self.cuts)
        self.cuts.append(self.blocks)
        if blocks > 1 and len(points) > 1:
            axis = int(np.argmax(points.var(0)))
            value = float(np.quantile(points[:, axis], (blocks // 2) / blocks))
            low = points[:, axis] <= value
            if low.any() and not low.all():
                self.cuts[at] = (axis, value, self._cut(points[low], blocks // 2), self._cut(points[~low], blocks - blocks // 2))
                return at
        self.blocks += 1
        return at

    def route(self, points: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(points), np.int64), [(0, np.arange(len(points)))]
        while todo:
            at, own = todo.pop()
            node = self.cuts[at]
            if isinstance(node, int):
                out[own] = node
                continue
            low = points[own, node[0]] <= node[1]
            todo += [(node[2], own[low]), (node[3], own[~low])]
        return out


def _apart(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> np.ndarray:
    """Least distances of a box to each of several."""
    gap = np.maximum(np.maximum(other_low - high, low - other_high), 0)
    return np.sqrt((gap**2).sum(-1))


def linked_tiles(a: np.ndarray, b: np.ndarray, plain_a: np.ndarray, plain_b: np.ndarray, threshold: float, cuts: list[int]):
    """Yield (rows of a, rows of b) of the pairs with a cosine of at least ``threshold``, tile by tile.

    The rows are unit vectors in the order of principal components; ``plain_a`` and ``plain_b`` are the
    vectors as they were, by which the last word is said. Tiles whose boxes of leading components lie
    too far apart are passed over. After the leading dimensions up
    to a cut, what remains of a product is at most the product of the suffix norms (Cauchy and
    Schwarz); pairs that cannot reach the threshold stop there, and a tile without others stops whole.
    """
    tails_a = [np.sqrt((a[:, c:] ** 2).sum(1)) for c in cuts]
    tails_b = [np.sqrt((b[:, c:] ** 2).sum(1)) for c in cuts]
    slack = threshold - 1e-9
    too_far = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    boxes = [[(t[:, :LEADING].min(0), t[:, :LEADING].max(0)) for t in (side[i : i + TILE] for i in range(0, len(side), TILE))] for side in (a, b)]
    lengths_a, lengths_b = (np.sqrt((p * p).sum(1)) for p in (plain_a, plain_b))
    for i in range(0, len(a), TILE):
        for j in range(0, len(b), TILE):
            if _apart(*boxes[0][i // TILE], *boxes[1][j // TILE]) > too_far:
                continue
            x, y = a[i : i + TILE], b[j : j + TILE]
            partial, start, rows, cols = None, 0, None, None
            for k, cut in enumerate(cuts):
                ta, tb = tails_a[k][i : i + TILE], tails_b[k][j : j + TILE]
                if rows is None:
                    part = x[:, start:cut] @ y[:, start:cut].T
                    partial = part if partial is None else partial + part
                    alive = partial + ta[:, None] * tb[None, :] >= slack
                    n = np.count_nonzero(alive)
                    if n <= alive.size // 32 or k == len(cuts) - 1:
                        rows, cols = np.nonzero(alive)
                        partial = partial[rows, cols]
                else:
                    partial = partial + np.einsum("ij,ij->i", x[rows, start:cut], y[cols, start:cut])
                    alive = partial + ta[rows] * tb[cols] >= slack
                    rows, cols, partial = rows[alive], cols[alive], partial[alive]
                start = cut
                if rows is not None and not len(rows):
                    break
            if rows is not None and len(rows):
                found = np.zeros(len(rows), bool)
                for s in range(0, len(rows), 1 << 16):  # the cosine itself, in double precision
                    r, c = rows[s : s + (1 << 16)] + i, cols[s : s + (1 << 16)] + j
                    found[s : s + (1 << 16)] = np.einsum("ij,ij->i", plain_a[r], plain_b[c]) / (lengths_a[r] * lengths_b[c]) >= threshold
                if found.any():
                    yield rows[found] + i, cols[found] + j


def cosine_components(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Link vectors whose cosine is at least ``threshold``; count links and name components.

    Equal vectors are one class, so groups of copies are one row of the comparison. The second
    moments of all classes give the principal components. Classes are cut into blocks by the leading
    ones; each block's box of these is exact, over all its vectors, and blocks whose boxes lie further
    apart than two linked unit vectors can are never compared; each other pair of blocks is one task.
    A task gives a link count and the root among its links for each class, not its pairs.

    Returns ``id_col, n_links, component_id, kept``, one row for each row of ``vectors``. Vectors
    that are null, empty, zero, or hold null or non-finite components, and those of another length
    than most, link with nothing of the usual length: 0 links, themselves as component. A null id is
    the least of none; ``kept`` is false for it. An empty table gives no rows; other columns are not
    read.
    """
    require(vectors, id=id_col, vector=vector_col)
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    finite = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(finite, F.lit(False)))
    rows = rows.withColumn("cls", F.when(F.col("good"), F.xxhash64("v"))).withColumn("dim", F.when(F.col("good"), F.size("v")))
    lengths = [r.dim for r in rows.where("good").groupBy("dim").count().orderBy("dim").collect()]
    classes = durable(rows.where("good").groupBy("cls").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"), F.first("dim").alias("dim")))
    links, edges = None, None
    for dim in lengths:
        count, edge = _block_links(classes.where(F.col("dim") == dim).select("cls", "n", "v"), dim, threshold)
        links = count if links is None else links.union(count)
        edges = edge if edges is None else edges.union(edge)
    if links is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    links = links.groupBy("cls").agg(F.sum("links").alias("links"))
    components = durable(connected_components(edges).withColumnRenamed("node", "cls"))
    named = classes.select("cls", "least", "n").join(links, "cls", "left").join(components, "cls", "left")
    named = durable(named.select("cls", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "cls").alias("root")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = named.join(least, "root").select("cls", "n_links", "component_id")
    found = rows.where("good").select("id", "cls").join(of_class, "cls").select("id", "n_links", "component_id")
    alone = rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return found.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _block_links(classes: DataFrame, dim: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    spark = classes.sparkSession

    def moments(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _unit(_matrix(batch.column(0)))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], names=["k", "s"])

    sums = classes.select("v").mapInArrow(moments, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).toArrow()
    second = np.zeros(dim * dim)
    second[sums["k"].to_numpy()] = sums["s"].to_numpy()
    second = second.reshape(dim, dim)
    values, axes = np.linalg.eigh((second + second.T) / 2)
    values, axes = np.maximum(values[::-1], 0), np.ascontiguousarray(axes[:, ::-1])
    held = np.cumsum(values) / max(values.sum(), 1e-300)
    cuts = sorted({max(1, min(dim, int(np.searchsorted(held, s)) + 1)) for s in _STEPS} | {dim})
    shared = spark.sparkContext.broadcast(axes)
    leading = min(LEADING, dim)
    n = classes.count()
    blocks = max(1, -(-n // min(MOST, max(LEAST, -(-n // BLOCKS)))))
    sample = classes.orderBy(F.xxhash64(F.lit(9), "cls")).limit(SAMPLE).select("v").toArrow()
    tree = BlockTree(_unit(_matrix(sample["v"])) @ axes[:, :leading], blocks)
    kind = dict(classes.dtypes)["v"]

    def place(batches):
        for batch in batches:
            x = _unit(_matrix(batch.column(2))) @ shared.value[:, :leading]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.route(x) if batch.num_rows else [], pa.int64())], names=["cls", "n", "v", "own"])

    def bound(batches):
        low, high = np.full((tree.blocks, leading), np.inf), np.full((tree.blocks, leading), -np.inf)
        for batch in batches:
            if batch.num_rows:
                x, own = _unit(_matrix(batch.column(0))) @ shared.value[:, :leading], batch.column(1).to_numpy()
                np.minimum.at(low, own, x)
                np.maximum.at(high, own, x)
        own = np.flatnonzero(np.isfinite(low[:, 0]))
        for k in range(leading):
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), k)), pa.array(low[own, k]), pa.array(high[own, k])], names=["own", "k", "low", "high"])

    placed = written(classes.mapInArrow(place, f"cls long, n long, v {kind}, own long"), "placed")
    boxes = placed.select("v", "own").mapInArrow(bound, "own long, k long, low double, high double").groupBy("own", "k").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
    low, high = np.full((tree.blocks, leading), np.inf), np.full((tree.blocks, leading), -np.inf)
    at = boxes["own"].to_numpy(), boxes["k"].to_numpy()
    low[at], high[at] = boxes["low"].to_numpy(), boxes["high"].to_numpy()
    bounds = spark.sparkContext.broadcast((low, high))  # 16 numbers for thousands of vectors
    too_far = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9

    def meet(batches):
        low, high = bounds.value
        for batch in batches:
            for block in batch.column(0).to_numpy():
                near = block + np.flatnonzero(_apart(low[block], high[block], low[block:], high[block:]) <= too_far)
                first, second = np.full(len(near), block), near
                both = np.concatenate([first, second[second != block]])
                lows, highs = np.concatenate([first, first[second != block]]), np.concatenate([second, second[second != block]])
                yield pa.RecordBatch.from_arrays([pa.array(both), pa.array(lows), pa.array(highs)], names=["own", "low", "high"])

    pairs = written(spark.range(tree.blocks).mapInArrow(meet, "own long, low long, high long"), "pairs")
    dealt = placed.join(small(pairs), "own")

    def compare(key, table):
        low, high = key[0].as_py(), key[1].as_py()
        where, cls, n = table["own"].to_numpy(), table["cls"].to_numpy(), table["n"].to_numpy()
        plain = _scaled(_matrix(table["v"]))
        x = _unit(plain) @ shared.value
        order = np.lexsort((cls, x[:, 0]))
        x, plain, where, cls, n = x[order], plain[order], where[order], cls[order], n[order]
        a, b = np.flatnonzero(where == low), np.flatnonzero(where == high)
        links, forest = np.zeros(len(cls), np.int64), Forest(len(cls))
        for r, c in linked_tiles(x[a], x[b], plain[a], plain[b], threshold, cuts):
            r, c = a[r], b[c]
            if low == high:
                keep = r < c
                r, c = r[keep], c[keep]
            np.add.at(links, r, n[c])
            np.add.at(links, c, n[r])
            # a tile's links join few sets, however many they are
            rows, back_r = np.unique(r, return_inverse=True)
            cols, back_c = np.unique(c, return_inverse=True)
            root_r, root_c = (np.array([forest.root(k) for k in own.tolist()], np.int64) for own in (rows, cols))
            joined = np.unique(np.stack([root_r[back_r], root_c[back_c]]), axis=1) if len(r) else np.zeros((2, 0), np.int64)
            for p, q in joined.T.tolist():
                forest.join(p, q)
        root = np.array([forest.root(i) for i in range(len(cls))], int)
        some = links > 0
        return pa.table({"cls": cls[some], "links": links[some], "root": cls[root[some]]})

    found = durable(dealt.groupBy("low", "high").applyInArrow(compare, "cls long, links long, root long"))
    return found.select("cls", "links"), found.select(F.col("cls").alias("a"), F.col("root").alias("b"))
