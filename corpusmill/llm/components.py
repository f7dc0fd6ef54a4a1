"""Connected components of a graph that no machine holds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import BROADCAST_NUMBERS, batch_of, durable

#: Distinct links up to which one task joins them; rounds of more tasks cost the driver more than they save.
ONE_TASK = BROADCAST_NUMBERS // 2


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, root`` from all links: roots hook to the least root that they have a link with, until none is left."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, further := root[root]):
            root = further
    yield batch_of(("node", "root"), (pa.int64(), pa.int64()), (pa.array(nodes), pa.array(nodes[root])))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """The smallest node that each node reaches, from ``edges(a, b)`` of long columns.

    Alternates two steps until nothing changes (Kiveris and others, 2014): each node joins its
    larger neighbours to its smallest one, then itself and its smaller neighbours. Both are a
    minimum by node, which is summed before the shuffle, and a join whose other side has one row a
    node; a node with very many links is split by the adaptive join. Rounds grow as the logarithm
    of the longest chain. Each round is checkpointed. Up to ``ONE_TASK`` distinct links, by an exact
    count, are joined by one task instead.

    Returns ``node, root``. Nodes without links are absent; an empty table gives no rows; loops and
    repeated links are harmless; a null on either side is no link.
    """

    def star(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        return pairs.join(least, "u")

    now = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b").distinct())
    if now.count() <= ONE_TASK:
        return now.coalesce(1).mapInArrow(_joined, "node long, root long")
    seen = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every larger neighbour goes to the least of the neighbours and the node
        large = star(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        # small star: the node and its smaller neighbours go to the least of them
        own = star(large)
        small = own.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        now = durable(small)
        mark = tuple(now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("v", "u") % 1_000_003), F.lit(0))).first())
        if mark == seen or mark[0] == 0:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
