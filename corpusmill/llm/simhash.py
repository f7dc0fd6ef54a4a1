"""SimHash near-duplicates: fingerprints in a vantage-point tree whose shards overlap at their boundaries."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import as_bytes, batch_of, durable, require, small_batches, written
from corpusmill.llm.components import connected_components

#: Distinct fingerprints that the routing tree is fitted on, and those that a shard has on average.
TREE_SAMPLE, SHARD = 16_384, 8_192

#: Within a shard, tree leaves up to this size are compared directly.
LEAF = 512

_BLOCK = 1 << 16

#: Sets of a block, and common shingles of two blocks that are counted at once.
BLOCK_SETS, COUNTED_AT_ONCE = 128, 1 << 22


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included; 0 without words."""
    words = text.lower().split()  # bytes: A-Z alone, and the six ASCII spaces alone
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)))
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for start in range(0, len(grams), _BLOCK):
        part = grams[start : start + _BLOCK]
        h = np.fromiter((digest(g, seed) for g in part), "<u8", len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(grams), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fp`` with the fingerprint as a signed long, one row for each row of ``docs``."""
    require(docs, id=id_col, text=text_col)
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def apply(batches):
        for batch in batches:
            found = np.array([fingerprint(t, shingle, seed) for t in as_bytes(batch.column(1))], np.uint64)
            yield batch_of((id_col, "fp"), (batch.column(0).type, pa.int64()), (batch.column(0), pa.array(found.view(np.int64))))

    return docs.select(id_col, text_col).mapInArrow(apply, f"`{id_col}` {kind}, fp long")


def split(points: np.ndarray, pick: int) -> tuple[np.uint64, int]:
    """A vantage point among the points and the median distance to it, the radius of its ball."""
    vantage = points[pick % len(points)]
    return vantage, int(np.median(np.bitwise_count(points ^ vantage)))


class VantageTree:
    """Vantage points and radii of a binary tree, as plain lists; a shard is a leaf.

    A point within the radius goes inside, another outside; one outside by no more than the link
    distance also goes inside, as by the triangle inequality a partner of it may be there. So any
    two points within the link distance of each other share a leaf.
    """

    def __init__(self, sample: np.ndarray, depth: int, reach: int):
        self.reach = reach
        self.nodes: list[tuple[int, int, int, int] | None] = []
        self.leaves = 0
        self.leaf_of: dict[int, int] = {}
        self._build(sample, depth)

    def _build(self, points: np.ndarray, depth: int) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        if depth > 0 and len(points) > 1:
            vantage, radius = split(points, at * 7919)
            inside = np.bitwise_count(points ^ vantage) <= radius
            if inside.any() and not inside.all():
                left = self._build(points[inside], depth - 1)
                right = self._build(points[~inside], depth - 1)
                self.nodes[at] = (int(vantage), radius, left, right)
                return at
        self.leaf_of[at] = self.leaves
        self.leaves += 1
        return at

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the point, leaf), once for each leaf that the point goes to."""
        rows, leaves = [], []
        todo = [(0, np.arange(len(points)))]
        while todo:
            at, own = todo.pop()
            if not len(own):
                continue
            node = self.nodes[at]
            if node is None:
                rows.append(own)
                leaves.append(np.full(len(own), self.leaf_of[at]))
                continue
            distance = np.bitwise_count(points[own] ^ np.uint64(node[0])).astype(int)
            todo.append((node[2], own[distance <= node[1] + self.reach]))
            todo.append((node[3], own[distance > node[1]]))
        if not rows:
            return np.empty(0, int), np.empty(0, int)
        return np.concatenate(rows), np.concatenate(leaves)


class Forest:
    """Union-find over positions; the least position of a set is its root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _leaf_links(points: np.ndarray, own: np.ndarray, reach: int, forest: Forest) -> None:
    """Links within a small set: labels of the adjacency spread to the least, so only a star of each set is kept."""
    near = np.bitwise_count(points[own][:, None] ^ points[own][None, :]) <= reach
    if near.sum() == len(own):
        return
    label = np.arange(len(own))
    while True:
        least = np.where(near, label[None, :], len(own)).min(1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    for i in np.flatnonzero(label != np.arange(len(own))):
        forest.join(int(own[i]), int(own[label[i]]))


def _tiled_links(points: np.ndarray, own: np.ndarray, reach: int, forest: Forest) -> None:
    """Links within a set that no vantage point splits, by tiles."""
    for i in range(0, len(own), LEAF):
        for j in range(i, len(own), LEAF):
            _leaf_links(points, np.unique(np.concatenate([own[i : i + LEAF], own[j : j + LEAF]])), reach, forest)


def shard_forest(points: np.ndarray, reach: int) -> np.ndarray:
    """For distinct points, the position of each one's root among what links within ``reach`` join.

    A vantage-point tree of the shard itself, with the same overlap, down to leaves of ``LEAF``.
    """
    forest = Forest(len(points))
    todo = [(np.arange(len(points)), 0)]
    while todo:
        own, tries = todo.pop()
        if len(own) <= LEAF:
            _leaf_links(points, own, reach, forest)
            continue
        vantage, radius = split(points[own], 7919 * (tries + 1) + len(own))
        distance = np.bitwise_count(points[own] ^ vantage).astype(int)
        inside, outside = own[distance <= radius + reach], own[distance > radius]
        if len(inside) > 0.9 * len(own):
            if tries >= 4:
                _tiled_links(points, own, reach, forest)
            else:
                todo.append((own, tries + 1))
            continue
        todo += [(inside, 0), (outside, 0)]
    return np.array([forest.root(i) for i in range(len(points))], int)


def hamming_components(points: DataFrame, reach: int) -> DataFrame:
    """Components of distinct longs ``fp`` that differ in at most ``reach`` bits: ``fp, root``, those with links alone.

    The tree is fitted on at most ``TREE_SAMPLE`` fingerprints, those that hash least, and is
    broadcast; every fingerprint is routed by it, to each leaf whose boundary is within reach. A
    leaf is one task's shard, and gives each fingerprint's least partner found, not all pairs.
    """
    n = points.count()
    sample = [r.fp for r in points.orderBy(F.xxhash64(F.lit(5), "fp")).limit(TREE_SAMPLE).collect()]
    depth = max(0, int(np.ceil(np.log2(max(1, n) / SHARD))))
    tree = points.sparkSession.sparkContext.broadcast(VantageTree(np.array(sample, np.int64).view(np.uint64), depth, reach))

    def route(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            rows, leaves = tree.value.route(fp.view(np.uint64))
            yield batch_of(("fp", "leaf"), (pa.int64(), pa.int64()), (pa.array(fp[rows]), pa.array(leaves.astype(np.int64))))

    def link(table):
        fp = np.unique(table["fp"].to_numpy())
        root = shard_forest(fp.view(np.uint64), reach)
        linked = root != np.arange(len(fp))
        return pa.table({"a": fp[linked], "b": fp[root[linked]]})

    routed = points.select("fp").mapInArrow(route, "fp long, leaf long")
    edges = routed.groupBy("leaf").applyInArrow(link, "a long, b long")
    return connected_components(edges).select(F.col("node").alias("fp"), "root")


def simhash_groups(docs: DataFrame, shingle: int = 3, reach: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents whose fingerprints chain by links of at most ``reach`` differing bits.

    Copies share a fingerprint, so groups of them are one node of the search, summed before any
    shuffle. Returns ``id_col, fp, component_id``, one row for each row of ``docs``: the least id
    reachable, itself included. A null or empty text has fingerprint 0, a node like any other; a
    null id is never the least unless a group has no other; ids may repeat; an empty table gives no
    rows; other columns are not read.
    """
    rows = durable(fingerprints(docs, shingle, seed, id_col, text_col))
    classes = durable(rows.groupBy("fp").agg(F.min(id_col).alias("least")))
    components = durable(hamming_components(classes.select("fp"), reach))
    named = classes.join(components, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = named.join(least, "root").select("fp", "component_id")
    return rows.join(of_class, "fp").select(id_col, "fp", "component_id")


def _mix(h: np.ndarray, view: int) -> np.ndarray:
    """Another order of the same hashes for each view."""
    with np.errstate(over="ignore"):
        x = (h ^ np.uint64(0x9E3779B97F4A7C15 * (view + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)


def shingle_hashes(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """Distinct hashes of a text's word shingles, sorted; those of the whole text if it is shorter."""
    words = text.lower().split()
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(g, seed) for g in grams), np.uint64, len(grams)))


def views_of(h: np.ndarray, views: int, sample: int) -> list[int]:
    """SimHashes, as signed longs, of the ``sample`` shingles that come first in each view's order."""
    out = []
    for v in range(views):
        order = _mix(h, v)
        first = h if len(h) <= sample else h[np.argpartition(order, sample)[:sample]]
        ones = np.unpackbits(np.ascontiguousarray(_mix(first, v)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0)
        out.append(int(np.packbits(2 * ones > len(first), bitorder="little").view(np.int64)[0]))
    return out


def joined_across(x: list[np.ndarray], of_x: np.ndarray, y: list[np.ndarray], of_y: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of the components ``of_x`` and ``of_y`` that sets of at least ``similarity`` join, a forest of them, from all pairs of sets."""
    sizes_x, sizes_y = np.array([len(h) for h in x]), np.array([len(h) for h in y])
    flat, row = np.concatenate(y), np.repeat(np.arange(len(y)), sizes_y)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    common = np.zeros((len(x), len(y)), np.int64)
    for i, h in enumerate(x):
        low, high = np.searchsorted(flat, h, "left"), np.searchsorted(flat, h, "right")
        n = high - low
        ends = np.cumsum(n)
        for start in range(0, int(ends[-1]) if len(ends) else 0, COUNTED_AT_ONCE):
            at = np.arange(start, min(start + COUNTED_AT_ONCE, int(ends[-1])))
            k = np.searchsorted(ends, at, "right")
            common[i] += np.bincount(row[low[k] + at - (ends[k] - n[k])], minlength=len(y))
    alike = (common >= similarity * (sizes_x[:, None] + sizes_y[None, :] - common)) & (of_x[:, None] != of_y[None, :])
    names = np.unique(np.concatenate([of_x, of_y]))
    forest, found = Forest(len(names)), []
    for i, j in zip(*np.nonzero(alike), strict=True):
        a, b = int(np.searchsorted(names, of_x[i])), int(np.searchsorted(names, of_y[j]))
        if forest.root(a) != forest.root(b):
            forest.join(a, b)
            found.append((int(of_x[i]), int(of_y[j])))
    return found


def links_across(member: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links ``a, b`` between components of which a bucket has sets that are alike: all pairs of two components are compared.

    ``member``: ``root, cls, component``, the buckets; ``sets``: ``cls, s``. Buckets of one component
    are settled. In others, each set that is not of the bucket's largest component meets all sets of
    other components, in blocks by hash and by a class of size, as sets that are alike have sizes in
    one class or in neighbouring ones. A task holds two blocks.
    """
    width = max(-math.log(similarity) * (1 + 1e-9), 1e-9)
    parts = member.groupBy("root", "component").agg(F.count("*").alias("n"))
    open_ = parts.groupBy("root").agg(F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("top")).where("parts > 1")
    open_ = open_.select("root", F.col("top.component").alias("largest"))
    rows = member.join(open_, "root").join(sets, "cls")
    rows = rows.select("root", "cls", "component", "s", (F.col("component") == F.col("largest")).alias("top"), F.floor(F.log(F.size("s")) / width).alias("level"))
    rows = written(rows, "open")
    blocks = rows.groupBy("root", "top", "level").agg(F.ceil(F.count("*") / BLOCK_SETS).alias("blocks"))
    named = rows.join(blocks, ["root", "top", "level"]).select("root", "cls", "component", "s", "top", "level", F.pmod(F.xxhash64("cls"), "blocks").alias("block"))
    each = blocks.select("root", "top", "level", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    x, y = each.where("not top").alias("x"), each.alias("y")
    once = "y.top or x.level < y.level or (x.level = y.level and x.block <= y.block)"
    met = x.join(y, "root").where(F.abs(F.col("x.level") - F.col("y.level")) <= 1).where(once)
    key = [F.col(f"{t}.{c}").alias(f"{t}_{c}") for t in "xy" for c in ("top", "level", "block")]
    met = written(met.select("root", *key), "met")
    keys = met.columns

    def side(t: str) -> DataFrame:
        of = [F.col(c).alias(f"{t}_{c}") for c in ("top", "level", "block")]
        return met.join(named.select("root", *of, "component", "s"), ["root", *(f"{t}_{c}" for c in ("top", "level", "block"))]).select(*keys, F.lit(t).alias("side"), "component", "s")

    def compare(table):
        found = {}
        for t in "xy":
            own = table.filter(pa.array([v == t for v in table["side"].to_pylist()]))
            found[t] = [v.values.to_numpy() for v in own["s"]], own["component"].to_numpy()
        links = joined_across(*found["x"], *found["y"], similarity) if found["x"][0] and found["y"][0] else []
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return side("x").union(side("y")).groupBy(*keys).applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, views: int = 8, sample: int = 3, reach: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents whose sets of word shingles chain by Jaccard similarities of at least ``similarity``.

    A SimHash of all shingles of two texts that are 0.8 alike differs in about 10 of 64 bits, where a
    vantage-point tree prunes nothing. So each view takes the SimHash of the few shingles that a hash
    order puts first: two texts share these, and the fingerprint, with probability similarity to the
    power of ``sample``, and all views miss with under 0.4 per cent at 0.8. The fingerprints of all
    views go through the tree as in ``simhash_groups``; each member of a view's group is compared,
    by exact sets, with one member that the view's order picks. Verified links chain, and most groups
    are one component then. In the others, all pairs of sets of two components are compared, in blocks
    (``links_across``), so that no link between members of a group is missed.

    Returns ``id_col, text_hash, component_id, kept``, one row for each row of ``docs``: the hash of
    its text, the least id of its group, and whether it is the group's first row, the one of the least
    id and then of the least text hash. Texts of the same words, but for case, are one class; so are
    all without words, null ones too. A null id is never the least unless a group has no other; a
    repeated id with other texts is several texts; rows alike in id and text are kept or not together;
    an empty table gives no rows; other columns are not read.
    """
    require(docs, id=id_col, text=text_col)
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))

    def sketch(batches):
        for batch in batches:
            cls, found = [], []
            for t in as_bytes(batch.column(1)):
                cls.append(np.uint64(xxhash.xxh64_intdigest(b" ".join(t.lower().split()), 7)))
                found.append(views_of(shingle_hashes(t, shingle), views, sample))
            types = (batch.column(0).type, pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield batch_of(("id", "text_hash", "cls", "views"), types, (batch.column(0), batch.column(2), pa.array(np.array(cls, np.uint64).view(np.int64)), found))

    rows = written(own.mapInArrow(sketch, f"id {kind}, text_hash long, cls long, views array<long>"), "views")
    # a class is known by a row: one of the least id, and of these by its text, as ids may repeat or be null
    first = F.min(F.struct(F.col("id").isNull().alias("without"), "id", "text_hash"))
    classes = rows.groupBy("cls").agg(first.alias("first"), F.first("views").alias("views"))
    classes = written(classes, "classes")
    seen = classes.select("cls", F.posexplode("views").alias("view", "fp"))
    linked = durable(hamming_components(seen.select("fp").distinct(), reach))
    member = seen.join(linked, "fp", "left").select("cls", "view", F.coalesce("root", "fp").alias("root"))
    head = member.groupBy("root").agg(F.min(F.struct(F.xxhash64("cls", "view"), "cls")).alias("head"), F.count("*").alias("n")).where("n > 1").select("root", F.col("head.cls").alias("head"))
    pairs = written(member.join(head, "root").where("cls <> head").select("cls", "head").distinct(), "pairs")
    wanted = pairs.select("cls").union(pairs.select("head")).distinct().join(classes.select("cls", "first"), "cls")
    wanted = wanted.select("cls", F.col("first.id").alias("of_id"), F.col("first.text_hash").alias("of_text"))
    texts = own.join(wanted, (F.col("text_hash") == F.col("of_text")) & F.col("id").eqNullSafe(F.col("of_id"))).select("cls", "text")

    def sets(batches):
        for batch in batches:
            found = [shingle_hashes(t, shingle).view(np.int64) for t in as_bytes(batch.column(1))]
            yield batch_of(("cls", "s"), (pa.int64(), pa.list_(pa.int64())), (batch.column(0), found))

    kept = written(texts.mapInArrow(sets, "cls long, s array<long>").dropDuplicates(["cls"]), "sets")
    both = pairs.join(kept, "cls").withColumnRenamed("s", "x").join(kept.select(F.col("cls").alias("head"), F.col("s").alias("y")), "head")
    common = F.size(F.array_intersect("x", "y"))
    edges = both.where(common >= similarity * (F.size("x") + F.size("y") - common)).select(F.col("cls").alias("a"), F.col("head").alias("b"))
    joined = durable(connected_components(edges)).select(F.col("node").alias("cls"), F.col("root").alias("component"))
    grouped = written(member.select("cls", "root").distinct().join(kept.select("cls"), "cls").join(joined, "cls", "left").select("root", "cls", F.coalesce("component", "cls").alias("component")), "grouped")
    across = durable(connected_components(links_across(grouped, kept, similarity))).select(F.col("node").alias("component"), "root")
    components = grouped.select("cls", "component").distinct().join(across, "component", "left").select("cls", F.coalesce("root", "component").alias("root"))
    named = classes.select("cls", "first").join(components, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    of_class = named.join(least, "root").select("cls", "least")
    stays = F.col("id").eqNullSafe(F.col("least.id")) & (F.col("text_hash") == F.col("least.text_hash"))
    return rows.join(of_class, "cls").select(F.col("id").alias(id_col), "text_hash", F.col("least.id").alias("component_id"), stays.alias("kept"))
