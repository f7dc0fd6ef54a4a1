"""Document fingerprints of closed syncmers, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.common import require

#: Units by which matched anchors may lie off their common shift.
DRIFT = 8

#: What stands between words.
SPACE = r"[\\s\\p{Z}\\x{1c}-\\x{1f}\\x{85}]+"

#: A text with fewer characters than this, or more characters to a word, is cut into characters instead of words.
FEW_CHARS, LONG_WORDS = 128, 24

#: Documents to a bucket of neighbours in id order.
BUCKET_DOCS = 2048

#: An anchor and its place in one long: the anchor's bits above, and those of the place.
PLACE_BITS = 24


def _anchors(text: str) -> list[tuple[str, str]]:
    """Steps (column, SQL) from a text to its anchors, each one long of hash and place, least first.

    A k-mer is five words; its inner substrings are the four pairs of neighbouring words. It is a
    closed syncmer if the least hash among them is the first's or the last's, which no word outside
    the five can change. All of them are anchors, at all places, so a shared passage has the same ones
    in texts of any length. A short text, or one of words that have many characters (tables, or scripts
    without spaces), is cut into characters instead of words. A text without a k-mer has its own hash as only anchor.
    """
    top = 63 - PLACE_BITS
    return [
        ("__w0", f"array_remove(split({text}, '{SPACE}'), '')"),
        ("__w", f"if(length({text}) < {FEW_CHARS} or length({text}) > {LONG_WORDS} * size(__w0), split({text}, ''), __w0)"),
        ("__g", "transform(__w, (x, i) -> xxhash64(x, get(__w, i + 1)))"),
        (
            "__s",
            "transform(slice(__g, 1, greatest(size(__g) - 4, 0)), (x, i) -> if(least(x, __g[i + 3]) <= least(__g[i + 1], __g[i + 2]), "
            f"shiftleft(shiftrightunsigned(xxhash64(x, __g[i + 2], __g[i + 3]), {64 - top}), {PLACE_BITS}) + least(i, {(1 << PLACE_BITS) - 1}), null))",
        ),
        ("__d", "sort_array(array_compact(__s))"),
        ("__a", f"if(size(__d) = 0, array(shiftleft(shiftrightunsigned(xxhash64({text}), {64 - top}), {PLACE_BITS})), __d)"),
    ]


def with_anchors(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name``, the anchors of the column ``text``.

    Each step is a column of its own: the optimizer would put an expression where it is read, and
    inside a lambda work it out again for every element; as the input of an explode it is a value.
    """
    kept = df.columns
    for column, sql in _anchors(text):
        df = df.withColumn(column, F.expr(sql))
    return df.select(*kept, F.col("__a").alias(name))


def printed(name: str) -> Column:
    """Fingerprint as text: hexadecimal anchors with their places, least first."""
    return F.expr(f"array_join(transform({name}, a -> hex(a)), ' ')")


def with_likeness(df: DataFrame, x: str, y: str, name: str) -> DataFrame:
    """Add ``name``, the share of the distinct anchors of both that both have at one shift: 1 for equal fingerprints, 0 without a common one.

    An anchor's first place in one text is matched to its first in the other, and gives a shift; the
    most anchors whose shifts lie within ``DRIFT`` words of a common one are the match. Both texts'
    anchors are sorted as one array of longs, in which matched ones are neighbours; the most shifts
    within a width are found by a window over the sorted shifts that never shrinks.
    """
    kept = df.columns
    mask = (1 << PLACE_BITS) - 1
    # the anchor's bits, then a bit for the text, then the first place
    first = "filter({c}, (a, i) -> i = 0 or shiftright(a, {b}) <> shiftright({c}[i - 1], {b}))"
    for side, t in enumerate((x, y)):
        df = df.withColumn(f"__f{side}", F.expr(first.format(c=t, b=PLACE_BITS)))
        df = df.withColumn(f"__m{side}", F.expr(f"transform(__f{side}, a -> shiftleft(shiftright(a, {PLACE_BITS}), {PLACE_BITS}) + {side << (PLACE_BITS - 1)} + least(a & {mask}, {mask >> 1}))"))
    df = df.withColumn("__m", F.expr("sort_array(concat(__m0, __m1))"))
    low = mask >> 1
    df = df.withColumn(
        "__e",
        F.expr(f"sort_array(array_compact(transform(__m, (a, i) -> if(i + 1 < size(__m) and shiftright(a, {PLACE_BITS}) = shiftright(__m[i + 1], {PLACE_BITS}), (__m[i + 1] & {low}) - (a & {low}), null))))"),
    )
    start = f"aggregate(sequence(0, size(__e) - 1), 0, (s, i) -> if(__e[i] - __e[s] > {2 * DRIFT}, s + 1, s))"
    best = f"if(size(__e) = 0, 0, size(__e) - {start})"
    df = df.withColumn(name, F.expr(f"{best} / cast(size(__m) - size(__e) as double)"))
    return df.select(*kept, name)


def _bucket(id_col: str, bounds: list) -> Column:
    """How many of the sorted bounds are at most the id, by a search in two steps; 0 for a null."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.array(*[F.lit(b) for b in bounds[::step]])
    whole = F.array(*[F.lit(b) for b in bounds])
    block = F.size(F.filter(coarse, lambda b: b <= F.col(id_col)))
    start = F.greatest(block - 1, F.lit(0)) * step
    return F.when(F.col(id_col).isNull() | (block == 0), 0).otherwise(start + F.size(F.filter(F.slice(whole, start + 1, F.lit(step)), lambda b: b <= F.col(id_col))))


def with_next(docs: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    """Add ``next``: ``columns`` of the row with the next greater id, and of the first one after the last.

    Ids, of any type that has an order, are cut into buckets by Spark's own range partitioning of the
    ids alone; the first rows of a bucket also go to the one before, and those of the first to the
    last, so a bucket's last row finds its neighbour there. So no task sorts the whole table, and
    buckets stay of one size at any size of the corpus. Null ids come first; rows with one id follow
    by a hash of what they hold.
    """
    n = docs.count()
    buckets = max(1, -(-n // BUCKET_DOCS))
    bounds: list = []
    if buckets > 1:
        ranges = docs.select(id_col).where(F.col(id_col).isNotNull()).repartitionByRange(buckets, id_col)
        found = ranges.groupBy(F.spark_partition_id().alias("p")).agg(F.min(id_col).alias("least")).collect()
        bounds = sorted({r.least for r in found})[1:]
    placed = docs.withColumn("__b", _bucket(id_col, bounds)).withColumn("__guest", F.lit(0))
    first = docs.select(id_col).withColumn("__b", _bucket(id_col, bounds)).groupBy("__b").agg(F.min(id_col).alias("least"), F.max(F.col(id_col).isNull()).alias("without"))
    first = {r["__b"]: (None if r.without else r.least) for r in first.collect()}
    full = sorted(first)
    if not full:
        return placed.withColumn("next", F.struct(*columns)).drop("__b", "__guest")
    # of each bucket: whether a row is of its least id, and the bucket before it; around the end for the first
    before = F.element_at(F.create_map(*[F.lit(x) for b, a in zip(full, [full[-1], *full[:-1]], strict=True) for x in (b, a)]), F.col("__b"))
    kind = docs.schema[id_col].dataType
    least = F.element_at(F.create_map(*[x for b in full for x in (F.lit(b), F.lit(first[b]).cast(kind))]), F.col("__b"))
    wraps = F.when(F.col("__b") == full[0], 2).otherwise(1)
    places = F.array(F.struct(F.col("__b"), F.lit(0).alias("__guest")), F.struct(before.alias("__b"), wraps.alias("__guest")))
    alone = F.array(F.struct(F.col("__b"), F.lit(0).alias("__guest")))
    rows = placed.withColumn("__at", F.explode(F.when(F.col(id_col).eqNullSafe(least), places).otherwise(alone))).drop("__b", "__guest").select("*", "__at.*").drop("__at")
    window = Window.partitionBy("__b").orderBy("__guest", F.col(id_col).asc_nulls_first(), F.xxhash64(*[c for c in columns if c != id_col]))
    return rows.withColumn("next", F.lead(F.struct(*columns)).over(window)).where("__guest = 0").drop("__b", "__guest")


def fingerprint_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every whole text and its edited text, and compare.

    The edited text has the last quarter of the code points replaced by as many first ones of the
    next document. Returns ``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``, one row for each row of ``docs``. A null text is empty; an empty one
    has a fingerprint of its own; the only document's next is itself; an empty table gives no rows;
    other columns are not read; ids may be null, repeat and be of any type that has an order. Texts
    alone cross one shuffle.
    """
    require(docs, id=id_col, text=text_col)
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = with_next(own, ["text"], "id")
    own = own.withColumn("n_chars", F.length("text").cast("long")).withColumn("cut", F.floor(F.col("n_chars") / 4).cast("int")).withColumn("after", F.col("next.text"))
    own = own.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars as int) - cut)"), F.expr("substring(after, 1, cut)"))).drop("next")
    for text, name in (("text", "own"), ("after", "beside"), ("edited", "other")):
        own = with_anchors(own, text, name)
    own = with_likeness(with_likeness(own, "own", "other", "near_edited"), "own", "beside", "near_next")
    return own.select(
        F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), printed("own").alias("fingerprint"), printed("other").alias("edited_fingerprint"),
        "near_edited", "near_next",
    )
