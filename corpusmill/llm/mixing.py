"""Mixing of sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import SPACE_WORDS, durable, require, small

#: Documents that one task rounds together, and residuals that one task of the tree combines.
GROUP_DOCS, TREE_FAN = 8192, 512


def pivotal(probability: np.ndarray, size: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Round probabilities to 0 or 1 but for one at most, keeping the sum of probability times size.

    The open row meets the next fractional one: mass goes from either to the other, with odds that
    keep both expectations, until one of the two is integral; the other stays open.
    """
    p = probability.astype(float).tolist()
    w = size.astype(float).tolist()
    draw = random.random(len(p)).tolist()
    held = -1
    for i in range(len(p)):
        if w[i] <= 0 or p[i] <= 0 or p[i] >= 1:
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        up = min((1 - p[a]) * w[a], p[b] * w[b])  # mass that can go from b to a
        down = min(p[a] * w[a], (1 - p[b]) * w[b])
        if draw[i] * (up + down) < down:
            moved, full, empty = up, (1 - p[a]) * w[a] <= p[b] * w[b], True
        else:
            moved, full, empty = -down, False, p[a] * w[a] <= (1 - p[b]) * w[b]
        pa_, pb_ = p[a] + moved / w[a], p[b] - moved / w[b]
        if moved > 0:
            pa_, pb_ = (1.0, pb_) if full else (pa_, 0.0)
        else:
            pa_, pb_ = (0.0, pb_) if empty else (pa_, 1.0)
        p[a], p[b] = min(1.0, max(0.0, pa_)), min(1.0, max(0.0, pb_))
        if 0 < p[a] < 1:
            held = a
        elif 0 < p[b] < 1:
            held = b
        else:
            held = -1
    return np.asarray(p)


def source_targets(sizes: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources from ``source, source_size``: ``share`` of all sizes by weight, none above ``most`` times its own size.

    Weights repeat over the sources in code-point order, null last. What a source cannot take is
    shared again by weight among the others until none is above. Each round is one aggregate over
    the sources; the driver holds two numbers. Returns ``rank, source, source_size, target``.
    """
    ordered = durable(sizes.select("source", "source_size").orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    held = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a number a partition
    before, offsets = 0, []
    for r in held:
        offsets += [F.lit(r.part), F.lit(before)]
        before += r.n
    offset = F.element_at(F.create_map(*offsets), part) if offsets else F.lit(0)
    ranked = ordered.select((offset + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias("rank"), "source", "source_size")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = durable(ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most))
    total = share * float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        over = F.col("cap") < F.lit(level) * F.col("weight")
        n, fixed, rest = ranked.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if n == capped or rest == 0:
            break
        level, capped = max(level, (total - fixed) / rest), n
    target = F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    return ranked.select("rank", "source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 29, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Choose how many words of each document a mix of the sources takes.

    A source's documents are each taken ``target / source_size`` times: the whole part as copies,
    the rest as a probability. Probabilities are rounded in groups of about ``GROUP_DOCS`` documents
    of a source (a large source has many), keeping the words expected; one document a group may
    stay open, and a tree of further groups rounds those, until one a source is left. Of that one
    the mix takes as many words of one more copy as its probability says. So each source's words
    differ from its target by less than one word. Draws are seeded by group and rows sorted within,
    so a second run agrees.

    Returns ``id_col, size, source_size, target, taken``, one row for each row of ``docs``. A null
    text has no words; a null source is a source; an empty table gives no rows; ids may be null or
    repeat; other columns are not read.
    """
    require(docs, id=id_col, text=text_col, source=source_col)
    kind = dict(docs.dtypes)[id_col]
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(SPACE_WORDS)), F.lit(0)).cast("long")
    sized = durable(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h")))
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, share, most)
    counts = sized.groupBy("source").agg(F.count("*").alias("n"))
    facts = durable(targets.alias("t").join(counts.alias("c"), F.expr("t.source <=> c.source")).select("t.*", "n"))
    # a source's facts are one row: while they are few they are broadcast, so that no task gets a whole source
    rows = sized.alias("s").join(small(facts).alias("f"), F.expr("s.source <=> f.source")).select(
        "id", "h", "size", "rank", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("ratio"), F.ceil(F.col("n") / GROUP_DOCS).alias("groups")
    )
    rows = rows.withColumn("copies", F.floor("ratio")).withColumn("p", F.col("ratio") - F.floor("ratio")).withColumn("grp", F.pmod("h", "groups"))

    def deal(key, table):
        # a row's own random number decides the order; ties are alike in all that matters
        order = np.lexsort((table["size"].to_numpy(), table["h"].to_numpy()))
        table = table.take(pa.array(order))
        random = np.random.default_rng([seed, key[0].as_py(), key[1].as_py()])
        p = pivotal(table["p"].to_numpy(), table["size"].to_numpy(), random)
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))

    names = ["id", "h", "size", "rank", "source_size", "target", "copies", "p", "grp"]
    schema = f"id {kind}, h long, size long, rank long, source_size long, target double, copies long, p double, grp long"
    dealt = durable(rows.select(*names).groupBy("rank", "grp").applyInArrow(deal, schema))
    is_open = (F.col("p") > 0) & (F.col("p") < 1) & (F.col("size") > 0)
    level = dealt.where(is_open).select("rank", "grp", "size", "p", F.col("grp").alias("node"))
    level_schema = "rank long, grp long, size long, p double, node long"
    settled = []

    def combine(key, table):
        table = table.take(pa.array(np.argsort(table["grp"].to_numpy(), kind="stable")))
        random = np.random.default_rng([seed + 1, key[0].as_py(), key[1].as_py()])
        p = pivotal(table["p"].to_numpy(), table["size"].to_numpy(), random)
        return table.set_column(3, "p", pa.array(p, pa.float64()))

    most_groups = facts.agg(F.max("groups" if "groups" in facts.columns else F.ceil(F.col("n") / GROUP_DOCS))).first()[0] or 1
    while most_groups > 1:
        level = durable(level.withColumn("node", F.floor(F.col("node") / TREE_FAN)).groupBy("rank", "node").applyInArrow(combine, level_schema))
        settled.append(level.where("p = 0 or p = 1").select("rank", "grp", "p"))
        level = level.where("p > 0 and p < 1")
        most_groups = -(-most_groups // TREE_FAN)
    left = level.select("rank", "grp", "p")
    for x in settled:
        left = left.union(x)
    final = dealt.where(is_open).drop("p").join(left, ["rank", "grp"])
    done = dealt.where(~is_open).select(*names).unionByName(final.select(*names))
    taken = F.col("size") * F.col("copies") + F.round(F.col("size") * F.col("p")).cast("long")
    return done.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"))
