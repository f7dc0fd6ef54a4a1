"""Statistics: correlations, effect sizes, fronts, adjustments, and summaries of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pearson(x: str, y: str) -> Column:
    """Null where either does not vary, which ``corr`` would make an error."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def average_rank(x: str, *group: str) -> Column:
    """Rank from 1 with ties at their mean."""
    w = Window.partitionBy(*group)
    return F.rank().over(w.orderBy(x)) + (F.count("*").over(Window.partitionBy(*group, x)) - 1) / 2.0


def spearman(df: DataFrame, x: str, y: str, *group: str) -> DataFrame:
    """``group..., n, rho`` over rows with both."""
    ranked = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*group, average_rank(x, *group).alias("rx"), average_rank(y, *group).alias("ry"))
    return ranked.groupBy(*group).agg(F.count("*").alias("n"), pearson("rx", "ry").alias("rho"))


def size_weighted(df: DataFrame, value: str, n: str, *group: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*group).agg(F.try_divide(F.sum(F.col(value) * F.col(n)), F.sum(n)).alias(value))


def partial_r(xy: Column, xz: Column, yz: Column) -> Column:
    """Correlation of x and y with z held, from the three pairwise ones."""
    return F.try_divide(xy - xz * yz, F.sqrt((1 - xz * xz) * (1 - yz * yz)))


def weighted_d(df: DataFrame, value: str, stratum: str, group: str) -> DataFrame:
    """Cohen's d of each group against the rest of its stratum, weighted by the group's size; strata with fewer than two on a side are left out.

    The rest's moments are the stratum's less the group's, so the pairs are one aggregate.
    """
    x = F.col(value)
    cells = df.where(x.isNotNull()).groupBy(stratum, group).agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    w = Window.partitionBy(stratum)
    cells = cells.withColumns({f"{c}2": F.sum(c).over(w) - F.col(c) for c in ("n", "s", "q")}).where("n >= 2 and n2 >= 2")
    ss = lambda n, s, q: F.col(q) - F.col(s) * F.col(s) / F.col(n)
    pooled = F.sqrt((ss("n", "s", "q") + ss("n2", "s2", "q2")) / (F.col("n") + F.col("n2") - 2))
    d = F.try_divide(F.col("s") / F.col("n") - F.col("s2") / F.col("n2"), pooled)
    return cells.select(group, "n", d.alias("d")).where("d is not null").groupBy(group).agg(F.try_divide(F.sum(F.col("d") * F.col("n")), F.sum("n")).alias("d"))


def fairness(ds: DataFrame, group: str, by: list[str], flag: float = 0.10) -> DataFrame:
    """Greatest absolute d, the group that has it (the least name of several), and how many reach the flag."""
    a = F.abs("d")
    return ds.groupBy(*by).agg(F.max(a).alias("max_d"), F.min_by(group, F.struct(-a, F.col(group))).alias("worst"), F.count_if(a >= flag).alias("flagged"))


def pareto_front(points: DataFrame, key: str, high: str, low: str, *group: str, blocks: int = 256) -> DataFrame:
    """Points, within their group, that no other equals or beats on both with one strictly better; points without both values are left out, equal points stay or go together.

    A point is on the front if it has the least ``low`` of its ``high`` and less than all that are higher. Blocks of ``high`` split by quantiles
    carry the least ``low`` of the blocks above, so that no window holds more than the distinct values of a block, and any number of points works.
    """
    points = points.where(F.col(high).isNotNull() & F.col(low).isNotNull())
    edges = points.agg(F.percentile_approx(high, [k / blocks for k in range(1, blocks)], 10_000)).first()[0] or []
    above = F.size(F.filter(F.array(*[F.lit(float(e)) for e in sorted(set(edges))]), lambda e: e > F.col("__high"))) if edges else F.lit(0)
    group_of = [F.struct(*map(F.col, group)).alias("__group")] if group else [F.lit(0).alias("__group")]
    best = points.groupBy(*group_of, F.col(high).alias("__high")).agg(F.min(low).alias("__low"))
    best = best.withColumn("__block", above)
    first = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    least = best.groupBy("__group", "__block").agg(F.min("__low").alias("__least"))
    least = least.select("__group", "__block", F.min("__least").over(first("__group").orderBy("__block")).alias("__before"))
    inside = best.withColumn("__inside", F.min("__low").over(first("__group", "__block").orderBy(F.desc("__high"))))
    front = inside.join(least, ["__group", "__block"]).where("coalesce(__low < least(__before, __inside), true)").select("__group", "__high", "__low")
    mine = points.select(*group_of, F.struct("*").alias("__row"))
    on = [mine["__group"] == front["__group"], mine[f"__row.{high}"] == front["__high"], mine[f"__row.{low}"] == front["__low"]]
    return mine.join(front, on, "left_semi").select("__row.*")


def contrasts(df: DataFrame, target: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """``first, second, n, difference, low, high, excludes_0`` of the absolute correlations with the target of two columns at a time.

    Rows without all three values are left out of a pair; all pairs are one aggregate, and a pair without a correlation has nulls.
    """
    def of(a: str, b: str) -> Column:
        whole = F.col(target).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()
        t, x, y = (F.when(whole, F.col(c).cast("double")) for c in (target, a, b))
        r = lambda u, v: F.try_divide(F.covar_pop(u, v), F.stddev_pop(u) * F.stddev_pop(v))
        return F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.count_if(whole).alias("n"), r(t, x).alias("x"), r(t, y).alias("y"), r(x, y).alias("xy"))

    c = df.agg(F.array(*[of(a, b) for a, b in pairs]).alias("c")).select(F.inline("c"))
    low, high = zou_interval(F.abs("x"), F.abs("y"), F.col("xy") * F.signum("x") * F.signum("y"), F.col("n"))
    c = c.select("first", "second", "n", (F.abs("x") - F.abs("y")).alias("difference"), low.alias("low"), high.alias("high"))
    return c.withColumn("excludes_0", (F.col("low") > 0) | (F.col("high") < 0))


def confound_bound(df: DataFrame, value: str, stratum: str, group: str) -> DataFrame:
    """``group, d_plain, d_within, kept``: d of each group against all others, the same within strata, and the share of it that strata leave."""
    plain = weighted_d(df.withColumn("__all", F.lit(1)), value, "__all", group).withColumnRenamed("d", "d_plain")
    within = weighted_d(df, value, stratum, group).withColumnRenamed("d", "d_within")
    return plain.join(within, group, "left").withColumn("kept", F.try_divide("d_within", "d_plain"))


def ranks(value: str, ties: list[str], *group: str) -> dict[str, Column]:
    """Places from 1: ties at their mean, ties in the order given, from the greatest, and the share of rows at or below; nulls come first."""
    w = Window.partitionBy(*group)
    return {
        "average": average_rank(value, *group), "first": F.row_number().over(w.orderBy(value, *ties)), "from_top": F.rank().over(w.orderBy(F.desc_nulls_last(value))),
        "share": F.cume_dist().over(w.orderBy(value)),
    }


def residualize(df: DataFrame, value: str, factor: str) -> DataFrame:
    """Value less its factor's mean, as ``residual``."""
    return df.withColumn("residual", F.col(value) - F.avg(value).over(Window.partitionBy(factor)))


def factor_r2(df: DataFrame, values: list[str], factor: str) -> DataFrame:
    """Share of each variable's variance between the factor's groups; two aggregates, no window over all rows."""
    long = df.select(factor, *values).unpivot([factor], values, "variable", "x").where("x is not null")
    cells = long.groupBy("variable", factor).agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    total = cells.groupBy("variable").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"))
    parts = cells.join(F.broadcast(total), "variable").groupBy("variable").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), F.lit(2))).alias("b"), F.sum(F.col("n") * F.col("v")).alias("w"))
    return parts.select("variable", F.try_divide(F.col("b"), F.col("b") + F.col("w")).alias("r2"))


def bh_adjust(df: DataFrame, p: str, *group: str) -> DataFrame:
    """Benjamini-Hochberg, as ``bh``."""
    w = Window.partitionBy(*group)
    ranked = df.withColumn("__r", F.row_number().over(w.orderBy(p))).withColumn("__n", F.count("*").over(w))
    down = w.orderBy(F.col("__r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("bh", F.least(F.lit(1.0), F.min(F.col(p) * F.col("__n") / F.col("__r")).over(down))).drop("__r", "__n")


def holm_adjust(df: DataFrame, p: str, *group: str) -> DataFrame:
    """Holm, as ``holm``."""
    w = Window.partitionBy(*group)
    ranked = df.withColumn("__r", F.row_number().over(w.orderBy(p))).withColumn("__n", F.count("*").over(w))
    up = w.orderBy("__r").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("holm", F.least(F.lit(1.0), F.max((F.col("__n") - F.col("__r") + 1) * F.col(p)).over(up))).drop("__r", "__n")


def fisher_interval(r: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    half = z / F.sqrt(n - 3)
    return F.tanh(F.atanh(r) - half), F.tanh(F.atanh(r) + half)


def zou_interval(r1: Column, r2: Column, r12: Column, n: Column) -> tuple[Column, Column]:
    """Confidence limits of r1 - r2 for two correlations that share a variable (Zou, 2007)."""
    l1, u1 = fisher_interval(r1, n)
    l2, u2 = fisher_interval(r2, n)
    c = ((r12 - 0.5 * r1 * r2) * (1 - r1 * r1 - r2 * r2 - r12 * r12) + F.pow(r12, F.lit(3))) / ((1 - r1 * r1) * (1 - r2 * r2))
    low = r1 - r2 - F.sqrt(F.greatest(F.lit(0.0), (r1 - l1) ** 2 + (u2 - r2) ** 2 - 2 * c * (r1 - l1) * (u2 - r2)))
    high = r1 - r2 + F.sqrt(F.greatest(F.lit(0.0), (u1 - r1) ** 2 + (r2 - l2) ** 2 - 2 * c * (u1 - r1) * (r2 - l2)))
    return low, high


def crosstab_rates(df: DataFrame, key: str, label: str, values: list[str]) -> DataFrame:
    """Share of each of the given labels among a key's rows, 0 where it has none."""
    counts = df.groupBy(key).agg(F.count("*").alias("__n"), *[F.count_if(F.col(label) == v).alias(v) for v in values])
    return counts.select(key, *[(F.col(v) / F.col("__n")).alias(v) for v in values])


def argmax_rows(df: DataFrame, group: list[str], value: str, *ties: str) -> DataFrame:
    """The row of the greatest value of each group; the first by the tie columns."""
    w = Window.partitionBy(*group).orderBy(F.col(value).desc(), *ties)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def qcut(df: DataFrame, value: str, tie: str, k: int, *group: str) -> DataFrame:
    """Bands of equal size by first-tie rank, from 0: band b while k(rank - 1) < (b + 1)(n - 1)."""
    w = Window.partitionBy(*group)
    out = df.withColumn("__r", F.row_number().over(w.orderBy(value, tie)) - 1).withColumn("__n", F.count("*").over(w) - 1)
    band = F.lit(k - 1)
    for b in range(k - 2, -1, -1):
        band = F.when(k * F.col("__r") < (b + 1) * F.col("__n"), b).otherwise(band)
    return out.withColumn("band", band).drop("__r", "__n")


def cut(value: Column, edges: list[float], labels: list[str]) -> Column:
    """Bands with fixed edges, left ends included; null outside."""
    out = F.when(value < edges[0], F.lit(None))
    for edge, label in zip(edges[1:], labels, strict=True):
        out = out.when(value < edge, label)
    return out


def bootstrap_mean(df: DataFrame, key: str, value: str, group: list[str], draws: int) -> DataFrame:
    """Percentile interval of the mean by draws with weights from a hash (Poisson of mean 1), so that any engine repeats it."""
    u = (F.crc32(F.concat_ws("|", F.col(key).cast("string"), F.col("draw").cast("string"))) % 1_000_000 + 0.5) / 1_000_000
    # cumulative probabilities of a Poisson of mean 1
    weight = F.lit(6)
    for k, p in reversed(list(enumerate((0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)))):
        weight = F.when(u < p, k).otherwise(weight)
    many = df.where(F.col(value).isNotNull()).select(*group, key, value, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn("w", weight)
    means = many.groupBy(*group, "draw").agg(F.try_divide(F.sum(F.col("w") * F.col(value)), F.sum("w")).alias("m"))
    return means.groupBy(*group).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
