"""Reshaping, comparison and completion of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def compare(a: DataFrame, b: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """One row on two tables that should agree: keys in all, in one alone, and the greatest difference."""
    j = a.alias("a").join(b.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    return j.agg(F.count("*").alias("n"), F.count_if(F.col(f"a.{key}").isNull()).alias("only_right"), F.count_if(F.col(f"b.{key}").isNull()).alias("only_left"), F.max(F.abs(F.col(x) - F.col(y))).alias("max_abs_diff"))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; a minimum of structs, so rows are cut in each task before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min(F.struct(*order, *[c for c in rest if c not in order]))
    return df.groupBy(*keys).agg(first.alias("__f")).select(*keys, *[F.col(f"__f.{c}").alias(c) for c in rest])


def reindex(df: DataFrame, domain: DataFrame, keys: list[str], fill: dict) -> DataFrame:
    """A row for every member of the domain; missing values filled."""
    return domain.join(df, keys, "left").na.fill(fill)


def third_cuts(df: DataFrame, value: str) -> DataFrame:
    """The values whose cumulative shares lie nearest to one and two thirds; the lesser of two as near."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    running = Window.orderBy(value)
    share = F.sum("n").over(running) / F.sum("n").over(Window.partitionBy())
    c = counts.withColumn("share", share)
    near = lambda p: F.min_by(value, F.struct(F.abs(F.col("share") - p), F.col(value)))
    return c.agg(near(1 / 3).alias("low"), near(2 / 3).alias("high"))


def coverage(df: DataFrame, key: str, n: str, share: float) -> DataFrame:
    """How many of the largest it takes to hold a share of the total."""
    w = Window.orderBy(F.desc(n), key)
    total = df.agg(F.sum(n).alias("t"))
    r = df.select(F.row_number().over(w).alias("pos"), F.sum(n).over(w).alias("cum")).crossJoin(F.broadcast(total))
    return r.where(F.col("cum") >= F.col("t") * share).agg(F.min("pos").alias("needed"))
