"""Sampling, filtering, cleaning and verification of document collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions import text as T


def accept_by_hash(docs: DataFrame, key: str, seed: str, threshold: int, buckets: int = 10_000) -> DataFrame:
    """Rows whose key's hash falls under the threshold."""
    return docs.where(T.hash_bucket(F.col(key), seed, buckets) < threshold)


def token_budget(docs: DataFrame, group: str, order: list[Column], tokens: str, target: int, over: float = 1.05) -> DataFrame:
    """Rows until a group's running sum has reached the target and its excess; the row that crosses stays."""
    before = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return docs.withColumn("tokens_before", F.coalesce(F.sum(tokens).over(before), F.lit(0))).where(F.col("tokens_before") < int(target * over))


def hash_sample(docs: DataFrame, group: list[str], key: str, seed: str, n: int) -> DataFrame:
    """``n`` rows of each group, in the order of a seeded hash."""
    w = Window.partitionBy(*group).orderBy(T.hash_order(F.col(key), seed), F.col(key))
    return docs.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= n)


def proportional_sample(docs: DataFrame, stratum: str, key: str, seed: str, n: int) -> DataFrame:
    """About ``n`` rows in all, each stratum by its share, at least one; rounded half up."""
    sizes = docs.groupBy(stratum).agg(F.count("*").alias("size"))
    total = docs.agg(F.count("*").alias("total"))
    quota = sizes.crossJoin(F.broadcast(total)).select(stratum, F.greatest(F.floor(F.lit(n) * F.col("size") / F.col("total") + 0.5), F.lit(1)).alias("quota"))
    w = Window.partitionBy(stratum).orderBy(T.hash_order(F.col(key), seed), F.col(key))
    return docs.withColumn("pick", F.row_number().over(w)).join(quota, stratum).where("pick <= quota")


def hash_split(docs: DataFrame, stratum: str, key: str, seed: str, share: float = 0.7) -> DataFrame:
    """dev and test in the given share within each stratum."""
    w = Window.partitionBy(stratum)
    pick = F.row_number().over(w.orderBy(T.hash_order(F.col(key), seed), F.col(key)))
    return docs.withColumn("split", F.when(pick <= F.floor(F.count("*").over(w) * share + 0.5), "dev").otherwise("test"))


def balanced_draws(docs: DataFrame, level: str, key: str, draws: int) -> DataFrame:
    """``draws`` samples with as many rows of each level as the smallest level has."""
    sizes = docs.groupBy(level).agg(F.count("*").alias("n"))
    least = sizes.agg(F.min("n").alias("least"))
    many = docs.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    w = Window.partitionBy(level, "draw").orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col("draw").cast("string"))), F.col(key))
    return many.withColumn("pick", F.row_number().over(w)).crossJoin(F.broadcast(least)).where("pick <= least").drop("least", "pick")


def shards_by_tokens(docs: DataFrame, order: list[Column], tokens: str, budget: int) -> DataFrame:
    """Shard number: a shard ends with the row by which it has the budget's multiple."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return docs.withColumn("shard", F.floor(F.coalesce(F.sum(tokens).over(before), F.lit(0)) / budget))


def verify_by_source(docs: DataFrame, source: str, tokens: str, target: int, least: int) -> DataFrame:
    """Per source: documents, tokens, deviation from the target, mean, median, floor-index percentiles, short documents, and whether within 5 per cent.

    Documents are counted by source and number of tokens first, in each task too, so that what is put
    in order are distinct numbers and not the documents of a source.
    """
    sizes = docs.groupBy(source, tokens).agg(F.count("*").alias("n"))
    running = Window.partitionBy(source).orderBy(tokens)
    of = Window.partitionBy(source)
    placed = sizes.withColumns({"upto": F.sum("n").over(running), "all": F.sum("n").over(of)})
    # the value at a place from 0 is the least one whose running count exceeds the place
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col(tokens)))
    share = lambda p: at(F.floor(F.col("all") * p))
    n, total = F.sum("n"), F.sum(F.col(tokens) * F.col("n"))
    middle = (at(F.floor((F.col("all") - 1) / 2)) + at(F.floor(F.col("all") / 2))) / 2.0
    return placed.groupBy(source).agg(
        n.alias("docs"), total.alias("tokens"), F.round(total * 100.0 / target, 6).alias("pct_of_target"), F.round(total / n, 6).alias("mean_tokens"), middle.alias("median_tokens"),
        share(0.05).alias("p5"), share(0.95).alias("p95"), F.sum(F.when(F.col(tokens) < least, F.col("n")).otherwise(0)).alias("short_docs"), (F.abs(total - target) <= target * 0.05).alias("within_5pct"),
    )


def corpus_checks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row: placeholders left, empty texts, repeated ids."""
    marked = F.lit(False)
    for marker in T.PII_REPLACEMENTS:
        marked = marked | F.contains(F.col(text), F.lit(marker))
    return docs.agg(F.count("*").alias("total_docs"), F.count_if(marked).alias("pii_remaining"), F.count_if(F.coalesce(F.trim(F.col(text)), F.lit("")) == "").alias("empty_docs"), (F.count("*") - F.countDistinct(key)).alias("duplicate_ids"))


def null_audit(df: DataFrame) -> DataFrame:
    """Per column: nulls and their percentage."""
    counts = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = counts.unpivot(["__n"], df.columns, "column", "nulls")
    return long.select("column", "nulls", F.round(F.coalesce(F.try_divide(100.0 * F.col("nulls"), F.col("__n")), F.lit(0.0)), 6).alias("pct"))


def not_done(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs whose keys have no result yet."""
    return jobs.join(done.select(*keys).distinct(), keys, "left_anti")


def upsert(table: DataFrame, entry: DataFrame, keys: list[str]) -> DataFrame:
    """The table with rows of the entry's keys replaced."""
    return table.join(entry.select(*keys).distinct(), keys, "left_anti").unionByName(entry, allowMissingColumns=True)
