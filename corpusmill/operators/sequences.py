"""Ordered operators on tokens: context, spans, thresholds, layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def left_context(toks: DataFrame, key: str, width: int = 8) -> DataFrame:
    """The last ``width`` tokens up to and with each, as an array."""
    w = Window.partitionBy(key).orderBy("i").rowsBetween(1 - width, 0)
    return toks.withColumn("context", F.collect_list("tok").over(w))


def centred_window(length: Column, centre: Column, size: int) -> tuple[Column, Column]:
    """Start and end of a window about a place, moved inside at the edges; the whole if it is shorter."""
    half = size // 2
    start = F.greatest(F.least(centre - half, length - size), F.lit(0))
    return start, F.least(start + size, length)


def occurrence(toks: DataFrame, key: str) -> DataFrame:
    """Which occurrence of its form in the text each token is, from 1."""
    return toks.withColumn("occurrence", F.row_number().over(Window.partitionBy(key, "tok").orderBy("i")))


def row_ids(df: DataFrame, *order: str) -> DataFrame:
    """Dense row numbers from 0 in a total order, without gathering rows: each range partition adds the sizes of those before.

    Sizes are one number a partition, so the driver's list is bounded by the partitions.
    """
    spark = df.sparkSession
    schema = df.schema.add("row_id", "long")
    ranked = df.orderBy(*order).rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    return spark.createDataFrame(ranked, schema)


def gold_labels(toks: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """ERR_TOK for tokens that an edited span covers in part, ERR_INS for those after a gap with an insertion, POST for the next, else OK.

    ``toks(key, i, start, end, is_space)``, ``spans(key, s, e)``; a span with s = e is an insertion.
    Spaces take part as tokens, but a gap begins at the end of the last token that is none. Spans
    join by text, so no pair crosses texts.
    """
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    t = toks.withColumn("gap", F.coalesce(F.last(F.when(~F.col("is_space"), F.col("end")), ignorenulls=True).over(w), F.lit(0)))
    hit = (F.col("s") < F.col("e")) & (F.col("s") < F.col("end")) & (F.col("e") > F.col("start"))
    ins = (F.col("s") == F.col("e")) & (F.col("gap") <= F.col("s")) & (F.col("s") <= F.col("start"))
    marks = t.join(spans, key).where(hit | ins).groupBy(key, "i").agg(F.max(hit).alias("err"), F.max(ins).alias("ins"))
    m = t.join(marks, [key, "i"], "left")
    state = F.coalesce(F.col("err"), F.lit(False)) | F.coalesce(F.col("ins"), F.lit(False))
    m = m.withColumn("__prev", F.last(F.when(~F.col("is_space"), state), ignorenulls=True).over(w))
    return m.withColumn("gold", F.when(F.col("err"), "ERR_TOK").when(F.col("ins"), "ERR_INS").when(F.col("__prev"), "POST").otherwise("OK")).drop("__prev", "err", "ins", "gap")


def wrap_lines(words: Column, width: int) -> Column:
    """Greedy wrap of an array of words: the line number of each, from 0."""
    start = F.struct(F.lit(0).alias("line"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        fits = (a["used"] == 0) | (a["used"] + 1 + F.length(x) <= width)
        line = F.when(fits, a["line"]).otherwise(a["line"] + 1)
        used = F.when(~fits | (a["used"] == 0), F.length(x)).otherwise(a["used"] + 1 + F.length(x))
        return F.struct(line.alias("line"), used.alias("used"), F.concat(a["out"], F.array(line)).alias("out"))

    return F.aggregate(words, start, step, lambda a: a["out"])


def topk(probabilities: Column, k: int) -> Column:
    """The k greatest of an array with their places from 0, greatest first, lesser places first among equals."""
    pairs = F.transform(probabilities, lambda p, i: F.struct((-p).alias("neg"), i.alias("id")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda x: F.struct(x["id"].alias("id"), (-x["neg"]).alias("p")))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def entropy_bits(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log2(x)).otherwise(0.0))
