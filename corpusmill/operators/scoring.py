"""Scores of tokens by pluggable models, and their aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def score_with(docs: DataFrame, scorer: Callable[[list[str]], list[list[dict]]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Run a model over batches of texts: for each a list of ``{token_i, text, losses, entropies}``, in nats."""
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, token_i int, text string, losses array<double>, entropies array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for ident, found in zip(batch[id_col], scorer(batch[text_col].fillna("").tolist()), strict=True):
                rows += [(ident, t["token_i"], t["text"], t["losses"], t["entropies"]) for t in found]
            yield pd.DataFrame(rows, columns=[id_col, "token_i", "text", "losses", "entropies"])

    return docs.select(id_col, text_col).mapInPandas(run, schema)


def add_k_bits(count: str, context: str, size: str, k: float = 0.1) -> Column:
    """-log2 of a trigram's add-k probability, from its count, its context's and the vocabulary's size."""
    return -F.log2((F.col(count) + k) / (F.col(context) + k * F.col(size)))


def ngram_surprisal(grams: DataFrame, k: float = 0.1) -> DataFrame:
    """The scorer without a model: -log2 of add-k trigram probabilities, ``token_0..2, surprisal_bits``.

    Contexts are summed from the trigrams; the vocabulary's size is one row and broadcast.
    """
    context = grams.groupBy("token_0", "token_1").agg(F.sum("count").alias("c2"))
    size = grams.agg(F.countDistinct("token_2").alias("v"))
    bits = add_k_bits("count", "c2", "v", k)
    return grams.join(context, ["token_0", "token_1"]).crossJoin(F.broadcast(size)).select("token_0", "token_1", "token_2", bits.alias("surprisal_bits"))


def trigram_rows(toks: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy("i")
    return toks.select(key, "i", F.lag("tok", 2, "#").over(w).alias("token_0"), F.lag("tok", 1, "#").over(w).alias("token_1"), F.col("tok").alias("token_2"))


def essay_summary(scores: DataFrame, key: str, value: str = "surprisal_bits", tau: float | None = None) -> DataFrame:
    """Per text: scored tokens, mean, variance (0 with fewer than two), and how many reach ``tau``."""
    x = F.col(value)
    finite = F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)
    high = [F.count_if(finite >= tau).alias("n_high")] if tau is not None else []
    return scores.groupBy(key).agg(F.count(finite).alias("n_scored"), F.avg(finite).alias("mean_surprisal"), F.coalesce(F.var_samp(finite), F.lit(0.0)).alias("var_surprisal"), *high)


def apply_deltas(rows: DataFrame, deltas: DataFrame, key: str) -> DataFrame:
    """Update mean and variance of each text by the sums of changes, without its tokens: ``rows(key, n, mean, var)``, ``deltas(key, d1, d2)``.

    d1 and d2 are the changes of the sum and of the sum of squares.
    """
    s1 = F.col("n") * F.col("mean")
    s2 = F.col("var") * (F.col("n") - 1) + F.col("n") * F.col("mean") * F.col("mean")
    n1, n2 = s1 + F.coalesce("d1", F.lit(0.0)), s2 + F.coalesce("d2", F.lit(0.0))
    mean = F.try_divide(n1, F.col("n"))
    var = F.when(F.col("n") > 1, F.greatest(F.lit(0.0), (n2 - n1 * n1 / F.col("n")) / (F.col("n") - 1))).otherwise(0.0)
    return rows.join(deltas, key, "left").select(*[c for c in rows.columns if c not in ("mean", "var")], mean.alias("mean"), var.alias("var"))


def policies(losses: Column) -> dict[str, Column]:
    """A word's loss from its pieces': the first, their sum, their mean."""
    total = F.aggregate(losses, F.lit(0.0), lambda a, x: a + x)
    return {"first": F.get(losses, F.lit(0)), "sum": total, "mean": F.try_divide(total, F.size(losses))}


def window_tokens(label: Column, max_context: Column, masked: Column) -> Column:
    """Tokens of a window label; ``full`` is the model's context, less two marks for masked models."""
    return F.when(label == "full", max_context - F.when(masked, 2).otherwise(0)).otherwise(label.try_cast("int"))


def fertility(pieces: DataFrame, key: str) -> DataFrame:
    """Subwords to a word, over all and over alphabetic words, and shares of words in two and three or more pieces: ``pieces(key, word_i, is_alpha, n)``."""
    n, alpha = F.sum("n"), F.sum(F.when(F.col("is_alpha"), F.col("n")))
    return pieces.groupBy(key).agg(
        F.count("*").alias("n_words"), n.alias("n_subwords"), F.try_divide(n, F.count("*")).alias("fertility"), F.try_divide(alpha, F.count_if("is_alpha")).alias("fertility_alpha"),
        F.count_if(F.col("n") >= 2).alias("split2"), F.count_if(F.col("n") >= 3).alias("split3"),
    )
