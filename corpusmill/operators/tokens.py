"""The token relation and what is counted on it."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions import text as T

PAD = "#"


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col, keep..., i, tok``: the lower-case words of each text, numbered from 0. Texts without words give no rows."""
    return docs.select(id_col, *keep, F.posexplode(T.words(F.col(text_col))).alias("i", "tok"))


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, sent, words``: the words of each line that has any, numbered from 0 as the lines stand."""
    parts = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("sent", "line"))
    return parts.select(id_col, "sent", T.words(F.col("line")).alias("words")).where(F.size("words") > 0)


def word_arrays(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep..., w``: the words of each text as one array.

    The array comes out of a Generate, so it is a value of the row: as a plain expression it would be
    put into every lambda that reads it, and worked out again for each word.
    """
    return docs.select(*keep, F.explode(F.array(T.words(F.col(text_col)))).alias("w"))


def ngrams(docs: DataFrame, n: int = 3, text_col: str = "text") -> DataFrame:
    """``token_0.. token_{n-1}, count``: n-grams that end at each word, padded before a text's first.

    Each word picks its neighbours from its row's array, so a text costs as many steps as it has words;
    counted in each task before the only shuffle, which is by n-gram.
    """
    names = [f"token_{k}" for k in range(n)]
    before = [f"coalesce(get(w, i - {n - 1 - k}), '{PAD}') as {c}" for k, c in enumerate(names[:-1])]
    grams = F.expr(f"transform(w, (x, i) -> struct({', '.join([*before, f'x as {names[-1]}'])}))")
    return word_arrays(docs, text_col).select(F.inline(grams)).groupBy(*names).agg(F.count("*").alias("count"))


def at_least(counts: DataFrame, least: int = 2) -> DataFrame:
    """Counts of at least so much, after the global sum."""
    return counts.where(F.col("count") >= least)


def marginal(grams: DataFrame, *columns: str) -> DataFrame:
    """Counts summed over the other columns."""
    return grams.groupBy(*columns).agg(F.sum("count").alias("count"))


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


#: Fixed rule that stands in for a parser: the relation of neighbouring words by the second's ending.
RELATIONS = (("ly", "advmod"), ("ed", "dobj"), ("ing", "amod"))


def relation(dependent: Column) -> Column:
    out = None
    for ending, name in RELATIONS:
        hit = F.endswith(dependent, F.lit(ending))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("dep")


def dependency_pairs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``head_lemma, head_tag, relation, dependent_lemma, dependent_tag, count`` by the neighbour rule; roots have no head.

    An annotated table goes through ``dependency_counts`` instead.
    """
    pairs = F.expr("transform(slice(w, 1, greatest(size(w) - 1, 0)), (x, i) -> struct(x as h, get(w, i + 1) as d))")
    rows = word_arrays(docs, text_col).select(F.inline(pairs))
    tag = lambda x: F.when(x.rlike("^[0-9]+$"), "NUM").otherwise("WORD")
    return rows.groupBy(F.col("h").alias("head_lemma"), tag(F.col("h")).alias("head_tag"), relation(F.col("d")).alias("relation"), F.col("d").alias("dependent_lemma"), tag(F.col("d")).alias("dependent_tag")).agg(F.count("*").alias("count"))


def dependency_counts(parsed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Dependency pairs of an annotated token table, without roots and punctuation."""
    child = parsed.where(~F.col("dep").isin("ROOT", "punct")).alias("c")
    head = parsed.alias("h")
    joined = child.join(head, (F.col(f"c.{id_col}") == F.col(f"h.{id_col}")) & (F.col("c.head_i") == F.col("h.i")))
    keys = [F.lower("h.lemma").alias("head_lemma"), F.col("h.tag").alias("head_tag"), F.col("c.dep").alias("relation"), F.lower("c.lemma").alias("dependent_lemma"), F.col("c.tag").alias("dependent_tag")]
    return joined.groupBy(*keys).agg(F.count("*").alias("count"))


def association(pairs: DataFrame) -> DataFrame:
    """Association measures of each (head, relation, dependent): pmi, mi2, mi3, log-Dice and delta-P.

    Marginals are over all relations, and so is the total, which is one row and broadcast.
    """
    joint = pairs.groupBy("head_lemma", "relation", "dependent_lemma").agg(F.sum("count").cast("double").alias("f"))
    heads = pairs.groupBy("head_lemma").agg(F.sum("count").cast("double").alias("f1"))
    dependents = pairs.groupBy("dependent_lemma").agg(F.sum("count").cast("double").alias("f2"))
    total = pairs.agg(F.sum("count").cast("double").alias("n"))
    j = joint.join(heads, "head_lemma").join(dependents, "dependent_lemma").crossJoin(F.broadcast(total))
    ratio = lambda p: F.log2(F.pow("f", F.lit(p)) * F.col("n") / (F.col("f1") * F.col("f2")))
    delta = F.try_divide(F.col("f"), F.col("f1")) - F.try_divide(F.col("f2") - F.col("f"), F.col("n") - F.col("f1"))
    return j.select("head_lemma", "relation", "dependent_lemma", "f", "f1", "f2", "n", ratio(1).alias("pmi"), ratio(2).alias("mi2"), ratio(3).alias("mi3"), (F.lit(14.0) + F.log2(2 * F.col("f") / (F.col("f1") + F.col("f2")))).alias("log_dice"), delta.alias("delta_p"))


def attestation(ctx: DataFrame, grams: DataFrame, key: str, prefix: str) -> DataFrame:
    """Attach the corpus counts of each token and of its left and right bigrams: ``ctx(key, tok, prev, next)``.

    The corpus table is cut to the words of the context by a semi-join before it is summed to bigrams;
    unigrams are sums of these, so the corpus is read and shuffled once (the later uses are one exchange).
    Adds ``{prefix}_log_uni`` and flags of unseen unigram and bigrams.
    """
    needed = ctx.select(F.col("tok").alias("token_2")).distinct()
    bi = marginal(grams.join(needed, "token_2", "left_semi"), "token_1", "token_2")
    uni = marginal(bi, "token_2").withColumnsRenamed({"token_2": "tok", "count": "u"})
    left = bi.select(F.col("token_1").alias("prev"), F.col("token_2").alias("tok"), F.col("count").alias("l"))
    right = bi.select(F.col("token_1").alias("tok"), F.col("token_2").alias("next"), F.col("count").alias("r"))
    out = ctx.join(uni, "tok", "left").join(left, ["prev", "tok"], "left").join(right, ["tok", "next"], "left")
    flag = lambda c: F.col(c).isNull().cast("double")
    return out.select(*[c for c in ctx.columns], F.log1p(F.coalesce("u", F.lit(0))).alias(f"{prefix}_log_uni"), flag("u").alias(f"{prefix}_unseen_uni"), flag("l").alias(f"{prefix}_unseen_bi_left"), flag("r").alias(f"{prefix}_unseen_bi_right"))


def with_neighbours(toks: DataFrame, key: str) -> DataFrame:
    """Previous and next token in order, the pad at the edges."""
    w = Window.partitionBy(key).orderBy("i")
    return toks.withColumn("prev", F.lag("tok", 1, PAD).over(w)).withColumn("next", F.lead("tok", 1, PAD).over(w))


def annotate(docs: DataFrame, annotator, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Run a parser over texts in batches: ``annotator(text) -> list of dicts`` of ``schema``.

    A text that fails gives one row with its error and no token; others are not lost with it.
    """
    import pandas as pd

    names = [f.split()[0] for f in schema.split(",")]
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for ident, text in zip(batch[id_col], batch[text_col], strict=True):
                try:
                    rows += [(ident, *[t.get(c) for c in names], None) for t in annotator(text or "")]
                except Exception as e:  # noqa: BLE001  a parser may raise anything
                    rows.append((ident, *[None] * len(names), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[id_col, *names, "error"])

    return docs.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, {schema}, error string")
