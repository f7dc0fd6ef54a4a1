"""Features of documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from corpusmill.functions.lexicon import CONNECTIVES
from corpusmill.operators.tokens import sentences, tokens

#: Parts of speech and relations of the dependency scheme.
CONTENT_POS = ("NOUN", "VERB", "ADJ", "ADV")
SUBJECT = ("nsubj", "nsubjpass", "csubj", "csubjpass", "expl")
AUXILIARY = ("aux", "auxpass")
NOMINAL = ("NOUN", "PROPN")
SUBORDINATING = ("advcl", "ccomp", "relcl", "acl", "csubj", "csubjpass", "xcomp", "pcomp", "conj")
MODIFIERS = ("amod", "compound", "poss", "prep", "relcl", "acl", "appos", "nmod", "nummod")
SUBJECTLESS = ("ROOT", "ccomp", "advcl", "relcl", "acl", "pcomp")
NOMINAL_CLAUSE = ("ccomp", "csubj", "csubjpass")
COORDINATED = ("ADJ", "ADV", "NOUN", "PROPN", "PRON", "VERB")


def lexical(docs: DataFrame, frequencies: DataFrame, total: int | Column, id_col: str = "doc_id") -> DataFrame:
    """Mean word length and mean log10 relative frequency, words that the table has not counting 1."""
    t = tokens(docs, id_col)
    f = t.join(frequencies, "tok", "left")
    return f.groupBy(id_col).agg(F.count("*").alias("n_tokens"), F.avg(F.length("tok")).alias("mean_word_length"), F.avg(F.log10(F.coalesce("count", F.lit(1)) / total)).alias("log_mean_token_freq"), (F.countDistinct("tok") / F.count("*")).alias("type_token_ratio"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), union))


def adjacent_overlap(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Mean Jaccard of the word sets of neighbouring sentences; null with fewer than two."""
    s = sentences(docs, id_col).withColumn("next", F.lead("words").over(Window.partitionBy(id_col).orderBy("sent")))
    return s.groupBy(id_col).agg(F.count("*").alias("n_sents"), F.avg(F.when(F.col("next").isNotNull(), jaccard(F.col("words"), F.col("next")))).alias("overlap"))


def connective_density(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Connectives to a sentence."""
    s = sentences(docs, id_col)
    n = F.size(F.filter("words", lambda w: w.isin(CONNECTIVES)))
    return s.groupBy(id_col).agg((F.sum(n) / F.count("*")).alias("connective_density"))


def cosine(a: Column, b: Column) -> Column:
    """Null where either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


@F.pandas_udf(DoubleType())
def mtld(words: pd.Series) -> pd.Series:
    """Mean length of runs that keep a type-token ratio of 0.72, of both directions (McCarthy and Jarvis, 2010); null with fewer than 10 words."""

    def one(ws) -> float:
        factors, types, n = 0.0, set(), 0
        for w in ws:
            n += 1
            types.add(w)
            if len(types) / n <= 0.72:
                factors, types, n = factors + 1, set(), 0
        if n:
            factors += (1 - len(types) / n) / (1 - 0.72)
        return len(ws) / factors if factors else float(len(ws))

    return pd.Series([None if w is None or len(w) < 10 else (one(list(w)) + one(list(w)[::-1])) / 2 for w in words], dtype="float64")


def syntactic(parsed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Clause and nominal measures of an annotated token table.

    ``parsed(id, sent_id, i, pos, tag, dep, head_i, finite, is_punct, is_space, is_alpha)``. Children are one
    aggregate by head, joined back on (text, token). ``is_alpha`` marks words of letters alone.
    """
    p = parsed
    child = p.where(F.col("head_i") != F.col("i")).groupBy(id_col, F.col("head_i").alias("i")).agg(
        F.max(F.col("dep").isin(*SUBJECT)).alias("has_subject"), F.max(F.col("dep").isin(*AUXILIARY) & F.col("finite")).alias("finite_aux"), F.max(F.col("dep") == "mark").alias("has_mark"),
        F.max(F.col("dep").isin(*MODIFIERS)).alias("has_modifier"), F.count_if(F.col("dep") != "punct").alias("n_children"),
    )
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    t = p.join(child, [id_col, "i"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    is_finite = F.col("finite") | no("finite_aux")
    imperative = (F.col("tag") == "VB") & (F.col("dep") == "ROOT") & ~no("has_subject")
    clause = F.col("pos").isin("VERB", "AUX") & ~F.col("dep").isin(*AUXILIARY) & (imperative | (is_finite & (no("has_subject") | F.col("dep").isin(*SUBJECTLESS))))
    free = ~F.col("dep").isin(*SUBORDINATING) | ((F.col("dep") == "ccomp") & (F.col("i") < F.col("head_i")) & ~no("has_mark"))
    t = t.withColumn("clause", clause).withColumn("seed", F.col("clause") & ((F.col("dep") == "ROOT") | free))
    units = t_units(t.where("clause"), id_col)
    nominal = F.col("pos").isin(*NOMINAL)
    sums = t.groupBy(id_col).agg(
        F.count_if(~F.col("is_punct") & ~F.col("is_space")).alias("n_words"), F.count_if("clause").alias("clauses"),
        F.count_if((nominal & no("has_modifier")) | F.col("dep").isin(*NOMINAL_CLAUSE)).alias("complex_nominals"),
        F.count_if((F.col("dep") == "conj") & F.col("pos").isin(*COORDINATED) & ~F.col("clause")).alias("coordinated"),
        F.avg(F.when(F.col("clause"), F.col("n_children"))).alias("deps_per_clause"), F.avg(F.when(nominal, F.col("n_children"))).alias("deps_per_nominal"),
        F.try_divide(F.count_if(F.col("pos").isin(*CONTENT_POS) & F.col("is_alpha")), F.count_if("is_alpha")).alias("lexical_density"),
    )
    s = sums.join(units, id_col, "left")
    per = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return s.select(id_col, "n_words", "clauses", F.coalesce("t_units", F.lit(0)).alias("t_units"), per("clauses", "t_units").alias("clauses_per_tunit"), per("n_words", "clauses").alias("mean_length_of_clause"), per("complex_nominals", "clauses").alias("complex_nominals_per_clause"), per("coordinated", "clauses").alias("coord_phrases_per_clause"), "deps_per_clause", "deps_per_nominal", "lexical_density")


def t_units(clauses: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """T-units of each text from its clause heads ``(id, sent_id, i, head_i, dep, seed)``.

    A clause coordinated with an independent one is independent too. The clauses of a sentence, which
    are few, are gathered by one shuffle, and the chains of coordination are followed in its array:
    each step adds those whose head has been reached, and there are no more steps than clauses. A
    sentence with clauses of which none is independent is one unit.
    """
    each = F.collect_list(F.struct("i", "head_i", (F.col("dep") == "conj").alias("conj"), "seed"))
    s = clauses.groupBy(id_col, "sent_id").agg(each.alias("c")).select(id_col, F.explode(F.array("c")).alias("c"))
    reached = "transform(filter(c, x -> x.seed), x -> x.i)"
    step = "(r, k) -> array_union(r, transform(filter(c, x -> x.conj and array_contains(r, x.head_i)), x -> x.i))"
    n = F.size(F.expr(f"aggregate(sequence(1, size(c)), {reached}, {step})"))
    return s.groupBy(id_col).agg(F.sum(F.greatest(n, F.lit(1))).alias("t_units"))


def phraseological(pairs: DataFrame, association: DataFrame, relations: tuple[str, ...], id_col: str = "doc_id") -> DataFrame:
    """Mean PMI of a text's pairs of each relation; pairs that the reference has not are left out."""
    known = pairs.where(F.col("relation").isin(*relations)).join(association.select("head_lemma", "relation", "dependent_lemma", "pmi"), ["head_lemma", "relation", "dependent_lemma"])
    return known.groupBy(id_col).pivot("relation", list(relations)).agg(F.avg("pmi"))
