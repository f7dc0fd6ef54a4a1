"""Word lists and rules on words."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from corpusmill.functions import near_words
from corpusmill.streaming.ingest import work_dir

#: Closed word classes; the first that holds a word names it.
WORD_CLASSES = {
    "DET": "a an the this that these those my your his her its our their some any no every each",
    "PREP": "in on at for to of with about from by into onto over under after before during through between without within among against toward towards upon like",
    "PRON": "i me you he him she it we us they them myself yourself himself herself itself ourselves themselves who whom what which",
    "AUX": "is are am was were be been being have has had do does did will would shall should can could may might must",
    "CONJ": "and or but nor so yet because although though if unless while whereas when since as than then that",
}
CLASS_ORDER = ("DET", "PREP", "PRON", "AUX", "CONJ", "PUNCT", "CONTENT")

#: Connectives.
CONNECTIVES = (
    "also although and because besides but consequently conversely finally first firstly for furthermore hence however if indeed "
    "instead lastly likewise meanwhile moreover nevertheless next nonetheless nor once or otherwise overall second secondly similarly "
    "since so still subsequently then therefore third thirdly though thus unless whereas while yet"
).split()


def word_class(word: Column) -> Column:
    """PUNCT for no letters, digits or white space; else the first closed class that has the word; else CONTENT."""
    w = F.lower(F.trim(word))
    out = F.when((w == "") | w.rlike(r"(?U)^[^\w\s]+$"), "PUNCT")
    for name, members in WORD_CLASSES.items():
        out = out.when(w.isin(members.split()), name)
    return out.otherwise("CONTENT")


def morph_relation(a: Column, b: Column, same_paradigm: Column) -> Column:
    """How two forms are related: IRREG for one irregular paradigm, S, ED, ING by the longer one's ending, else OTHER.

    The longer form is the second where lengths are equal.
    """
    swap = F.length(a) > F.length(b)
    short, long = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)

    def plural(ending: str) -> Column:
        stem = F.substring(long, F.lit(1), F.length(long) - len(ending))
        cut = F.substring(short, F.lit(1), F.length(short) - 1)
        return F.endswith(long, F.lit(ending)) & ((stem == short) | (F.concat(stem, F.lit("y")) == short) | (stem == cut))

    is_s = plural("s") | plural("es") | plural("ies")
    is_ed = F.endswith(long, F.lit("ed")) | F.endswith(long, F.lit("d")) | F.endswith(long, F.lit("ied"))
    is_ing = F.endswith(long, F.lit("ing")) | F.endswith(short, F.lit("ing"))
    return F.when(same_paradigm, "IRREG").when(is_s, "S").when(is_ed, "ED").when(is_ing, "ING").otherwise("OTHER")


def label_group(label: Column) -> Column:
    """none, lexical (a content word) or grammatical."""
    return F.when(label == "NONE", "none").when(F.endswith(label, F.lit("_CONTENT")), "lexical").otherwise("grammatical")


def edit_subclass(kind: Column, observed: Column, candidate: Column, relation: Column, is_contraction: Column, observed_known: Column) -> Column:
    """Subclass of an edit: MORPH by relation, FORM by what was repaired, DEL by the observed word, PRED and INS by the candidate."""
    return (
        F.when(kind == "MORPH", F.concat(F.lit("MORPH_"), relation))
        .when((kind == "FORM") & is_contraction, "FORM_CONTRACT")
        .when((kind == "FORM") & ~observed_known, "FORM_NONWORD")
        .when(kind == "FORM", "FORM_REALWORD")
        .when(kind == "DEL", F.concat(F.lit("DEL_"), word_class(observed)))
        .otherwise(F.concat(kind, F.lit("_"), word_class(candidate)))
    )


def split_by_pos(subclass: Column, pos: Column) -> Column:
    """Number of nouns and agreement of verbs apart, where the subclass is that of an -s."""
    return F.when((subclass == "MORPH_S") & pos.isin("NOUN", "PROPN"), "MORPH_S_N").when((subclass == "MORPH_S") & pos.isin("VERB", "AUX"), "MORPH_S_V").otherwise(subclass)


def osa_distance(a: str, b: str) -> int:
    """Optimal string alignment: insert, delete, replace, and swap of neighbours, no part edited twice."""
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            now.append(best)
        before, last = last, now
    return last[-1]


@F.pandas_udf(IntegerType())
def osa(a: pd.Series, b: pd.Series) -> pd.Series:
    """``osa_distance`` of two columns; null where either is."""
    return pd.Series([None if x is None or y is None else osa_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def edit_cost(kind: Column, observed: Column, candidate: Column, distance: Column) -> Column:
    """Characters an edit changes: a deletion or insertion its word and a space, others their distance."""
    return F.when(kind == "DEL", F.length(observed) + 1).when(kind == "INS", F.length(candidate) + 1).otherwise(distance)


def similar_words(counts: DataFrame, word: str, count: str, most: int = 8) -> DataFrame:
    """``word, other, distance, pick``: for each word the nearest others, by distance and then by frequency.

    Words of more than three letters have partners up to distance 2, shorter ones 1. Words are ranked by
    frequency and go, packed, to tasks that each look at some of the forms by which words meet
    (``near_words``); no pairs but each task's nearest are exchanged. A repeated word counts by its greatest
    count; a null is none. Two forms of one hash would end the query, not change a row.
    """
    spark = counts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = counts.where(F.col(word).isNotNull()).groupBy(F.col(word).alias("word")).agg(F.max(count).alias("c"))
    path = work_dir(spark, "words")
    words.orderBy(F.desc("c"), "word").select("word", F.monotonically_increasing_id().alias("at")).write.mode("overwrite").parquet(path)
    ordered = spark.read.schema("word string, at long").parquet(path)
    # ids are gapless within a partition, whose number stands above bit 33
    sizes = {r.p: r.n for r in ordered.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(p, 0)
    lengths = {r.k: r.n for r in ordered.groupBy(F.length("word").alias("k")).agg(F.count("*").alias("n")).collect()}
    start = F.array(*[F.lit(x).cast("long") for x in starts or [0]])[F.shiftright("at", 33).cast("int")]
    ranked = ordered.select("word", (start + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"))
    tasks, buckets = near_words.plan(lengths), max(1, -(-total // near_words.MERGED))
    # rows are few and each is much work, so the number of partitions is set, not chosen by size
    packed = ranked.mapInArrow(near_words.packer(tasks), "task long, length long, n long, words binary, ids binary").repartition(max(parts, len(tasks)), "task")
    links = packed.groupBy("task").applyInArrow(near_words.linker(tasks, most, buckets), "bucket long, n long, links binary")
    near = links.repartition(max(parts, buckets), "bucket").groupBy("bucket").applyInArrow(near_words.merger(most, buckets), "w long, o long, distance int, pick int")
    named = near.join(ranked.select(F.col("rank").alias("o"), F.col("word").alias("other")), "o").join(ranked.select(F.col("rank").alias("w"), "word"), "w")
    far = F.levenshtein("word", "other") > 2 * F.col("distance")
    return named.select("word", "other", F.when(far, F.raise_error(F.lit("two forms have one hash")).cast("int")).otherwise(F.col("distance")).alias("distance"), "pick")
