"""Operators as stages: documents in, documents out.

A stage carries a document's row as one struct beside what it adds, so no name of a column clashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import SPACE_WORDS, small, written
from corpusmill.llm.line_dedup import drop_boilerplate
from corpusmill.llm.mixing import mix
from corpusmill.llm.packing import pack
from corpusmill.llm.quality import score_rows, train_quality
from corpusmill.llm.simhash import near_duplicates


def _as_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Documents that the quality classifier scores at ``threshold`` or more, as they are.

    A null or empty text has the score of an empty one; rows are judged by their text alone, so repeated
    ones and those without an id stay or go alike; an empty table gives no rows; columns may have any
    other names.
    """
    scored = score_rows(_as_rows(docs), train_quality(docs, labels))
    return scored.where(F.col("score") >= threshold).select("row.*")


def drop_lines(docs: DataFrame, min_sites: int = 5, min_chars: int = 20) -> DataFrame:
    """Documents without their boilerplate lines; ``n_chars`` follows the text where there is one.

    A null text stays null and keeps its ``n_chars``; an empty one stays empty; rows that repeat are
    treated alike; a null id counts as the greatest; an empty table gives no rows; columns may have
    any other names but ``n_lines`` and ``n_removed``.
    """
    left = drop_boilerplate(docs, min_sites, min_chars).drop("n_lines", "n_removed")
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near copies, that of the least id, and all documents without any.

    Rows alike in id and text are one document and stay together. A document without an id goes if its
    group has another; of a repeated id each text is judged by itself. Texts without words, null ones
    too, are copies of each other. An empty table gives no rows; columns may have any other names.
    """
    gone = near_duplicates(docs, shingle, similarity).where("not kept").select(F.col("doc_id").alias("id"), "text_hash").distinct()
    gone = written(gone, "copies")
    rows = _as_rows(docs).withColumn("own_hash", F.xxhash64(F.coalesce("row.text", F.lit(""))))
    same = F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("text_hash"))
    return rows.join(small(gone), same, "left_anti").select("row.*")


def mix_sources(docs: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Documents as many times as the mix takes them.

    Of the one document a source that the mix takes a part of, half or more counts as a copy. Rows
    of one id are taken alike, null ids too; documents without words, null texts too, are not taken;
    a null source is a source; an empty table gives no rows; columns may have any other names.
    """
    taken = mix(docs, weights, share, most)
    copies = taken.groupBy(F.col("doc_id").alias("id")).agg(F.sum("taken").alias("t"), F.sum("size").alias("s")).where("s > 0").select("id", F.round(F.col("t") / F.col("s")).cast("int").alias("copies")).where("copies > 0")
    copies = written(copies, "copies")
    joined = _as_rows(docs).join(small(copies), F.col("row.doc_id").eqNullSafe(F.col("id")))
    worded = joined.where(F.coalesce(F.col("row.text").rlike(SPACE_WORDS), F.lit(False)))
    return worded.select("row", F.explode(F.expr("sequence(1, copies)"))).select("row.*")


def pack_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096) -> DataFrame:
    """Pieces of sequences; copies of a document are packed each.

    A null or empty text is its end alone; ids may be null or repeat; an empty table gives no rows;
    other columns are not read.
    """
    return pack(docs, tokenizer, end_id, capacity)
