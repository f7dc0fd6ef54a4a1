"""Readers of documents, essays, scores and annotations. Schemas are declared, never inferred."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "id string, dolma_id string, text string, url string, metadata string"
SAMPLED = "dolma_id string, source string, text string, token_count int, metadata string"
ESSAY_JSON = "id string, text string, cefr string, edits array<string>"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, gzip by the file's ending; metadata may be an object or a string of one. Lines that are no JSON are left out.

    A task that fails is read again whole, so no row is given twice.
    """
    raw = spark.read.schema(RAW + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    plain = F.get_json_object("metadata", "$.source_domain")
    return raw.where("_bad is null").select(F.coalesce("id", "dolma_id").alias("id"), "text", F.coalesce("url", F.get_json_object("metadata", "$.url")).alias("url"), plain.alias("source_domain"), "metadata")


def sampled(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLED).json(path)


def manifest(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    """Lines of a list of urls that hold any of the folders."""
    hit = F.lit(False)
    for f in folders:
        hit = hit | F.contains("value", F.lit(f"/{f}/"))
    return spark.read.text(path).where(hit).withColumnRenamed("value", "url")


def stride(df: DataFrame, row: str, worker: int, workers: int) -> DataFrame:
    """Rows of one worker, by their number."""
    return df.where(F.pmod(F.col(row), F.lit(workers)) == worker)


def scored_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, gzip by the file's ending."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def essays_csv(spark: SparkSession, path: str, scores: list[str], id_col: str = "text_id_kaggle", text_col: str = "full_text") -> DataFrame:
    """Essays with scores; rows without text go, score names are lower-cased and packed."""
    schema = f"{id_col} string, {text_col} string, prompt string, " + ", ".join(f"`{s}` double" for s in scores)
    rows = scored_csv(spark, path, schema).na.drop(subset=[text_col])
    return rows.select(F.col(id_col).alias("text_id"), F.col(text_col).alias("text"), "prompt", F.struct(*[F.col(s).alias(s.lower()) for s in scores]).alias("scores"))


def essays_json(spark: SparkSession, path: str) -> DataFrame:
    """Essays of JSON lines with nested edits: the first annotator's, level and split by the file's name, level N where none is given."""
    raw = spark.read.text(path).select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))
    j = lambda p: F.get_json_object("value", p)
    parts = F.split("file", r"\.")
    edits = F.from_json(j("$.edits[0][1]"), "array<array<string>>")
    spans = F.transform(edits, lambda e: F.struct(F.get(e, F.lit(0)).cast("int").alias("start"), F.get(e, F.lit(1)).cast("int").alias("end"), F.get(e, F.lit(2)).alias("replacement")))
    return raw.select(j("$.id").alias("text_id"), j("$.text").alias("text"), F.coalesce(j("$.cefr"), F.lit("N")).alias("cefr"), F.get(parts, F.lit(0)).alias("level"), F.get(parts, F.lit(1)).alias("split"), spans.alias("edits"))


def zipped_texts(spark: SparkSession, path: str) -> DataFrame:
    """``file, text`` of the text files in zip archives; UTF-8, else Latin-1. An archive is one row, so one task's memory holds the largest."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if name.endswith(".txt"):
                            raw = z.read(name)
                            try:
                                text = raw.decode("utf-8")
                            except UnicodeDecodeError:
                                text = raw.decode("latin-1")
                            yield pd.DataFrame({"file": [name.rsplit("/", 1)[-1]], "text": [text]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "file string, text string")


def indexed_texts(texts: DataFrame, index: DataFrame, file_col: str) -> tuple[DataFrame, DataFrame]:
    """Texts with their index rows, empty ones left out; and index rows whose file is missing."""
    own = index.withColumnRenamed(file_col, "file")
    return own.join(texts, "file").where(F.trim("text") != ""), own.join(texts, "file", "left_anti")


def shards(spark: SparkSession, path: str, corpus: str, expected: int | None = None) -> DataFrame:
    """Parquet shards tagged with their corpus; the number of rows may be checked."""
    df = spark.read.parquet(path).withColumn("corpus", F.lit(corpus))
    if expected is not None and (n := df.count()) != expected:
        raise ValueError(f"{path} has {n} rows, not {expected}")
    return df


def summary(spark: SparkSession, path: str, schema: str) -> dict | None:
    """One JSON object; None where it is broken or absent."""
    try:
        row = spark.read.schema(schema + ", _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path).first()
    except Exception:  # noqa: BLE001  an absent path is an analysis error of several kinds
        return None
    return None if row is None or row["_bad"] is not None else {k: v for k, v in row.asDict().items() if k != "_bad"}
