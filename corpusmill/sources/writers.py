"""Writers. Spark's commit protocol makes each write appear whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str, *by: str) -> None:
    """Gzip JSON lines."""
    df.write.mode("overwrite").partitionBy(*by).option("compression", "gzip").json(path)


def parquet(df: DataFrame, path: str, *by: str, rows_per_file: int = 0) -> None:
    """Zstandard Parquet; files of at most so many rows."""
    df.write.mode("overwrite").partitionBy(*by).option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)


def csv(df: DataFrame, path: str) -> None:
    """Gzip CSV with a header."""
    df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def report(df: DataFrame, path: str, append: bool = False) -> None:
    """Rows as JSON lines: a report, or with ``append`` a log."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("append" if append else "overwrite").text(path)


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Overwrite the partitions that ``df`` has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
