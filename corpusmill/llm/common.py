"""What the operators of this package share: Arrow batches, durable tables, input checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch that goes to a Python worker; bounds its memory whatever the length of texts.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20

#: Numbers up to which a written table of hashes is broadcast, over all its rows and arrays: some 16 MB.
BROADCAST_NUMBERS = 1_000_000

#: `[^\x20\x09-\x0D]+` splits at these bytes, as ``bytes.split()`` does.
SPACE_WORDS = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes; long texts would otherwise fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    One of our own is set only where none is, as in local tests.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="corpusmill-")
        sc.setCheckpointDir(found)
    return found


def durable(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a checkpoint in the shared folder, so that lost executors lose nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """As ``durable``, as a Parquet table under the shared folder: column pruning works on it and it is compressed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/corpusmill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, numbers: Column | int | None = None) -> DataFrame:
    """Broadcast a written table that holds few numbers, by an exact sum over its rows; a larger one is joined by a shuffle."""
    held = df.agg(F.coalesce(F.sum(F.lit(len(df.columns)) if numbers is None else numbers), F.lit(0))).first()[0]
    return F.broadcast(df) if held <= BROADCAST_NUMBERS else df


def require(df: DataFrame, **kinds: str) -> None:
    """Name the columns that an operator needs; others may exist beside them and are not read."""
    missing = [c for c in kinds.values() if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else, whatever the locale or script."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    """Each text; null is empty."""
    return [x or "" for x in column.to_pylist()]


def batch_of(names: Sequence[str], types: Sequence[pa.DataType], columns: Iterable) -> pa.RecordBatch:
    """A record batch from columns that are lists or arrays."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, t in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=list(names))
