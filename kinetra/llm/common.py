"""Shared helpers of the corpus operators: checkpoints, batches of bounded size, column checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text that a kernel takes at once.
SLICE_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent (single-machine tests) a temporary folder is made and used.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    now = spark.sparkContext.getCheckpointDir()
    if now is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        now = tempfile.mkdtemp(prefix="kinetra-")
        spark.sparkContext.setCheckpointDir(now)
    return now


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder; later plans start from there.

    A lost executor costs nothing that was written; the files go when the frame is no longer used
    (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def keyed_mod(column, n: int):
    """crc32 of an integer column's decimal text, modulo ``n``; null for null."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(n)


def text_slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of Arrow batches with about ``most`` bytes of text each (one text at least), with the texts."""
    for batch in batches:
        at, n = 0, batch.num_rows
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
        while at < n:
            end, total = at, 0
            while end < n and (end == at or total + sizes[end] <= most):
                total += sizes[end]
                end += 1
            part = batch.slice(at, end - at)
            yield part, part.column(part.schema.get_field_index(column)).to_pylist()
            at = end
