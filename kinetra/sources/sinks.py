"""Writers: swap on success, JSON reports, aligned text."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TIMELINE_DDL = "segment_id string not null, uuid string not null, t_label_start_ref long not null, t_start double, t_end double, label string, confidence double, coverage_s double, label_minutes_covered int, n_windows int, flags array<string>, mean_probs array<double>"
EVENTS_DDL = "event_id string not null, segment_id string not null, t_start double, t_end double, method string, score double, trigger_jerk_energy double, trigger_tilt_deg_mean double, trigger_tilt_deg_std double"


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    """SK1: a table without rows."""
    return spark.createDataFrame([], ddl)


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def replace(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """SK2: writes beside ``path`` and swaps the folders when the write is complete; a failed write leaves the
    old table as it was.  ``df`` may read the table that it replaces."""
    spark = df.sparkSession
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(new)
    fs, target = _files(spark, path)
    _, fresh = _files(spark, new)
    _, gone = _files(spark, old)
    had = fs.exists(target)
    if had and not fs.rename(target, gone):
        raise OSError(f"{path} could not be moved aside")
    if not fs.rename(fresh, target):
        if had:
            fs.rename(gone, target)
        raise OSError(f"{new} could not take the place of {path}")
    if had:
        fs.delete(gone, True)


def report(df: DataFrame, path: str) -> None:
    """SK7: one JSON object per row."""
    df.write.mode("overwrite").json(path)


def aligned(*columns: tuple[Column, int]) -> Column:
    """SK8: columns as text of fixed width."""
    return F.concat(*[F.rpad(F.coalesce(c.cast("string"), F.lit("")), w, " ") for c, w in columns])


def progress_bar(share: Column, width: int = 20) -> Column:
    """SK8: filled and empty cells."""
    n = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * width).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("#"), n), F.repeat(F.lit("."), F.lit(width) - n), F.lit("]"))
