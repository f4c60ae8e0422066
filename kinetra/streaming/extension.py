"""Structured Streaming forms of the batch operators (an extension: the batch engine has no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding(stream: DataFrame, keys: list[str], ts: str, value: str, width: str, slide: str, late: str) -> DataFrame:
    """W1 with a watermark."""
    return stream.withWatermark(ts, late).groupBy(*keys, F.window(ts, width, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value")).select(*keys, F.col("w.start").alias("w_start"), "n", "mean_value")


def sessions(stream: DataFrame, keys: list[str], ts: str, gap: str, late: str) -> DataFrame:
    """W5 as session windows."""
    return stream.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("s_start"), F.col("w.end").alias("s_end"), "n")


def minutes(stream: DataFrame, ts: str, user: str, label: str, late: str) -> DataFrame:
    """Distinct labelled minutes, ready for the daily rollup."""
    m = F.window(ts, "1 minute")
    return stream.withWatermark(ts, late).groupBy(F.col(user).alias("uuid"), F.col(label).alias("label"), m.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("uuid", "label", F.unix_timestamp("w.start").alias("timestamp"), "n")
