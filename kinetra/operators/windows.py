"""Windows over ordered rows: sliding, tumbling by anchor, centred context, hop, CUSUM in SQL form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sliding_index(n: Column, size: int, hop: int) -> Column:
    """Starts of whole windows of ``size`` samples; a partial last one is dropped."""
    return F.when(n >= size, F.sequence(F.lit(0), n - size, F.lit(hop))).otherwise(F.array().cast("array<int>"))


def sliding_time(rows: DataFrame, keys: list[str], ts: str, value: str, width: str, slide: str) -> DataFrame:
    """W1 in event time: mean and count of each sliding window."""
    return rows.groupBy(*keys, F.window(ts, width, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value")).select(*keys, F.col("w.start").alias("w_start"), "n", "mean_value")


def anchored_chunks(times: Column, width: float, least: int) -> Column:
    """Chunks ``(start_index, stop_index, kept)`` of an ordered time array; each begins at the first sample
    behind the last chunk, and one with fewer than ``least`` samples is marked, not a stop."""
    start = F.aggregate(
        F.transform(times, lambda t, i: F.struct(t.alias("t"), i.alias("i"))),
        F.struct(F.lit(None).cast("double").alias("anchor"), F.array().cast("array<int>").alias("cuts")),
        lambda s, x: F.when(s["anchor"].isNull() | (x["t"] - s["anchor"] >= width), F.struct(x["t"].alias("anchor"), F.concat(s["cuts"], F.array(x["i"].cast("int"))).alias("cuts"))).otherwise(s),
    )["cuts"]
    stop = F.concat(F.slice(start, 2, F.greatest(F.size(start), F.lit(1))), F.array(F.size(times)))
    return F.zip_with(start, stop, lambda a, b: F.struct(a.alias("start_index"), b.alias("stop_index"), (b - a >= least).alias("kept")))


def context(rows: DataFrame, keys: list[str], order: list[str], value: str, reach: tuple[int, ...] = (2, 5)) -> DataFrame:
    """Centred mean and population deviation over neighbours, shrinking at the edges."""
    out = rows
    for k in reach:
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(-k, k)
        out = out.withColumn(f"roll{k}_mean", F.avg(value).over(w)).withColumn(f"roll{k}_std", F.stddev_pop(value).over(w))
    return out


def hop(rows: DataFrame, keys: list[str], order: list[str], start: str, default: float = 1.0) -> DataFrame:
    """First positive step between neighbours of a key, else ``default``."""
    step = F.lead(start).over(W.partitionBy(*keys).orderBy(*order)) - F.col(start)
    first = rows.withColumn("__step", step).groupBy(*keys).agg(F.min_by("__step", F.when(F.col("__step") > 0, F.col(order[0]))).alias("hop_s"))
    return first.withColumn("hop_s", F.coalesce("hop_s", F.lit(default)))


def change_point(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """G7 in SQL form: first row of the largest absolute sum of deviations from the key's mean."""
    mean = F.avg(value).over(W.partitionBy(*keys))
    dev = rows.withColumn("__d", F.col(value) - mean)
    run = F.sum("__d").over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    best = W.partitionBy(*keys).orderBy(F.desc("__c"), order)
    return dev.withColumn("__c", F.round(F.abs(run), 6)).withColumn("__r", F.row_number().over(best)).where("__r = 1").select(*keys, order, F.col("__c").alias("peak"))
