"""Daily rollups, bouts, rolling and calendar trends, totals (all declarative; one shuffle key each)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetra import constants as K


def as_minutes(events: DataFrame, user: str = "user_id", label: str = "event_type", ts: str = "ts") -> DataFrame:
    """``(uuid, label, timestamp, t_start)`` from timestamped rows: minute and exact second since the epoch."""
    sec = F.col(ts).cast("timestamp").cast("double")
    return events.select(F.col(user).cast("string").alias("uuid"), F.col(label).alias("label"), (F.floor(sec / K.MINUTE_S) * K.MINUTE_S).cast("long").alias("timestamp"), sec.alias("t_start"))


def utc_day(seconds: Column) -> Column:
    return F.to_date(F.timestamp_seconds(seconds))


def daily_rollup(minutes: DataFrame, gap_minutes: int = K.BOUT_GAP_MINUTES) -> DataFrame:
    """G-1/G-2: per user, UTC day and activity: distinct minutes x 60 s, bouts, mean bout, first and last onset.

    A new bout begins when two labelled minutes are more than ``(gap + 1)`` minutes apart.
    """
    day = utc_day(F.col("timestamp"))
    once = minutes.where("label is not null and label <> ''").groupBy("uuid", day.alias("date"), F.col("label").alias("activity"), "timestamp").agg(F.min("t_start").alias("lo"), F.max("t_start").alias("hi"))
    before = F.lag("timestamp").over(W.partitionBy("uuid", "date", "activity").orderBy("timestamp"))
    marked = once.withColumn("new", (before.isNull() | (F.col("timestamp") - before > (gap_minutes + 1) * K.MINUTE_S)).cast("int"))
    out = marked.groupBy("uuid", "date", "activity").agg(F.count(F.lit(1)).alias("labeled_minutes"), F.sum("new").alias("bout_count"), F.min("lo").alias("first_onset"), F.max("hi").alias("last_onset"))
    total = (F.col("labeled_minutes") * K.MINUTE_S).cast("double")
    return out.select("uuid", "date", "activity", total.alias("total_duration_s"), "bout_count", (total / F.col("bout_count")).alias("avg_bout_s"), "first_onset", "last_onset", "labeled_minutes")


def zero_filled(daily: DataFrame, keys: list[str], date: str = "date", value: str = "total_duration_s") -> DataFrame:
    """Each key's own first to last day, missing days with 0."""
    sums = daily.groupBy(*keys, date).agg(F.sum(value).alias(value))
    span = sums.groupBy(*keys).agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    days = span.select(*keys, F.explode(F.sequence("lo", "hi")).alias(date))
    return days.join(sums, [*keys, date], "left").withColumn("has", F.col(value).isNotNull().cast("int")).withColumn(value, F.coalesce(value, F.lit(0.0)))


def rolling_days(daily: DataFrame, keys: list[str], rows: int = 7, date: str = "date", value: str = "total_duration_s") -> DataFrame:
    """Mean over the last ``rows`` zero-filled days (fewer at the start) and days with data among them."""
    w = W.partitionBy(*keys).orderBy(date).rowsBetween(1 - rows, 0)
    return zero_filled(daily, keys, date, value).select(*keys, date, F.avg(value).over(w).alias("rolling_mean_duration_s"), F.sum("has").over(w).alias("n_days_with_data"))


def rolling_calendar(daily: DataFrame, keys: list[str], unit: str, date: str = "date", value: str = "total_duration_s") -> DataFrame:
    """Bins by month or year of the zero-filled days; expanding mean of bin means, cumulated data days."""
    bins = zero_filled(daily, keys, date, value).groupBy(*keys, F.trunc(date, unit).alias(date)).agg(F.avg(value).alias("m"), F.sum("has").alias("n"))
    w = W.partitionBy(*keys).orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    return bins.select(*keys, date, F.avg("m").over(w).alias("rolling_mean_duration_s"), F.sum("n").over(w).alias("n_days_with_data"))


def rolling(daily: DataFrame, window: str, keys: list[str] | None = None) -> DataFrame:
    """G-3: ``7d``, ``month`` or ``year`` trends; durations are summed per date over all users given."""
    keys = keys or ["activity"]
    if window == "7d":
        return rolling_days(daily, keys)
    if window in ("month", "year"):
        return rolling_calendar(daily, keys, window)
    raise ValueError("window must be 7d, month or year")


def daily_pivot(rows: DataFrame, labels: list[str], day: str = "date", label: str = "label", seconds: str = "duration_s") -> DataFrame:
    """G-4: minutes by day, one column per label, absent ones 0."""
    return rows.groupBy(day).pivot(label, labels).agg(F.sum(F.col(seconds) / 60)).fillna(0.0, labels)


def duration_by_label(rows: DataFrame) -> DataFrame:
    """G-5: total seconds by label."""
    return rows.groupBy("label").agg(F.sum(F.col("t_end") - F.col("t_start")).alias("total_s"))


def activity_total(rows: DataFrame, label: str) -> DataFrame:
    """G-6: totals of one activity."""
    return rows.where(F.col("label") == label).agg(F.sum(F.col("t_end") - F.col("t_start")).alias("total_s"), F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_conf"), F.min("t_start").alias("first_s"), F.max("t_end").alias("last_s"))


def data_coverage(rows: DataFrame, keys: list[str]) -> DataFrame:
    """G-7: distinct UTC dates, first and last."""
    d = utc_day(F.col("t_start"))
    return rows.groupBy(*keys).agg(F.count_distinct(d).alias("n_days"), F.min(d).alias("first_day"), F.max(d).alias("last_day"))


def class_weights(labels: DataFrame, label: str, beta: float = 0.999) -> DataFrame:
    """G-10: effective-number weights, scaled to mean 1 over the classes present."""
    n = labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    raw = n.withColumn("w", F.lit(1 - beta) / (1 - F.pow(F.lit(beta), F.col("n"))))
    mean = raw.agg(F.avg("w").alias("m"))
    return raw.crossJoin(F.broadcast(mean)).select(label, "n", (F.col("w") / F.col("m")).alias("weight"))  # one row


def ingest_summary(rows: DataFrame) -> DataFrame:
    """G-8: counts per class and per flag."""
    by_class = rows.groupBy(F.lit("class").alias("kind"), F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    by_flag = rows.select(F.explode("flags").alias("name")).groupBy(F.lit("flag").alias("kind"), "name").agg(F.count(F.lit(1)).alias("n"))
    return by_class.unionByName(by_flag)
