"""Timeline tables: upserts, lookups, foreign keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """SK2: of rows with equal keys the last in ``order`` stays, with all its columns."""
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order)).alias("__r"))
    return best.select(*keys, "__r.*").select(*rows.columns)


def upsert(existing: DataFrame, new: DataFrame, key: str, *order: str) -> DataFrame:
    """SK2: rows of ``new`` replace those of equal key; among several new ones the last by ``order`` wins, or,
    without it, by all their other columns from left to right (never a random one)."""
    by = order or tuple(c for c in new.columns if c != key)
    fresh = last_wins(new, [key], [F.col(c) for c in by]) if by else new.distinct()
    return existing.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def anomaly_rows(events: DataFrame) -> DataFrame:
    """SK3: ``event_id`` from segment and method; NaN becomes null."""
    doubles = {f.name for f in events.schema.fields if f.dataType.simpleString() == "double"}
    cols = [F.when(~F.isnan(c), F.col(c)).alias(c) if c in doubles else F.col(c) for c in events.columns]
    return events.select(F.concat_ws(":", "segment_id", "method").alias("event_id"), *cols)


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """SK3: rows that break the foreign key; an upsert is valid if there are none."""
    return child.join(parent.select(key).distinct(), key, "left_anti")


def upsert_anomalies(existing: DataFrame, events: DataFrame, timeline: DataFrame) -> DataFrame:
    new = anomaly_rows(events)
    if not orphans(new, timeline, "segment_id").isEmpty():
        raise ValueError("an event names a segment that the timeline does not have")
    return upsert(existing, new, "event_id", *(c for c in ("t_start", "t_end", "score") if c in new.columns))


def timeline_rows(segments: DataFrame) -> DataFrame:
    """SK6: segments as timeline rows; the label reference defaults to the whole second of the start."""
    ref = F.col("t_label_start_ref") if "t_label_start_ref" in segments.columns else F.lit(None).cast("long")
    return segments.withColumn("t_label_start_ref", F.coalesce(ref, F.col("t_start").cast("long")))


def slice_signal(t: Column, x: Column, lo: Column, hi: Column, closed: bool = False) -> Column:
    """SK5/A1: samples in ``[lo, hi)``, or ``[lo, hi]`` where closed."""
    pairs = F.arrays_zip(t.alias("t"), x.alias("x"))
    inside = F.filter(pairs, lambda s: (s["t"] >= lo - 1e-9) & ((s["t"] <= hi + 1e-9) if closed else (s["t"] < hi - 1e-9)))
    return F.transform(inside, lambda s: s["x"])


def page(rows: DataFrame, uuid: str | None = None, first: str | None = None, last: str | None = None, limit: int | None = None) -> DataFrame:
    """P9/P10/T-3: filters on user and UTC days (as bounds on ``t_start``, so they reach the scan), then order
    and limit."""
    out = rows if uuid is None else rows.where(F.col("uuid") == uuid)
    if first is not None:
        out = out.where(F.col("t_start") >= F.unix_timestamp(F.lit(first), "yyyy-MM-dd"))
    if last is not None:
        out = out.where(F.col("t_start") < F.unix_timestamp(F.lit(last), "yyyy-MM-dd") + 86400)
    out = out.orderBy("t_start", "segment_id")
    return out.limit(limit) if limit else out


def by_source(rows: DataFrame, uuid: str, ref: int) -> DataFrame:
    """P11."""
    return rows.where((F.col("uuid") == uuid) & (F.col("t_label_start_ref") == ref)).orderBy("t_start")


def by_id(rows: DataFrame, segment_id: str) -> DataFrame:
    """P12."""
    return rows.where(F.col("segment_id") == segment_id)


def anomalies_of(events: DataFrame, segment_id: str) -> DataFrame:
    """Events of a segment by time; JSON flags become arrays, null numbers NaN."""
    doubles = {f.name for f in events.schema.fields if f.dataType.simpleString() == "double"}
    cols = [F.coalesce(c, F.lit(float("nan"))).alias(c) if c in doubles else (F.from_json(c, "array<string>").alias(c) if c == "flags" and dict(events.dtypes)[c] == "string" else F.col(c)) for c in events.columns]
    return events.where(F.col("segment_id") == segment_id).select(*cols).orderBy("t_start")


def collisions(segments: DataFrame) -> DataFrame:
    """Segment ids that several segments share (same user, second and label)."""
    return segments.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """T-5: the last segment of each key by start."""
    w = W.partitionBy(*keys).orderBy(F.desc("t_start"), F.desc("segment_id"))
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
