"""Interval logic: sessions, bucketed overlap joins, coverage, probe search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetra import constants as K


def runs(rows: DataFrame, keys: list[str], start: str, end: str, usable: Column, gap: float) -> DataFrame:
    """Adds ``run_id`` to usable rows: a run breaks at an unusable row or where a row starts more than
    ``gap`` behind the latest end so far."""
    order = W.partitionBy(*keys).orderBy(start, end)
    first = rows.withColumn("__island", F.sum((~usable).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))).where(usable)
    inner = W.partitionBy(*keys, "__island").orderBy(start, end)
    latest = F.max(end).over(inner.rowsBetween(W.unboundedPreceding, -1))
    broken = F.coalesce(F.col(start) > latest + gap + 1e-9, F.lit(True))
    marked = first.withColumn("__new", broken.cast("int"))
    return marked.withColumn("run_id", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("__new", "__island")


def _binned(rows: DataFrame, start: str, end: str, width: float) -> DataFrame:
    """One row per bin that a half-open interval touches; intervals without length touch none."""
    last = F.ceil(F.col(end) / width) - 1
    return rows.where(F.col(end) > F.col(start)).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.greatest(last, F.floor(F.col(start) / width)))))


def overlap_pairs(left: DataFrame, right: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Pairs of ``(l_start, l_end)`` and ``(r_start, r_end)`` intervals that overlap, once each, with ``overlap``.

    An equi-join on key and time bin; the pair is kept in the bin where the overlap begins only.
    """
    a, b = _binned(left, "l_start", "l_end", width), _binned(right, "r_start", "r_end", width)
    joined = a.join(b, [*keys, "__bin"])
    lo, hi = F.greatest("l_start", "r_start"), F.least("l_end", "r_end")
    return joined.withColumn("overlap", hi - lo).where((F.col("overlap") > 0) & (F.floor(lo / width) == F.col("__bin"))).drop("__bin")


def majority_label(minutes: DataFrame, segments: DataFrame, keys: list[str], width: float = 60.0) -> DataFrame:
    """For each minute the segment of largest overlap, the earlier one on ties; others are left out."""
    pairs = overlap_pairs(minutes, segments, keys, width)
    best = W.partitionBy(*keys, "l_start").orderBy(F.desc("overlap"), "r_start", "label")
    return pairs.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")


def _covered(queries: DataFrame, samples: DataFrame, keys: list[str], width: float) -> DataFrame:
    """J7 for the queries that hold samples.  Never a broadcast: the planner's size of exploded bins is too small."""
    binned = _binned(queries.withColumn("__q", F.struct(*queries.columns)), "q0", "q1", width)
    points = samples.withColumn("__bin", F.floor(F.col("t") / width)).select(*keys, "__bin", "t", "ok")
    hits = binned.hint("merge").join(points, [*keys, "__bin"]).where("t >= q0 and t < q1")
    return hits.groupBy(*queries.columns).agg(F.avg(F.col("ok").cast("double")).alias("coverage"))


def coverage(queries: DataFrame, samples: DataFrame, keys: list[str], width: float = 60.0) -> DataFrame:
    """J7 on samples ``(t, ok)``: share of finite samples in ``[q0, q1)``, 0 without samples."""
    found = _covered(queries, samples, keys, width)
    same = [F.col(f"q.`{c}`").eqNullSafe(F.col(f"f.`{c}`")) for c in queries.columns]  # a null column is no reason to lose coverage
    both = queries.alias("q").join(found.alias("f"), reduce(lambda a, b: a & b, same), "left")
    return both.select(*(F.col(f"q.`{c}`").alias(c) for c in queries.columns), F.coalesce("f.coverage", F.lit(0.0)).alias("coverage"))


def coverage_scalar(coverage_s: Column, q0: Column, q1: Column) -> Column:
    """J7 without samples: covered seconds by the query's span, between 0 and 1; 0 for an empty span."""
    span = q1 - q0
    return F.when(span > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), coverage_s / span))).otherwise(F.lit(0.0))


def _probe(ord_: Column) -> tuple[Column, Column]:
    """Start and end of the probe number ``ord_`` of an evidence row, cut to ``[seg_lo, seg_hi]``."""
    shift = F.when(ord_ % 2 == 1, (ord_ + 1) / 2).otherwise(-ord_ / 2) * K.PROBE_STEP_S
    mid, wide, lo, hi = _reach()
    return F.greatest(lo, mid + shift - wide / 2), F.least(hi, mid + shift + wide / 2)


def _reach() -> tuple[Column, Column, Column, Column]:
    """Middle of an evidence row, width of its probes, and the bounds that hold them all."""
    mid, wide = (F.col("t_start") + F.col("t_end")) / 2, F.greatest(F.lit(K.PROBE_MIN_S), F.col("t_end") - F.col("t_start"))
    return mid, wide, F.greatest("seg_lo", mid - K.WIDEN_S), F.least("seg_hi", mid + K.WIDEN_S)


def probes(evidence: DataFrame) -> DataFrame:
    """Outward probes 0, +1, -1, ... seconds around an interval's middle, cut to ``[seg_lo, seg_hi]``."""
    ordered = evidence.withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(2 * K.WIDEN_S))))
    q0, q1 = _probe(F.col("ord"))
    return ordered.withColumn("q0", q0).withColumn("q1", q1).where("q1 > q0")


def nearest_covered(evidence: DataFrame, samples: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """The first probe with coverage above 0, one row per evidence row that has one.

    Probes overlap (``PROBE_MIN_S`` is above ``PROBE_STEP_S``), so the first covered one holds the finite sample
    nearest to the middle on one of its sides.  Those two come from one sort of rows and samples by key and time
    bin; only the probes that may hold them are made, not all of each row.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    mid, wide, lo, hi = _reach()
    rows = evidence.where(known).select(*keys, id_col, "t_start", "t_end", "seg_lo", "seg_hi", lo.alias("__lo"), hi.alias("__hi"))
    rows = _binned(rows, "__lo", "__hi", 2.0 * K.WIDEN_S)
    row = F.struct(id_col, "t_start", "t_end", "seg_lo", "seg_hi", "__lo", "__hi")
    none = F.lit(None)
    asked = rows.select(*keys, "__bin", F.greatest("__lo", F.least("__hi", mid)).alias("__at"), none.cast("double").alias("__t"), row.alias("__row"))
    points = samples.where(known & F.col("ok")).select(*keys, F.floor(F.col("t") / (2.0 * K.WIDEN_S)).alias("__bin"), F.col("t").cast("double").alias("__at"), F.col("t").cast("double").alias("__t"), none.cast(asked.schema["__row"].dataType).alias("__row"))
    here, so_far = W.partitionBy(*keys, "__bin"), (W.unboundedPreceding, W.currentRow)
    before = F.max("__t").over(here.orderBy(F.asc("__at"), F.col("__row").isNull()).rowsBetween(*so_far))
    behind = F.min("__t").over(here.orderBy(F.desc("__at"), F.col("__row").isNotNull()).rowsBetween(*so_far))
    sides = asked.unionByName(points).withColumn("__l", before).withColumn("__r", behind).where("__row is not null")
    near = sides.select(*keys, "__row.*", F.explode(F.array("__l", "__r")).alias("__t")).where("__t >= __lo and __t < __hi")
    # the count of steps is rounded, so its neighbours are tried as well, by the bounds of the probes themselves
    steps = F.greatest(F.lit(0.0), F.least(F.lit(float(K.WIDEN_S)), F.floor((F.abs(F.col("__t") - mid) - wide / 2) / K.PROBE_STEP_S))).cast("int")
    tried = near.withColumn("ord", F.explode(F.sequence(F.greatest(F.lit(0), 2 * steps - 3), F.least(F.lit(2 * K.WIDEN_S), 2 * steps + 4))))
    q0, q1 = _probe(F.col("ord"))
    held = tried.withColumn("q0", q0).withColumn("q1", q1).where("__t >= q0 and __t < q1")
    first = held.groupBy(*keys, id_col).agg(F.min(F.struct("ord", "q0", "q1")).alias("p")).select(*keys, id_col, "p.*")
    return _covered(first, samples, keys, 2.0 * K.PROBE_MIN_S)


def no_overlap(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """G8's assertion as rows: those that the next row of the key overlaps."""
    nxt = F.lead(start).over(W.partitionBy(*keys).orderBy(start, end))
    return rows.where(F.lit(True)).withColumn("__next", nxt).where(F.col(end) > F.col("__next") + 1e-9).drop("__next")
