"""From bursts to the timeline: one narrow Arrow stage, expressions, one shuffle by user and run."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kinetra import constants as K
from kinetra.functions import columns as C
from kinetra.functions import kernels as N
from kinetra.operators import decode, store

_FEATURES = ["valid_fraction", "sma", "vertical_std", "cadence_hz", "dominant_freq_hz", "periodicity", "jerk_mean", "jerk_std", "zcr", "tilt_deg", "gyro_rms", "gyro_x_rms", "gyro_y_rms", "gyro_z_rms", "acc_gyro_phase"]
WINDOW_DDL = "uuid string, timestamp long, `index` int, t_start_s double, t_end_s double, " + ", ".join(f"{f} double" for f in _FEATURES) + ", cadence_peaks int, has_gyro boolean, flags array<string>"
SIGNAL_DDL = "uuid string, timestamp long, t array<double>, body array<double>, tilt array<double>, valid_fraction double, coverage_s double, accel_unit string, gaps array<struct<start_s:double,end_s:double>>, flags array<string>"


#: Bursts that a task computes together.
SLICE = 512


def _cells(column: pa.ListArray) -> list[tuple]:
    """Times and x, y, z of every burst as views of the column's flat values; ``(None, None)`` for none."""
    values = column.values
    flat = dict(zip((f.name for f in values.type), values.flatten()))
    data = np.column_stack([flat[n].to_numpy(zero_copy_only=False).astype(float) for n in "txyz"])
    edges, known = column.offsets.to_numpy().tolist(), column.is_valid().to_pylist()
    return [(data[lo:hi, 0], data[lo:hi, 1:]) if ok and hi > lo else (None, None) for lo, hi, ok in zip(edges, edges[1:], known)]


def decoded(batch: pa.RecordBatch) -> Iterator[tuple[str, int, dict]]:
    for u, ts, (t, a), (g_t, g) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _cells(batch.column(2)), _cells(batch.column(3))):
        yield u, ts, N.preprocess(t, a, g_t, g) if t is not None else N.preprocess(np.empty(0), np.empty((0, 3)))


def _resampled(batch: pa.RecordBatch) -> Iterator[tuple[str, int, dict | None]]:
    """Bursts on their grid; ``None`` for those of fewer than two samples, which have no windows."""
    for u, ts, (t, a), (g_t, g) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _cells(batch.column(2)), _cells(batch.column(3))):
        yield u, ts, N.resampled(t, a, g_t, g) if t is not None and len(t) >= 2 else None


def arrow_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type, from_pandas=True) for f in schema], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def preprocess(bursts: DataFrame) -> DataFrame:
    """K13 for every burst ``(uuid, timestamp, acc, gyro)``: no shuffle."""

    schema = arrow_schema(SIGNAL_DDL)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for u, ts, s in decoded(batch):
                body = np.linalg.norm(s["body"], axis=1) if len(s["t"]) else np.empty(0)
                tilt = N.tilt_deg(s["gravity"]).tolist() if len(s["t"]) else []
                gaps = [{"start_s": x, "end_s": y} for x, y in s["gaps"]]
                out.append({"uuid": u, "timestamp": ts, "t": s["t"].tolist(), "body": body.tolist(), "tilt": tilt, "valid_fraction": s["valid_fraction"], "coverage_s": s["coverage_s"], "accel_unit": s["unit"], "gaps": gaps, "flags": s["flags"]})
            yield arrow_batch(out, schema)

    return bursts.select("uuid", "timestamp", "acc", "gyro").mapInArrow(run, SIGNAL_DDL)


def _single(u: str, ts: int, s: dict, size: int, hop: int, signals: bool) -> Iterator[dict]:
    extra, before = {"unit_ambiguous"} & set(s["flags"]), False
    for i, lo in enumerate(range(0, len(s["t"]) - size + 1, hop)):
        f = N.window_features(s, lo, lo + size)
        row = {"uuid": u, "timestamp": ts, "index": i, "t_start_s": float(s["t"][lo]), "t_end_s": float(s["t"][lo + size - 1]), **f, "flags": sorted({*f["flags"], *extra})}
        usable = "insufficient_data" not in f["flags"]
        if signals and usable and not before:
            row |= {"sig_t": s["t"].tolist(), "sig_body": np.linalg.norm(s["body"], axis=1).tolist()}
        before = usable
        yield row


def _lists(flat: np.ndarray, offsets: np.ndarray, missing: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.float64()), mask=pa.array(missing))


def _together(some: list[tuple[str, int, dict]], size: int, hop: int, signals: bool, schema: pa.Schema) -> pa.RecordBatch:
    """Windows of bursts of equal length without holes, all with rotation or all without."""
    raw, t = np.stack([s["raw"] for *_, s in some]), some[0][2]["t"]
    gyro = np.stack([s["gyro"] for *_, s in some]) if some[0][2]["gyro"] is not None else None
    grav = N.gravity_bulk(raw, gyro)
    body, starts = raw - grav, np.arange(0, len(t) - size + 1, hop)
    inside = (starts[:, None] + np.arange(size)[None, :]).ravel()
    each = lambda x: x[:, inside].reshape(-1, size, 3)
    f = N.window_features_bulk(each(body), each(grav), None if gyro is None else each(gyro))
    b, w = len(some), len(starts)
    unsure = np.repeat([("unit_ambiguous" in s["flags"]) for *_, s in some], w)
    kinds = pa.array([sorted((["no_gyro"] if gyro is None else []) + (["too_quiet_for_cadence"] if k & 1 else []) + (["unit_ambiguous"] if k & 2 else [])) for k in range(4)], pa.list_(pa.string()))
    burst = pa.array(np.repeat(np.arange(b), w))
    cols = {"uuid": pa.array([u for u, *_ in some], pa.string()).take(burst), "timestamp": pa.array([ts for _, ts, _ in some], pa.int64()).take(burst), "index": np.tile(np.arange(w), b), "t_start_s": np.tile(t[starts], b), "t_end_s": np.tile(t[starts + size - 1], b), "flags": kinds.take(pa.array(f.pop("quiet") + 2 * unsure)), **f}
    if signals:
        first = np.tile(np.arange(w) == 0, b)
        offsets = np.concatenate(([0], np.cumsum(first * len(t))))
        cols |= {"sig_t": _lists(np.tile(t, b), offsets, ~first), "sig_body": _lists(np.linalg.norm(body, axis=2).ravel(), offsets, ~first)}
    return pa.RecordBatch.from_arrays([(c if isinstance(c := cols[x.name], pa.Array) else pa.array(c, from_pandas=True)).cast(x.type) for x in schema], schema=schema)


def windows(bursts: DataFrame, size_s: float = K.WINDOW_S, overlap: float = K.OVERLAP, signals: bool = False, source: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> DataFrame:
    """Windows of 2 s, half overlapping, with all features: no shuffle.  With ``signals`` the first window
    of each stretch of usable ones carries the burst's sample times and body magnitudes.

    Bursts of equal length without holes are computed together, the others one by one.  ``source`` turns slices
    of ``bursts`` into ``(uuid, timestamp, acc, gyro)`` inside the task, so signals need not pass through the JVM.
    """
    size = int(round(size_s * K.TARGET_HZ))
    hop = max(1, int(round(size * (1 - overlap))))

    ddl = WINDOW_DDL + (", sig_t array<double>, sig_body array<double>" if signals else "")
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                alike, rows = defaultdict(list), []
                for u, ts, s in _resampled(part if source is None else source(part)):
                    if s is not None and N.whole(s, size):
                        alike[len(s["t"]), s["gyro"] is not None].append((u, ts, s))
                    elif s is not None:
                        rows.extend(_single(u, ts, N.filtered(s), size, hop, signals))
                for some in alike.values():
                    yield _together(some, size, hop, signals, schema)
                yield arrow_batch(rows, schema)

    return (bursts if source is not None else bursts.select("uuid", "timestamp", "acc", "gyro")).mapInArrow(run, ddl)


def feature_columns(placement: Column | None = None, placeholder: bool = False) -> dict[str, Column]:
    """Window columns as rule features; ``placeholder`` gives the reduced set (tilt 90, no rhythm)."""
    fill = lambda c, v=0.0: F.coalesce(F.when(~F.isnan(F.col(c)), F.col(c)), F.lit(v))
    out = {c: fill(c) for c in ("sma", "vertical_std", "jerk_mean", "jerk_std", "zcr", "gyro_rms", "gyro_x_rms", "gyro_y_rms", "gyro_z_rms", "periodicity", "dominant_freq_hz", "acc_gyro_phase")}
    out |= {"tilt_deg": fill("tilt_deg", 90.0), "cadence_bpm": fill("cadence_hz") * 60, "has_gyro": F.coalesce("has_gyro", F.lit(False)), "phone_placement": placement if placement is not None else F.lit("unknown")}
    if placeholder:
        out |= {"tilt_deg": F.lit(90.0), "periodicity": F.lit(0.0), "jerk_mean": F.lit(0.0), "dominant_freq_hz": F.lit(0.0), "acc_gyro_phase": F.lit(0.0)}
    return out


def score(w: DataFrame, th: dict[str, float] = K.THRESHOLDS, model: Callable[[DataFrame], Column] | None = None, alpha: float = 0.5, placeholder: bool = False) -> DataFrame:
    """``probs`` for usable windows; a learned scorer (a Column of class probabilities) is
    mixed in by ``alpha`` and certain running overrides."""
    f = feature_columns(placeholder=placeholder)
    p = C.predict_proba(f, th)
    if model is not None:
        p = C.blend(model(w), p, F.lit(float(alpha)))
    p = C.running_override(p, f["sma"], f["jerk_mean"], f["cadence_bpm"], th)
    return w.withColumn("probs", F.when(~F.array_contains("flags", "insufficient_data"), p))


def timeline(bursts: DataFrame, transitions: DataFrame | None = None, *, snap: bool = True, max_join_gap: float = 0.0, temperature: float = 1.0, source: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> DataFrame:
    """The whole plan: bursts (or what ``source`` makes them of) to timeline rows."""
    model = transitions if transitions is not None else decode.default_model(bursts.sparkSession)
    scored = score(windows(bursts, signals=snap, source=source))
    return store.timeline_rows(decode.segment_windows(scored, model, max_join_gap=max_join_gap, temperature=temperature))


def samples(bursts: DataFrame) -> DataFrame:
    """Absolute sample times with their validity, for coverage joins."""
    s = preprocess(bursts).select("uuid", "timestamp", F.explode(F.arrays_zip("t", "body")).alias("s"))
    return s.select("uuid", (F.col("timestamp") + F.col("s.t")).alias("t"), (F.col("s.body").isNotNull() & ~F.isnan("s.body")).alias("ok"))


def synthetic_days(events: DataFrame) -> DataFrame:
    """What the bursts below follow, ``(uuid, timestamp, amp, pace, spun)``, from all event rows: one for each user and day."""
    sec = F.col("ts").cast("timestamp").cast("double")
    days = events.groupBy(F.col("user_id").cast("string").alias("uuid"), F.to_date("ts").alias("day")).agg(F.min(sec).alias("first"), F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"), F.sum((F.col("event_type") == "error").cast("int")).alias("e"))
    # dealt before the signals are made: the grouped rows are small enough for one partition, their signals are not
    spark = events.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    days = days.repartition(parts, "uuid", "day")
    amp = F.pmod(F.coalesce("m", F.lit(0.0)) / 40.0, F.lit(0.6))
    return days.select("uuid", (F.floor(F.col("first") / 60) * 60).cast("long").alias("timestamp"), amp.alias("amp"), F.pmod(F.col("n"), F.lit(4)).cast("int").alias("pace"), F.coalesce(F.col("e") == 0, F.lit(False)).alias("spun"))


def synthetic_signals(batch: pa.RecordBatch, n_samples: int = 400, hz: float = 40.0) -> pa.RecordBatch:
    """Bursts ``(uuid, timestamp, acc, gyro)`` of a slice of ``synthetic_days``: a stepping motion whose strength and
    pace follow the day's values and number of events."""
    amp, pace = batch.column(2).to_numpy(zero_copy_only=False)[:, None], batch.column(3).to_numpy(zero_copy_only=False)
    i = np.arange(n_samples)
    wave = np.array([[math.sin(x) for x in 2 * np.pi * (1.0 + k * 0.5) * i / hz] for k in range(4)])[pace]
    t, flat = np.broadcast_to(i / hz, wave.shape), lambda x: np.full(wave.shape, x)
    offsets = pa.array(np.arange(len(wave) + 1) * n_samples, pa.int32())

    def cells(x, y, z, missing=None):
        values = pa.StructArray.from_arrays([pa.array(c.ravel()) for c in (t, x, y, z)], list("txyz"))
        return pa.ListArray.from_arrays(offsets, values, mask=missing)

    acc = cells(0.5 + amp * 0.5 * wave, flat(0.1), -0.86 - amp * 0.86 * wave)
    gyro = cells(0.05 * wave, amp * wave, flat(0.01), pa.compute.invert(batch.column(4)))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), acc, gyro], names=["uuid", "timestamp", "acc", "gyro"])


def synthetic_bursts(events: DataFrame) -> DataFrame:
    """Bursts derived from all event rows by a fixed rule: one for each user and day, in the minute of its first
    event."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                yield synthetic_signals(batch.slice(at, SLICE))

    cell = "array<struct<t:double,x:double,y:double,z:double>>"
    return synthetic_days(events).mapInArrow(run, f"uuid string, timestamp long, acc {cell}, gyro {cell}")
