"""Segmentation: windows with class distributions become contiguous, non-overlapping segments.

Runs of usable windows (``intervals.runs``) are sorted by user and run and decoded as they pass, those of equal
length in a batch together, so no task holds a user's whole history.  The lattice needs order, hence an Arrow
function over sorted rows; all else is declarative.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kinetra import constants as K
from kinetra.functions import kernels as N
from kinetra.operators import intervals, metrics

#: Runs of equal length that are decoded together.
RUNS = 512

SEGMENT_DDL = (
    "segment_id string, uuid string, t_start double, t_end double, label string, confidence double, coverage_s double, "
    "label_minutes_covered int, n_windows int, mean_probs array<double>, flags array<string>"
)


def transition_arrays(model: DataFrame) -> tuple[np.ndarray, list[str]]:
    """The 7 x 7 model on the driver: matrix and the source of each row."""
    rows = model.collect()  # classes squared
    at = {c: i for i, c in enumerate(K.CLASSES)}
    p, source = np.zeros((len(at), len(at))), ["prior"] * len(at)
    for r in rows:
        p[at[r["from"]], at[r["to"]]] = r["p"]
        if "source" in r.asDict():
            source[at[r["from"]]] = r["source"]
    return p, source


def emit(run: dict, lo_row: int, hi_row: int, path: np.ndarray, sources: list[str], hop: float, snap: bool, radius_s: float = K.CUSUM_RADIUS_S) -> list[tuple]:
    """Stretches of equal state of the rows ``lo_row`` to ``hi_row`` share their (snapped, increasing)
    edges and tile the run."""
    cuts = [lo_row, *(np.flatnonzero(path[1:] != path[:-1]) + 1 + lo_row).tolist(), hi_row]
    ts, start, end = run["timestamp"], run["t_start_s"], run["t_end_s"]
    lo, hi = float(ts[lo_row] + start[lo_row]), float(ts[hi_row - 1] + end[hi_row - 1])
    edges, at_limit, floor = [lo], [False], lo
    signals = {int(ts[i]): i for i in np.flatnonzero(run["signal"][lo_row:hi_row]) + lo_row} if snap and len(cuts) > 2 else {}
    for c in cuts[1:-1]:
        e, hit = float(ts[c] + start[c]), False
        if int(ts[c]) in signals:
            t, body = (np.asarray(run[name][signals[int(ts[c])]].values) for name in ("sig_t", "sig_body"))
            idx, hit = N.cusum_snap(body, int(round(start[c] * K.TARGET_HZ)), int(round(radius_s * K.TARGET_HZ)))
            e = float(ts[c] + t[min(max(idx, 0), len(t) - 1)])
        floor = min(max(e, floor + 1e-6), hi - 1e-6)
        edges.append(floor)
        at_limit.append(hit)
    edges.append(hi)
    at_limit.append(False)
    least = max(1, int(round(K.MIN_ACTIVITY_S / hop))) if hop > 0 else 1
    out = []
    for i in range(len(cuts) - 1):
        a, b = cuts[i], cuts[i + 1]
        state = int(path[a - lo_row])
        label, span = K.CLASSES[state], edges[i + 1] - edges[i]
        flags = {"partial_coverage"} if run["partial"][a:b].any() else set()
        if sources[state] != "counts":
            flags.add("prior_transitions_used")
        if b - a < least:
            flags.add("truncated_by_coverage")
        if not snap:
            flags.add("no_cusum_refinement")
        elif at_limit[i] or at_limit[i + 1]:
            flags.add("cusum_hit_search_limit")
        uuid = run["uuid"][a].as_py()
        out.append((f"{uuid}:{int(edges[i])}:{label.replace(' ', '_')}", uuid, edges[i], edges[i + 1], label, float(run["certainty"][a:b].mean()), float(min(run["valid_fraction"][a:b].mean() * span, span)), len(set(ts[a:b].tolist())), b - a, run["probs"][a:b].mean(axis=0).tolist(), sorted(flags)))
    return out


def whole_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs with the bounds of each, from sorted batches that may cut runs anywhere."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        uuid, run = batch.column("uuid"), batch.column("run_id").to_numpy()
        new = np.concatenate(([False], run[1:] != run[:-1]))
        new[1:] |= ~pc.fill_null(pc.equal(uuid.slice(1), uuid.slice(0, len(uuid) - 1)), False).to_numpy(zero_copy_only=False) & ~(pc.and_(pc.is_null(uuid.slice(1)), pc.is_null(uuid.slice(0, len(uuid) - 1)))).to_numpy(zero_copy_only=False)
        new[0] = (uuid[0].as_py(), run[0]) != last
        if len(starts := np.flatnonzero(new)):
            if done := [*held, *([batch.slice(0, starts[-1])] if starts[-1] else [])]:
                table = pa.Table.from_batches(done).combine_chunks()
                before = sum(b.num_rows for b in held)
                yield table, np.unique([0, *(before + starts).tolist()])
            held = [batch.slice(starts[-1])]
        else:
            held.append(batch)
        last = (uuid[-1].as_py(), run[-1])
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.array([0, table.num_rows])


def segment_windows(windows: DataFrame, model: DataFrame, *, temperature: float = 1.0, max_join_gap: float = 0.0, hop: float = 1.0, min_duration: float = K.MIN_ACTIVITY_S, time_aware: bool = True) -> DataFrame:
    """Runs, calibrated emissions, minimum-run Viterbi, segments.

    Edges snap where the windows carry ``sig_t`` and ``sig_body`` (sample times and body magnitude of the
    burst, on the first window of each stretch), so signals need no join of their own.
    """
    p, sources = transition_arrays(model)
    k = max(int(round(min_duration / hop)), 3)
    log_p = np.log(np.maximum(p, 1e-12))
    q = N.generator(p, hop) if time_aware else None
    usable = F.col("probs").isNotNull() & ~F.array_contains("flags", "insufficient_data")
    w = windows.withColumn("abs_start", F.col("timestamp") + F.col("t_start_s")).withColumn("abs_end", F.col("timestamp") + F.col("t_end_s"))
    runs = intervals.runs(w, ["uuid"], "abs_start", "abs_end", usable, max_join_gap)
    snap = "sig_t" in windows.columns
    cols = ["uuid", "run_id", "timestamp", "t_start_s", "t_end_s", "abs_start", "probs", "valid_fraction", "flags", *(["sig_t", "sig_body"] if snap else [])]

    ddl = StructType.fromDDL(SEGMENT_DDL)
    schema = to_arrow_schema(ddl)

    def paths(logs: np.ndarray, starts: np.ndarray, known: dict[float, np.ndarray]) -> np.ndarray:
        """Best paths of runs of equal length, ``(runs, n, classes)`` with their starts ``(runs, n)``."""
        if q is None:
            return N.viterbi_bulk(logs, log_p[None], k, np.zeros((len(logs), logs.shape[1] - 1), int))
        dts, which = np.unique(np.round(np.maximum(np.diff(starts, axis=1), hop), 6), return_inverse=True)
        if len(known) > 4096:
            known.clear()
        for dt in set(dts.tolist()) - known.keys():
            known[dt] = np.log(N.transition_for(q, dt))
        matrices = np.stack([known[dt] for dt in dts.tolist()]) if len(dts) else log_p[None]
        return N.viterbi_bulk(logs, matrices, k, which.reshape(len(logs), -1))

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[float, np.ndarray] = {}
        for table, edges in whole_runs(batches):
            run = {c: table.column(c).chunk(0) for c in table.column_names}
            run |= {c: run[c].to_numpy(zero_copy_only=False) for c in ("timestamp", "t_start_s", "t_end_s", "abs_start", "valid_fraction", "partial")}
            probs = run["probs"] = run["probs"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(table.num_rows, -1)
            run["certainty"] = 1 + (probs * np.log(np.maximum(probs, 1e-300))).sum(axis=1) / np.log(probs.shape[1])
            if snap:
                run["signal"] = pc.fill_null(pc.greater(pc.list_value_length(run["sig_t"]), 0), False).to_numpy(zero_copy_only=False)
            logs = np.log(np.maximum(probs, 1e-12)) / temperature
            top = logs.max(axis=1, keepdims=True)
            logs = logs - top - np.log(np.exp(logs - top).sum(axis=1, keepdims=True))
            lengths, path = np.diff(edges), np.empty(table.num_rows, dtype=int)
            for n in np.unique(lengths).tolist():
                alike = edges[:-1][lengths == n]
                for at in range(0, len(alike), RUNS):
                    rows = alike[at : at + RUNS, None] + np.arange(n)[None, :]
                    path[rows] = paths(logs[rows], run["abs_start"][rows], known)
            out = [row for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()) for row in emit(run, lo, hi, path[lo:hi], sources, hop, snap)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    # the last window in ``runs`` has brought all rows of a user into one partition, so sorting them is enough
    sorted_ = runs.select(*cols, F.array_contains("flags", "partial").alias("partial")).drop("flags").sortWithinPartitions("uuid", "run_id", "abs_start", "timestamp")
    return sorted_.mapInArrow(decode, ddl)


def derived(segments: DataFrame) -> DataFrame:
    """Duration, covered share, and whether the label is the mean distribution's largest class."""
    d = F.col("t_end") - F.col("t_start")
    best = F.element_at(F.array(*[F.lit(c) for c in K.CLASSES]), F.array_position("mean_probs", F.array_max("mean_probs")).cast("int"))
    return segments.withColumn("duration_s", d).withColumn("coverage_fraction", F.when(d > 0, F.col("coverage_s") / d).otherwise(0.0)).withColumn("decode_matches_mean_argmax", best == F.col("label"))


def viterbi(rows: DataFrame, keys: list[str], order: str, probs: str, matrix: np.ndarray, k: int = 1) -> DataFrame:
    """Most likely state index of each row, per key."""
    logs = np.log(np.maximum(matrix, 1e-12))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        path = N.viterbi_min_run(np.log(np.maximum(np.stack([np.asarray(x, float) for x in pdf[probs]]), 1e-12)), logs, k)
        return pdf[[*keys, order]].assign(state=path.astype("int32"))

    ddl = ", ".join([*(f"`{c}` {types[c]}" for c in (*keys, order)), "state int"])
    return rows.select(*keys, order, probs).groupBy(*keys).applyInPandas(decode, ddl)


def default_model(spark) -> DataFrame:
    """The prior as a transition model."""
    return metrics.prior_transitions(spark).withColumn("source", F.lit("prior"))
