"""Signatures, events, energy and exemplar retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetra import constants as K
from kinetra.functions import columns as C


SLICE_DDL = "segment_id string, n long, n_tilt long, tilt double, tilt_m2 double, n_sma long, motion double, has_gyro boolean, cadence double, why string, " + ", ".join(f"n_{a} long, sq_{a} double" for a in "xyz")


def signal_slices(segments: DataFrame, bursts: DataFrame) -> DataFrame:
    """A1-A5: one row of sums for each segment and burst that meet, over the samples in the closed time range.

    Only ids and times are matched (by minute bins); each burst then carries the list of its segments, so its
    samples are moved once, whatever the number of segments.
    """
    from kinetra.functions import kernels as N
    from kinetra.operators.intervals import overlap_pairs
    from kinetra.plans.recognition import arrow_batch, arrow_schema, decoded

    near = 1.0 / K.TARGET_HZ  # a segment that only touches the first or last sample still meets the burst
    held = bursts.where(F.col("acc").isNotNull() & (F.size("acc") > 0))
    spans = held.select("uuid", "timestamp", (F.col("timestamp") + F.array_min("acc.t") - near).alias("r_start"), (F.col("timestamp") + F.array_max("acc.t") + near).alias("r_end"))
    s = segments.select("uuid", F.col("segment_id").cast("string").alias("segment_id"), (F.col("t_start") - near).alias("l_start"), (F.col("t_end") + near).alias("l_end"))
    pairs = overlap_pairs(s, spans, ["uuid"], 60.0)
    asked = pairs.groupBy("uuid", "timestamp").agg(F.collect_list(F.struct("segment_id", (F.col("l_start") + near).alias("lo"), (F.col("l_end") - near).alias("hi"))).alias("asked"))
    rows = held.join(asked, ["uuid", "timestamp"]).select("uuid", "timestamp", "acc", "gyro", "asked")
    schema = arrow_schema(SLICE_DDL)

    def run(batches):
        for batch in batches:
            asks = batch.column(4).to_pylist()
            out = [{"segment_id": x["segment_id"], **N.slice_sums(sig, x["lo"] - ts, x["hi"] - ts)} for (_, ts, sig), ask in zip(decoded(batch), asks) for x in ask]
            yield arrow_batch(out, schema)

    return rows.mapInArrow(run, SLICE_DDL)


def peak_cadence(segments: DataFrame, windows: DataFrame) -> DataFrame:
    """Mean peak-counted cadence per minute of the windows that a segment overlaps; windows that are too quiet
    or have too little data do not count."""
    from kinetra.operators.intervals import overlap_pairs

    w = windows.select("uuid", (F.col("timestamp") + F.col("t_start_s")).alias("r_start"), (F.col("timestamp") + F.col("t_end_s")).alias("r_end"), "cadence_hz", F.col("flags").alias("w_flags"))
    s = segments.select("uuid", F.col("segment_id").cast("string").alias("segment_id"), F.col("t_start").alias("l_start"), F.col("t_end").alias("l_end"))
    left_out = F.arrays_overlap(F.coalesce("w_flags", F.array().cast("array<string>")), F.array(F.lit("insufficient_data"), F.lit("too_quiet_for_cadence")))
    usable = ~left_out & C.finite(F.col("cadence_hz")) & (F.col("cadence_hz") > 0)
    return overlap_pairs(s, w, ["uuid"], 60.0).groupBy("segment_id").agg((F.avg(F.when(usable, F.col("cadence_hz"))) * 60).alias("cadence_bpm_peaks"), F.count(F.lit(1)).alias("n_windows"))


def merge_slices(slices: DataFrame) -> DataFrame:
    """Sums of ``signal_slices`` joined to features of the whole segment; the cadence is that of its longest
    slice, the faster one on ties."""
    mean = F.try_divide(F.sum(F.col("n_tilt") * F.col("tilt")), F.sum("n_tilt"))
    spread = F.sum("tilt_m2") + F.sum(F.col("n_tilt") * F.col("tilt") * F.col("tilt")) - F.sum("n_tilt") * mean * mean
    longest = F.max(F.struct("n", "cadence", "why"))
    enough = F.sum("n_tilt") >= 2
    return slices.groupBy("segment_id").agg(
        F.sum("n").alias("n_samples"),
        F.when(enough, mean).alias("tilt_deg_mean"),
        F.when(enough, F.sqrt(F.try_divide(F.greatest(spread, F.lit(0.0)), F.sum("n_tilt") - 1))).alias("tilt_deg_std"),
        F.try_divide(F.sum("motion"), F.sum("n_sma")).alias("sma"),
        longest["cadence"].alias("cadence_bpm"),
        longest["why"].alias("why"),
        F.max("has_gyro").alias("has_gyro"),
        *[F.sqrt(F.try_divide(F.sum(f"sq_{a}"), F.sum(f"n_{a}"))).alias(f"gyro_rms_{a}") for a in "xyz"],
    )


def signatures(segments: DataFrame, bursts: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """Label-free features of each segment, one row per segment.

    Tilt, motion, rotation and the autocorrelation cadence come from all samples in the segment's closed time
    range, whatever bursts they lie in; the peak cadence from its windows.  Unmeasured features are null, and
    ``flags`` says why.
    """
    own = segments.select(F.col("segment_id").cast("string").alias("segment_id"), "uuid", "t_start", "t_end", (F.col("t_end") - F.col("t_start")).alias("duration_s"))
    out = own.join(merge_slices(signal_slices(segments, bursts)), "segment_id", "left")
    if windows is None:
        out = out.withColumn("cadence_bpm_peaks", F.lit(None).cast("double")).withColumn("n_windows", F.lit(0).cast("long"))
    else:
        out = out.join(peak_cadence(segments, windows), "segment_id", "left").withColumn("n_windows", F.coalesce("n_windows", F.lit(0)))
    none, empty = F.col("n_samples").isNull(), F.col("n_samples") == 0
    named = C.flags(
        (none, "no_signal"),
        (empty, "empty_slice"),
        (F.col("tilt_deg_mean").isNull() & ~none, "tilt_unavailable"),
        (~F.col("has_gyro"), "no_gyro"),
        (F.col("cadence_bpm_peaks").isNull() & ~none, "no_peak_cadence"),
        (cadence_disagrees(F.col("cadence_bpm"), F.col("cadence_bpm_peaks")), "cadence_disagreement"),
        *[(F.col("why") == w, w) for w in ("autocorr_insufficient", "too_quiet_for_cadence", "cadence_not_found")],
    )
    return out.withColumn("flags", named).drop("why")


def cadence_disagrees(a: Column, b: Column) -> Column:
    """Both measured and more than 5 per minute apart."""
    return F.coalesce(C.finite(a) & C.finite(b) & (F.abs(a - b) > K.CADENCE_TOLERANCE_BPM), F.lit(False))


def jerk_energy(sma: Column, gx: Column, gy: Column, gz: Column) -> Column:
    """Motion times the norm of the measured rotation axes; motion alone without any; null without motion."""
    parts = [F.when(C.finite(g), g * g) for g in (gx, gy, gz)]
    spin = F.coalesce(parts[0], F.lit(0.0)) + F.coalesce(parts[1], F.lit(0.0)) + F.coalesce(parts[2], F.lit(0.0))
    return F.when(C.finite(sma), F.when(F.coalesce(*parts).isNull(), sma).otherwise(sma * F.sqrt(spin)))


def event_flags(sig: DataFrame) -> DataFrame:
    """``(segment_id, flags)``: what kept the rule from judging a segment.  Tilt and length are looked at only
    where the jerk energy passes its cut, and length only where tilt and its deviation are measured."""
    jerk = jerk_energy(F.col("sma"), F.col("gyro_rms_x"), F.col("gyro_rms_y"), F.col("gyro_rms_z"))
    missing, over = ~F.coalesce(C.finite(jerk), F.lit(False)), jerk > K.JERK_CUT
    tilt, std = F.coalesce(C.finite(F.col("tilt_deg_mean")), F.lit(False)), F.coalesce(C.finite(F.col("tilt_deg_std")), F.lit(False))
    named = C.flags((missing, "jerk_energy_missing"), (over & ~tilt, "tilt_missing"), (over & tilt & ~std, "tilt_std_missing"), (over & tilt & std & (F.col("duration_s") < K.EVENT_MIN_S), "short_segment"))
    return sig.select("segment_id", named.alias("flags"))


def physics_events(sig: DataFrame) -> DataFrame:
    """Impact followed by lying still: jerk energy above 2, tilt of 70 and more, its deviation 15 at most,
    2 s at least."""
    jerk = jerk_energy(F.col("sma"), F.col("gyro_rms_x"), F.col("gyro_rms_y"), F.col("gyro_rms_z"))
    j = sig.withColumn("trigger_jerk_energy", jerk)
    hit = j.where((F.col("trigger_jerk_energy") > K.JERK_CUT) & (F.col("tilt_deg_mean") >= K.TILT_CUT) & (F.col("tilt_deg_std") <= K.TILT_STD_CUT) & (F.col("duration_s") >= K.EVENT_MIN_S))
    score = (F.col("trigger_jerk_energy") - K.JERK_CUT) / K.JERK_CUT + (F.col("tilt_deg_mean") - K.TILT_CUT) / (180.0 - K.TILT_CUT)
    return hit.select("segment_id", "t_start", "t_end", F.lit("physics_rule").alias("method"), score.alias("score"), "trigger_jerk_energy", F.col("tilt_deg_mean").alias("trigger_tilt_deg_mean"), F.col("tilt_deg_std").alias("trigger_tilt_deg_std"), F.array().cast("array<string>").alias("flags"))


FOREST_FEATURES = ["jerk_energy", "sma", "tilt_deg_mean", "tilt_deg_std", "cadence_bpm", "gyro_rms_x", "gyro_rms_y", "gyro_rms_z"]


def forest_events(sig: DataFrame, contamination: float = 0.05, borderline: float = 0.05, trees: int = 100, size: int = 256, seed: int = 42) -> DataFrame:
    """Isolation forest over the eight signature features.

    Unmeasured features take the median of all rows.  The trees are grown on the driver from a bounded draw,
    the ``trees * size`` rows of smallest hash among those that the rule does not flag, which reruns repeat;
    every row is scored, and the cut is the ``1 - contamination`` quantile of all scores.
    """
    import numpy as np

    from kinetra.functions.kernels import isolation_forest

    names = FOREST_FEATURES
    told = sig.withColumn("jerk_energy", jerk_energy(F.col("sma"), F.col("gyro_rms_x"), F.col("gyro_rms_y"), F.col("gyro_rms_z")))
    told = told.select("segment_id", "t_start", "t_end", *(F.when(C.finite(F.col(n).cast("double")), F.col(n).cast("double")).alias(n) for n in names))
    medians = told.agg(*(F.percentile_approx(n, 0.5, 10_000).alias(n) for n in names)).first()
    filled = told.select("segment_id", "t_start", "t_end", *(F.coalesce(n, F.lit(medians[n]), F.lit(0.0)).alias(n) for n in names))
    calm = filled.join(physics_events(sig).select("segment_id"), "segment_id", "left_anti")
    draw = calm.orderBy(F.xxhash64("segment_id", F.lit(seed)), "segment_id").limit(trees * size)
    train = draw.select(*names).toPandas().to_numpy(dtype=float)
    score = isolation_forest(train, trees, size, seed) if len(train) else None

    def run(batches):
        for pdf in batches:
            s = score(pdf[names].to_numpy(dtype=float)) if score and len(pdf) else np.zeros(len(pdf))
            yield pdf[["segment_id", "t_start", "t_end"]].assign(score=s)

    scored = filled.withColumn("segment_id", F.col("segment_id").cast("string")).mapInPandas(run, "segment_id string, t_start double, t_end double, score double")
    cut = scored.agg(F.percentile_approx("score", 1 - contamination, 10_000)).first()[0] if score else 1.0
    over = F.col("score") - F.lit(cut)
    return scored.where(over >= 0).select("segment_id", "t_start", "t_end", F.lit("isolation_forest").alias("method"), over.alias("score"), (F.abs(over) < borderline).alias("borderline")).withColumn("flags", C.flags((F.lit(True), "isolation_forest_fallback"), (F.col("borderline"), "if_borderline")))


def detect_events(sig: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Rule events first; fallback events only for segments without one; by time."""
    rule = physics_events(sig)
    if fallback is None:
        return rule.orderBy("t_start", "t_end")
    rest = fallback.join(rule.select("segment_id"), "segment_id", "left_anti")
    return rule.unionByName(rest, allowMissingColumns=True).orderBy("t_start", "t_end")


def met_table(spark: SparkSession, table: dict[str, tuple[float, float, float]] = K.MET) -> DataFrame:
    return spark.createDataFrame([(k, *map(float, v)) for k, v in table.items()], "activity string, met double, met_low double, met_high double")


def kcal(met: Column, mass: Column, seconds: Column) -> Column:
    """A10."""
    return met * mass * 3.5 / 200.0 * (seconds / 60.0)


def energy(rows: DataFrame, mets: DataFrame, mass_kg: float | None = None, seconds: str = "total_duration_s", strict: bool = False) -> DataFrame:
    """Kcal with bounds; an assumed mass is marked.  ``strict`` raises on unknown activities."""
    if mass_kg is not None and mass_kg <= 0:
        raise ValueError("mass must be positive")
    mass = F.lit(float(mass_kg or K.DEFAULT_MASS_KG))
    joined = rows.join(F.broadcast(mets), "activity", "left")  # one row per class
    if strict:
        joined = joined.withColumn("met", F.coalesce("met", F.raise_error(F.concat(F.lit("no MET for "), "activity")).cast("double")))
    s = F.col(seconds)
    return joined.where("met is not null").select(*rows.columns, kcal(F.col("met"), mass, s).alias("kcal"), kcal(F.col("met_low"), mass, s).alias("kcal_low"), kcal(F.col("met_high"), mass, s).alias("kcal_high"), F.lit(mass_kg is None).alias("weight_is_assumed"))


def flat_energy(rows: DataFrame, mass_kg: float = K.DEFAULT_MASS_KG) -> DataFrame:
    """Total kcal by the question path's own table, unknown activities at 1.5."""
    met = F.coalesce(*[F.when(F.col("label") == k, F.lit(v)) for k, v in K.FLAT_MET.items()], F.lit(K.FLAT_MET_UNKNOWN))
    return rows.agg(F.sum(kcal(met, F.lit(mass_kg), F.col("t_end") - F.col("t_start"))).alias("kcal"))


def bank_stats(bank: DataFrame, vector: str) -> DataFrame:
    """G-11: mean and population deviation (0 becomes 1) of each feature of the bank."""
    pos = bank.select(F.posexplode(vector).alias("pos", "x"))
    return pos.groupBy("pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")).withColumn("std", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")))


def nearest(queries: DataFrame, bank: DataFrame, k: int, *, query_id: str, bank_id: str, vector: str, metric: str = "cosine") -> DataFrame:
    """The ``k`` nearest exemplars of each query on z-scored features; null and NaN features take the
    bank's mean, cosine distance is 0 at least, a zero vector's norm counts as 1, ties go to the lower id.

    The bank is a curated table (a few dozen rows); it is broadcast behind a check of its size.
    """
    if bank.limit(10_001).count() > 10_000:
        raise ValueError("the exemplar bank may have 10,000 rows at most")
    stats = bank_stats(bank, vector).agg(F.sort_array(F.collect_list(F.struct("pos", "mean", "std"))).alias("st"))  # one row

    def scored(df: DataFrame, keep: str, name: str) -> DataFrame:
        filled = F.zip_with(vector, "st", lambda x, s: (F.when(x.isNull() | F.isnan(x), s["mean"]).otherwise(x) - s["mean"]) / s["std"])
        return df.crossJoin(F.broadcast(stats)).select(F.col(keep), filled.alias(name))

    q, b = scored(queries, query_id, "zq"), scored(bank.withColumnRenamed(bank_id, "__b"), "__b", "zb")
    pairs = q.crossJoin(F.broadcast(b))  # bank size checked above
    if metric == "cosine":
        nq, nb = C.norm(F.col("zq")), C.norm(F.col("zb"))
        one = lambda n: F.when(n == 0, 1.0).otherwise(n)
        d = F.greatest(F.lit(0.0), 1.0 - C.dot(F.col("zq"), F.col("zb")) / (one(nq) * one(nb)))
    elif metric == "euclidean":
        d = F.sqrt(C.total(F.zip_with("zq", "zb", lambda x, y: (x - y) * (x - y))))
    else:
        raise ValueError("metric must be cosine or euclidean")
    ranked = pairs.select(query_id, F.col("__b").alias(bank_id), F.round(d, 9).alias("distance")).withColumn("rank", F.row_number().over(W.partitionBy(query_id).orderBy("distance", bank_id)))
    return ranked.where(F.col("rank") <= k)
