"""Scans: burst files, label matrices, generic sensor text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetra import constants as K

# Header names that stand for a column, in order of preference.
COLUMN_NAMES = {
    "t": ("timestamp", "time", "t", "ts", "epoch", "datetime"),
    "x": ("acc_x", "ax", "x", "accel_x"),
    "y": ("acc_y", "ay", "y", "accel_y"),
    "z": ("acc_z", "az", "z", "accel_z"),
    "gx": ("gyro_x", "gx", "wx"),
    "gy": ("gyro_y", "gy", "wy"),
    "gz": ("gyro_z", "gz", "wz"),
}
_PATH = r"([0-9A-Fa-f-]{36})/(\d+)\.m_(raw_acc|proc_gyro)\.dat$"


def burst_rows(spark: SparkSession, root: str) -> DataFrame:
    """SC1/SC2: ``(uuid, timestamp, sensor, t, x, y, z, bad)`` of all burst files below ``root``; lines that do
    not hold four numbers are marked, blank ones skipped."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.dat").text(root).select(F.trim("value").alias("v"), F.col("_metadata.file_path").alias("p")).where("v <> ''")
    cells = F.split("v", r"\s+")
    num = [F.get(cells, i).try_cast("double") for i in range(4)]
    bad = (F.size(cells) != 4) | F.greatest(*[n.isNull().cast("int") for n in num]).cast("boolean")
    return raw.select(F.regexp_extract("p", _PATH, 1).alias("uuid"), F.regexp_extract("p", _PATH, 2).try_cast("bigint").alias("timestamp"), F.when(F.regexp_extract("p", _PATH, 3) == "raw_acc", "acc").otherwise("gyro").alias("sensor"), *[n.alias(c) for n, c in zip(num, "txyz")], bad.alias("bad"))


def bursts(spark: SparkSession, root: str) -> DataFrame:
    """SC3/J2: one row per minute with ``acc``, ``gyro`` and flags; a file with a bad line counts as corrupt."""
    rows = burst_rows(spark, root)
    packed = rows.groupBy("uuid", "timestamp").agg(*[F.sort_array(F.collect_list(F.when((F.col("sensor") == s) & ~F.col("bad"), F.struct("t", "x", "y", "z")))).alias(s) for s in ("acc", "gyro")], *[F.max(F.when(F.col("sensor") == s, F.col("bad"))).alias(f"bad_{s}") for s in ("acc", "gyro")])
    acc, gyro = F.when(~F.col("bad_acc") & (F.size("acc") > 0), F.col("acc")), F.when(~F.col("bad_gyro") & (F.size("gyro") > 0), F.col("gyro"))
    out = packed.select("uuid", "timestamp", acc.alias("acc"), gyro.alias("gyro"), "bad_acc", "bad_gyro")
    span = lambda c: F.element_at(c, -1)["t"] - F.element_at(c, 1)["t"]
    flags = F.array_compact(
        F.array(
            F.when(F.col("bad_acc").isNull(), F.lit("missing_burst")),
            F.when(F.col("bad_acc") | F.coalesce("bad_gyro", F.lit(False)), F.lit("corrupt_burst")),
            F.when(F.size("acc") != K.NOMINAL_SAMPLES, F.lit("short_burst")),
            F.when(F.col("gyro").isNull(), F.lit("missing_gyro")),
            F.when(F.abs(span("acc") - span("gyro")) > K.SPAN_TOLERANCE_S, F.lit("acc_gyro_span_mismatch")),
        )
    )
    return out.withColumn("flags", flags).drop("bad_acc", "bad_gyro")


def burst_listing(spark: SparkSession, root: str) -> DataFrame:
    """SC2/SC6: ``(uuid, timestamp)`` of the bursts there are, from names alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.m_raw_acc.dat").load(root).select("path")
    return files.select(F.regexp_extract("path", _PATH, 1).alias("uuid"), F.regexp_extract("path", _PATH, 2).try_cast("bigint").alias("timestamp")).distinct()


def label_rows(spark: SparkSession, path: str) -> DataFrame:
    """SC4/SC5/SC6: label matrices (gzip or plain), cells as trimmed text, user id from the file name; of a
    user's two files the compressed one is read."""
    df = spark.read.option("header", "true").option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true").csv(path)
    named = df.toDF(*[c.strip() for c in df.columns])
    file = F.col("_metadata.file_path")
    with_file = df.select("*", file.alias("__f")).toDF(*named.columns, "__f")
    user = F.regexp_extract("__f", r"([^/]+?)\.[^/]*labels?[^/]*\.csv(\.gz)?$", 1)
    tagged = with_file.withColumn("uuid", user).withColumn("__gz", F.col("__f").endswith(".gz"))
    zipped = tagged.where("__gz").select("uuid").distinct()
    plain = tagged.where("not __gz").join(zipped, "uuid", "left_anti")
    return tagged.where("__gz").unionByName(plain).drop("__f", "__gz")


def timestamp_seconds(c: Column) -> Column:
    """SC11: seconds as numbers, else ISO forms, all in UTC."""
    forms = ("yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss")
    v = F.trim(c.cast("string"))
    return F.coalesce(v.try_cast("double"), *[F.try_to_timestamp(v, F.lit(f)).cast("double") for f in forms])


def sensor_table(spark: SparkSession, path: str) -> DataFrame:
    """SC7-SC10: ``(t, x, y, z, gx, gy, gz)`` from comma or white-space text with or without header.

    The first line decides on delimiter and header; names are matched without regard to case; rows whose
    time or acceleration do not parse are dropped; rotation is kept where all three axes are finite.
    """
    lines = spark.read.text(path).where("trim(value) <> '' and not value like '#%'")
    first = lines.first()
    if first is None:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.DoubleType()) for c in COLUMN_NAMES]))
    sep = "," if "," in first["value"] else r"\s+"
    head = [h.strip() for h in re.split(sep, first["value"].strip())]
    numeric = all(re.fullmatch(r"[-+0-9.eE]+", h) or h.lower() == "nan" for h in head)
    if numeric:
        at = {c: i for i, c in enumerate(list(COLUMN_NAMES)[: len(head)])}
    else:
        low = [h.lower() for h in head]
        at = {c: next((low.index(n) for n in names if n in low), None) for c, names in COLUMN_NAMES.items()}
    cells = F.split(F.trim("value"), sep)
    pick = {c: F.get(cells, at[c]) if at.get(c) is not None else F.lit(None).cast("string") for c in COLUMN_NAMES}
    out = lines.select(timestamp_seconds(pick["t"]).alias("t"), *[F.trim(pick[c]).try_cast("double").alias(c) for c in list(COLUMN_NAMES)[1:]]).dropna(subset=["t", "x", "y", "z"])
    whole = ~F.isnan(F.col("gx") + F.col("gy") + F.col("gz"))
    return out.select("t", "x", "y", "z", *[F.when(whole, F.col(g)).alias(g) for g in ("gx", "gy", "gz")])


def chunks_to_bursts(rows: DataFrame, keys: list[str], width: float = 60.0, least: int = 10) -> DataFrame:
    """W2/W3/SC12/SC13: sensor rows of a recording as bursts of ``width`` seconds from the first sample of each."""
    from kinetra.operators.windows import anchored_chunks

    packed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t", "x", "y", "z", "gx", "gy", "gz"))).alias("s"))
    cut = packed.withColumn("c", F.explode(anchored_chunks(F.transform("s", lambda v: v["t"]), width, least))).where("c.kept")
    part = F.slice("s", F.col("c.start_index") + 1, F.col("c.stop_index") - F.col("c.start_index"))
    spin = F.filter(part, lambda v: v["gx"].isNotNull())
    acc = F.transform(part, lambda v: F.struct(v["t"].alias("t"), v["x"].alias("x"), v["y"].alias("y"), v["z"].alias("z")))
    gyro = F.when(F.size(spin) >= 2, F.transform(spin, lambda v: F.struct(v["t"].alias("t"), v["gx"].alias("x"), v["gy"].alias("y"), v["gz"].alias("z"))))
    return cut.select(*keys, F.element_at(part, 1)["t"].cast("long").alias("timestamp"), acc.alias("acc"), gyro.alias("gyro"))


def feature_matrix(df: DataFrame) -> DataFrame:
    """SC17: every column that is no label, as float."""
    return df.select(*[F.col(f"`{c}`").cast("float").alias(c) for c in df.columns if not c.startswith("label") and c not in ("uuid", "timestamp")])


def precomputed_features(df: DataFrame, bands: tuple[str, ...] = ("band0", "band1", "band2", "band3", "band4")) -> DataFrame:
    """SC15: features from a table of per-minute statistics: motion by magnitude deviation, frequency by the
    strongest of five bands, tilt from the mean vector, vertical spread by the largest axis, cadence by period."""
    centres = F.array(*[F.lit(c) for c in (0.5, 1.5, 3.0, 6.0, 12.0)])
    power = F.array(*[F.col(b).cast("double") for b in bands])
    size = F.sqrt(F.col("mean_x") ** 2 + F.col("mean_y") ** 2 + F.col("mean_z") ** 2)
    tilt = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.try_divide("mean_z", size)))))
    return df.select("*", F.col("mag_std").alias("sma"), F.element_at(centres, F.array_position(power, F.array_max(power)).cast("int")).alias("dominant_freq_hz"), tilt.alias("tilt_deg"), F.greatest("std_x", "std_y", "std_z").alias("vertical_std"), F.when(F.col("period_s") > 0, 60.0 / F.col("period_s")).otherwise(0.0).alias("cadence_bpm"))


def prefer_bursts(features: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """SC16: features from bursts, else from the table."""
    cols = [c for c in fallback.columns if c not in keys]
    j = fallback.select(*keys, F.struct(*cols).alias("b")).join(features.select(*keys, F.struct(*cols).alias("a")), keys, "left")
    return j.select(*keys, F.coalesce("a", "b").alias("f")).select(*keys, "f.*")
