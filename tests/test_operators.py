"""Operators that need fixtures of their own."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetra import constants as K
from kinetra.functions import columns as C
from kinetra.functions import kernels as N
from kinetra.operators import analytics, answers, decode, intervals, labels, metrics, ml, rollup, router, store, windows
from kinetra.plans import recognition
from kinetra.sources import files, sinks
from kinetra.streaming import extension

BASE = 1699920000
QUESTIONS = [
    ("How many calories did she burn?", "b_energy"),
    ("What is the MET value?", "b_energy"),
    ("Did she fall today?", "b_anomaly"),
    ("Was there any unsteady movement?", "b_anomaly"),
    ("Update my weight to 70", "personalization"),
    ("How long did she walk?", "task2"),
    ("How many days of data are there?", "task2"),
    ("What was she doing at noon?", "task1"),
    ("When did she start walking?", "task3"),
    ("Why was she restless?", "task4"),
    ("Is this pattern typical?", "task4"),
    ("Zebra", "unknown"),
]


def rollup_of(spark, rows):
    df = spark.createDataFrame([("u", BASE + m * 60, lab, float(BASE + m * 60)) for m, lab in rows], "uuid string, timestamp long, label string, t_start double")
    return {(r["activity"]): r for r in rollup.daily_rollup(df).collect()}


def test_bouts_and_minutes(spark):
    r = rollup_of(spark, [(0, "walking"), (1, "walking"), (3, "walking"), (6, "walking"), (6, "walking"), (7, None), (7, ""), (1, "sitting")])
    assert r["walking"]["total_duration_s"] == 240 and r["walking"]["bout_count"] == 2 and r["walking"]["avg_bout_s"] == 120
    assert set(r) == {"walking", "sitting"} and r["sitting"]["labeled_minutes"] == 1


def test_rolling_windows(spark):
    d = spark.sql("select date_add(date'2023-01-01', int(id * 2)) as date, 'a' as activity, 600.0D as total_duration_s from range(5)")
    out = {str(r["date"]): r for r in rollup.rolling(d, "7d").collect()}
    assert len(out) == 9 and out["2023-01-09"]["n_days_with_data"] == 4 and out["2023-01-02"]["rolling_mean_duration_s"] == 300
    with pytest.raises(ValueError):
        rollup.rolling(d, "decade")


def test_label_resolution(spark):
    cols = list(K.LABEL_COLUMNS)
    cases = [("1", "0", "0", "0", "0", "0"), ("0", "1", "0", "1", "0", "0"), ("", "nan", "x", "", "", ""), ("0", "0", "0", "0", "0", "0"), ("0", "0", " 1 ", "0", "", "0")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, " + ", ".join(f"`{c}` string" for c in cols))
    r = {x["i"]: x for x in labels.resolve(df).collect()}
    assert (r[0]["label"], r[1]["label"], r[2]["label"], r[4]["label"]) == ("lying down", None, None, "standing in place")
    assert r[1]["flags"] == ["multi_label"] and r[2]["flags"] == ["unresolved_missing_label"] and not r[3]["in_subset"]
    assert r[4]["flags"] == ["standing_split_unresolved"]
    assert {x["i"] for x in labels.resolve(df, standing="drop").collect()} == {0, 1, 2, 3}
    assert labels.resolve(df, standing="unlabeled").where("i = 4").first()["label"] is None
    with pytest.raises(ValueError):
        labels.resolve(df, standing="maybe")


def test_routes(spark):
    df = spark.createDataFrame(QUESTIONS, "q string, want string")
    got = df.select("want", router.route_columns(F.col("q"))["route"].alias("r")).collect()
    assert all(r["want"] == r["r"] for r in got), got
    assert all(router.route(q).route == w for q, w in QUESTIONS)
    assert router.route("Zebra", lambda p: "I say task3").route == "task3"
    assert router.route("Zebra", lambda p: 1 / 0).route == "unknown"
    assert router.route("Zebra", extra=[("zebra", "task1", 0.9)]).route == "task1"


def timeline(spark):
    rows = [("s1", "u", "walking", 0.0, 100.0, 0.9), ("s2", "u", "sitting", 100.0, 900.0, 0.8), ("s3", "u", "walking", 900.0, 960.0, 0.7)]
    return spark.createDataFrame(rows, "segment_id string, uuid string, label string, t_start double, t_end double, confidence double")


def test_answers(spark):
    t = timeline(spark)
    a = answers.answer("What was she doing? Was she walking", t)
    assert a.answer.startswith("Yes — walking") and a.segment_id == "s1"
    assert answers.look_up(t, "running?").answer.startswith("No — running")
    assert "sitting" in answers.answer("What is the average?", t).answer
    assert answers.onset(t, "prolonged sitting").answer.startswith("Likely yes")
    assert answers.answer("How many calories?", t).answer.startswith("About")
    events = spark.createDataFrame([("e1", "s2", 120.0, 130.0, "physics_rule", 0.4)], "event_id string, segment_id string, t_start double, t_end double, method string, score double")
    assert "physics_rule" in answers.answer("Did she fall?", t, events).answer
    none = t.limit(0)
    assert answers.look_up(none, "hello").answer == "No data available."
    text = answers.render(answers.answer("What was she doing", t))
    assert "UTC" in text and "confidence" in text


def test_coverage_gate_widens_or_refuses(spark):
    t = timeline(spark)
    told = answers.Answer("task3", "x", 0.9, "sitting", 300.0, 310.0, "s2")
    far = spark.createDataFrame([("u", 350.0, True), ("u", 306.0, False)], "uuid string, t double, ok boolean")
    out = answers.gate(told, t, far)
    assert out.widened and out.t_start <= 350.0 < out.t_end
    told = answers.Answer("task3", "x", 0.9, "sitting", 300.0, 310.0, "s2")
    assert answers.gate(told, t, far.where("t < 0")).answer.startswith("Not answerable")


def test_store(spark, tmp_path):
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    new = spark.createDataFrame([("b", 3.0, 1), ("b", 4.0, 2), ("c", 5.0, 1)], "k string, v double, seq int")
    out = store.upsert(old.withColumn("seq", F.lit(0)), new, "k", "seq")
    assert {r["k"]: r["v"] for r in out.collect()} == {"a": 1.0, "b": 4.0, "c": 5.0}
    for some in (new, new.orderBy("v"), new.repartition(3)):  # without an order the row is still not a random one
        assert {r["k"]: r["v"] for r in store.upsert(old, some.select("k", "v"), "k").collect()} == {"a": 1.0, "b": 4.0, "c": 5.0}
    path = f"file://{tmp_path}/t"
    sinks.replace(old, path)
    sinks.replace(store.upsert(spark.read.parquet(path), new.select("k", "v").where("v = 5"), "k"), path)
    assert spark.read.parquet(path).count() == 3
    events = spark.createDataFrame([("s9", "m", 1.0, float("nan"))], "segment_id string, method string, t_start double, score double")
    rows = store.anomaly_rows(events).first()
    assert rows["event_id"] == "s9:m" and rows["score"] is None
    assert math.isnan(store.anomalies_of(store.anomaly_rows(events), "s9").first()["score"])
    with pytest.raises(ValueError):
        store.upsert_anomalies(store.anomaly_rows(events).limit(0), events, timeline(spark))
    assert sinks.empty(spark, sinks.TIMELINE_DDL).count() == 0 and sinks.empty(spark, sinks.EVENTS_DDL).count() == 0
    line = timeline(spark).select(sinks.aligned((F.col("label"), 10), (F.col("segment_id"), 4)).alias("x"), sinks.progress_bar(F.lit(0.5), 4).alias("b")).first()
    assert line["x"] == "walking   s1  " and line["b"] == "[##..]"


def test_sources(spark, tmp_path):
    u = "12345678-1234-1234-1234-123456789abc"
    for kind, n in (("raw_acc", 800), ("proc_gyro", 790)):
        d = tmp_path / kind / u
        d.mkdir(parents=True)
        (d / f"1700000000.m_{kind}.dat").write_text("".join(f"{i / 40:.18e} 0.0 0.0 -1.0\n" for i in range(n)))
    (tmp_path / "raw_acc" / u / "1700000060.m_raw_acc.dat").write_text("1 2 3\n")
    got = {r["timestamp"]: r for r in files.bursts(spark, f"file://{tmp_path}").collect()}
    assert len(got[1700000000]["acc"]) == 800 and got[1700000000]["flags"] == []
    assert got[1700000060]["acc"] is None and "corrupt_burst" in got[1700000060]["flags"]
    assert files.burst_listing(spark, f"file://{tmp_path}").count() == 2
    (tmp_path / "a.csv").write_text("Timestamp,X,Y,Z,gyro_x,gyro_y,gyro_z\n1.0,1,2,3,1,1,1\n2.0,1,x,3,1,1,1\n2023-11-14 00:00:01,1,2,3,nan,1,1\n")
    t = files.sensor_table(spark, f"file://{tmp_path}/a.csv").orderBy("t").collect()
    assert [r["t"] for r in t] == [1.0, BASE + 1.0] and t[0]["gx"] == 1.0 and t[1]["gx"] is None
    (tmp_path / "b.dat").write_text("# comment\n0.0 1 2 3\n0.1 1 2 3\n")
    assert files.sensor_table(spark, f"file://{tmp_path}/b.dat").count() == 2
    (tmp_path / "abc.features_labels.csv").write_text("timestamp , label:SITTING\n 5 , 1 \n")
    r = files.label_rows(spark, f"file://{tmp_path}/abc*.csv").where("uuid = 'abc'").first()
    assert r["uuid"] == "abc" and r["label:SITTING"] == "1"


def test_bursts_to_timeline(spark):
    t = [i / 40 for i in range(2400)]
    rows = [("u", x, 0.5 + (0.18 if x < 30 else 0.0) * math.sin(4 * math.pi * x), 0.0, -0.87 - (0.3 if x < 30 else 0.0) * math.sin(4 * math.pi * x)) for x in t]
    df = spark.createDataFrame(rows, "uuid string, t double, x double, y double, z double").select("*", *[F.lit(None).cast("double").alias(g) for g in ("gx", "gy", "gz")])
    out = recognition.timeline(files.chunks_to_bursts(df, ["uuid"])).orderBy("t_start").collect()
    assert [r["label"] for r in out] == ["walking", "sitting"] or [r["label"] for r in out][0] in ("walking", "standing and moving")
    assert all(a["t_end"] == b["t_start"] for a, b in zip(out, out[1:])) and len(out) >= 2
    assert abs(out[0]["t_end"] - 30) < 4
    assert all(abs(sum(r["mean_probs"]) - 1) < 1e-9 and r["coverage_s"] <= r["t_end"] - r["t_start"] for r in out)
    bursts = files.chunks_to_bursts(df, ["uuid"])
    sig = {r["segment_id"]: r for r in analytics.signatures(spark.createDataFrame(out), bursts, recognition.windows(bursts)).collect()}
    assert len(sig) == len(out) and all(r["sma"] is not None for r in sig.values())
    first, last = sig[out[0]["segment_id"]], sig[out[-1]["segment_id"]]
    assert first["cadence_bpm"] == 60  # the shortest whole number of samples that holds whole periods (0.25 s) is 25
    assert last["cadence_bpm"] == 0 and "too_quiet_for_cadence" in last["flags"]
    assert intervals.no_overlap(spark.createDataFrame(out), ["uuid"], "t_start", "t_end").count() == 0
    assert decode.derived(spark.createDataFrame(out)).where("coverage_fraction > 1.0000001").count() == 0
    assert recognition.samples(files.chunks_to_bursts(df, ["uuid"])).where("ok").count() > 1000


def test_transition_model(spark):
    p = metrics.prior_transitions(spark)
    assert p.count() == 49 and all(abs(r["s"] - 1) < 1e-12 for r in p.groupBy("from").agg(F.sum("p").alias("s")).collect())
    m, sources = decode.transition_arrays(decode.default_model(spark))
    assert np.allclose(m.sum(axis=1), 1) and set(sources) == {"prior"}


def test_energy(spark):
    rows = spark.createDataFrame([("walking", 3600.0), ("napping", 60.0)], "activity string, total_duration_s double")
    mets = analytics.met_table(spark)
    r = analytics.energy(rows, mets).collect()
    assert len(r) == 1 and r[0]["kcal"] == pytest.approx(3.5 * 62 * 3.5 / 200 * 60) and r[0]["weight_is_assumed"]
    with pytest.raises(Exception, match="no MET"):
        analytics.energy(rows, mets, 70.0, strict=True).collect()
    with pytest.raises(ValueError):
        analytics.energy(rows, mets, -1.0)


def test_event_detection_order(spark):
    sig = spark.createDataFrame([("a", 5.0, 10.0, 3.0, 1.0, None, None, 80.0, 5.0, 5.0), ("b", 1.0, 3.0, 0.1, 1.0, 1.0, 1.0, 80.0, 5.0, 2.0)], "segment_id string, t_start double, t_end double, sma double, gyro_rms_x double, gyro_rms_y double, gyro_rms_z double, tilt_deg_mean double, tilt_deg_std double, duration_s double")
    fallback = spark.createDataFrame([("a", 5.0, 10.0, "f", 0.1), ("b", 1.0, 3.0, "f", 0.2)], "segment_id string, t_start double, t_end double, method string, score double")
    out = analytics.detect_events(sig, fallback).collect()
    assert [(r["segment_id"], r["method"]) for r in out] == [("b", "f"), ("a", "physics_rule")]


def test_threshold_fit_improves(spark):
    rows = spark.createDataFrame([(0.02, "sitting"), (0.05, "sitting"), (0.08, "standing and moving"), (0.3, "standing and moving")] * 5, "sma double, y string")
    f = {c: F.lit(0.0) for c in ("vertical_std", "jerk_mean", "gyro_rms", "periodicity", "dominant_freq_hz", "cadence_bpm")} | {"sma": F.col("sma"), "tilt_deg": F.lit(45.0), "has_gyro": F.lit(False), "phone_placement": F.lit("pocket")}
    best, value = metrics.fit_thresholds(rows, f, "y", {"static_sma": [0.01, 0.06, 0.1]}, passes=2)
    assert best["static_sma"] == 0.06 or value > 0.7


def test_learned_scorers(spark):
    rng = np.random.default_rng(0)
    data = [(float(a), float(b), float(c), float(d), float(e), "bicycling" if a > 0 else "walking") for a, b, c, d, e in rng.normal(size=(120, 5))]
    df = spark.createDataFrame(data, ", ".join(f"{c} double" for c in ml.LOCO_FEATURES) + ", label string")
    model = ml.fit_loco(df)
    assert ml.predict_loco(model, df).where("loco = label").count() >= 110
    assert ml.fit_loco(df.limit(5)) is None
    base = ml.fit_baseline(df, ml.LOCO_FEATURES, "label")
    p = ml.probabilities(base, df).select("probs").first()["probs"]
    assert len(p) == 7 and sum(p) == pytest.approx(1)
    net = ml.fit_perceptron(df, ml.LOCO_FEATURES, "label", (4,))
    assert ml.probabilities(net, df).count() == 120


def test_distribution_columns(spark):
    r = spark.range(1).select(C.softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("s"), C.calibrate(F.array(F.lit(0.2), F.lit(0.8)), 2.0).alias("c"), C.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))).alias("a")).first()
    assert r["s"] == [0.5, 0.5] and r["a"] == 1 and sum(map(math.exp, r["c"])) == pytest.approx(1)
    with pytest.raises(ValueError):
        C.softmax(F.array(F.lit(1.0)), 0)


def test_chunks_keep_their_anchor(spark):
    t = [0.0, 1.0, 59.0, 61.0, 200.0, 201.0]
    r = spark.range(1).select(windows.anchored_chunks(F.array(*[F.lit(x) for x in t]), 60.0, 2).alias("c")).first()["c"]
    assert [(x["start_index"], x["stop_index"], x["kept"]) for x in r] == [(0, 3, True), (3, 4, False), (4, 6, True)]


def test_streaming_equals_batch(spark, small):
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(small).withColumn("ts", F.col("ts").cast("timestamp"))
    q = extension.sliding(stream, ["event_type"], "ts", "value", "2 hours", "1 hour", "1 hour").writeStream.outputMode("complete").format("memory").queryName("w1").start()
    try:
        q.processAllAvailable()
        batch = windows.sliding_time(spark.read.parquet(f"{small}/events.parquet"), ["event_type"], "ts", "value", "2 hours", "1 hour")
        assert spark.table("w1").count() == batch.count()
    finally:
        q.stop()


def test_coverage_of_rows_with_nulls(spark):
    q = spark.createDataFrame([("u", None, 0.0, 10.0), ("u", "x", 5.0, 15.0), (None, "x", 0.0, 10.0)], "uuid string, note string, q0 double, q1 double")
    s = spark.createDataFrame([("u", float(t), t < 8) for t in range(20)], "uuid string, t double, ok boolean")
    got = {(r["uuid"], r["note"]): r["coverage"] for r in intervals.coverage(q, s, ["uuid"]).collect()}
    assert got == {("u", None): 0.8, ("u", "x"): 0.3, (None, "x"): 0.0}


def test_forest_learns_from_all_calm_rows(spark):
    rows = [(f"s{i}", float(i), i + 5.0, 5.0, 0.1 + 0.001 * (i % 7), 10.0 + i % 5, 1.0, 100.0, 0.1, 0.1, None if i % 9 else 0.1) for i in range(300)]
    rows += [(f"odd{i}", 900.0 + i, 905.0 + i, 5.0, 9.0, 170.0, 60.0, 5.0, 9.0, 9.0, 9.0) for i in range(6)]
    df = spark.createDataFrame(rows, "segment_id string, t_start double, t_end double, duration_s double, sma double, tilt_deg_mean double, tilt_deg_std double, cadence_bpm double, gyro_rms_x double, gyro_rms_y double, gyro_rms_z double")
    got, again = (analytics.forest_events(x).toPandas().sort_values("segment_id") for x in (df, df.repartition(5)))
    assert {f"odd{i}" for i in range(6)} <= set(got["segment_id"]) and len(got) < 60
    assert got["segment_id"].tolist() == again["segment_id"].tolist() and (got["score"].to_numpy() == again["score"].to_numpy()).all()
    assert analytics.forest_events(df.limit(0)).count() == 0


def _bursts(spark, rows):
    cell = "array<struct<t:double,x:double,y:double,z:double>>"
    return spark.createDataFrame(rows, f"uuid string, timestamp long, acc {cell}, gyro {cell}")


def _still(seconds, x=0.0, z=-1.0):
    return [(i / 40, x, 0.0, z) for i in range(int(seconds * 40))]


def test_signatures_over_samples(spark):
    walk = [(i / 40, 0.0, 0.0, -1 - 0.3 * math.sin(2.5 * math.pi * i / 40)) for i in range(800)]  # magnitude: 0.4 s
    spin = [(i / 40, 0.03, 0.04, 0.0) for i in range(800)]
    bursts = _bursts(spark, [("u", 60, walk, spin), ("u", 120, _still(20), None), ("u", 180, _still(20, 1.0, 0.0), None), ("v", 60, None, None)])
    names = [("walk", 61.0, 79.0), ("still", 120.0, 139.0), ("both", 120.0, 200.0), ("short", 60.0, 61.0), ("gap", 90.0, 100.0), ("touch", 120.0, 120.0)]
    segments = spark.createDataFrame([(n, "u", a, b) for n, a, b in names] + [("other", "v", 60.0, 70.0)], "segment_id string, uuid string, t_start double, t_end double")
    got = {r["segment_id"]: r for r in analytics.signatures(segments, bursts).collect()}
    assert len(got) == 7 and all(r["n_windows"] == 0 and r["cadence_bpm_peaks"] is None for r in got.values())
    walk = got["walk"]
    assert walk["cadence_bpm"] == pytest.approx(150) and walk["flags"] == ["no_peak_cadence"]
    assert [walk[f"gyro_rms_{a}"] for a in "xyz"] == pytest.approx([0.03, 0.04, 0]) and walk["n_samples"] == pytest.approx(18 * K.TARGET_HZ, abs=2)
    assert got["still"]["cadence_bpm"] == 0 and got["still"]["tilt_deg_mean"] == pytest.approx(0, abs=1e-4) and "no_gyro" in got["still"]["flags"]
    both = got["both"]  # two bursts of equal length, upright and lying
    n = both["n_samples"]
    assert both["tilt_deg_mean"] == pytest.approx(45, abs=0.1) and both["tilt_deg_std"] == pytest.approx(45 * math.sqrt(n / (n - 1)), rel=1e-2)
    assert got["short"]["cadence_bpm"] is None and "autocorr_insufficient" in got["short"]["flags"]
    assert got["gap"]["flags"] == ["no_signal"] and got["other"]["flags"] == ["no_signal"]
    assert got["touch"]["n_samples"] == 1 and "tilt_unavailable" in got["touch"]["flags"]
    windows_ = recognition.windows(bursts)
    with_peaks = {r["segment_id"]: r for r in analytics.signatures(segments, bursts, windows_).collect()}
    assert with_peaks["walk"]["cadence_bpm_peaks"] == pytest.approx(75, abs=12) and with_peaks["still"]["cadence_bpm_peaks"] is None
    halved = windows_.withColumn("cadence_hz", F.col("cadence_hz") / 2)
    assert "cadence_disagreement" in analytics.signatures(segments, bursts, halved).where("segment_id = 'walk'").first()["flags"]
    assert analytics.signatures(segments.limit(0), bursts).count() == 0 and analytics.signatures(segments, bursts.limit(0)).count() == 7


def test_event_flags(spark):
    nan = float("nan")
    rows = [("ok", 5.0, 3.0, 1.0, 80.0, 5.0), ("j", 5.0, nan, 1.0, 80.0, 5.0), ("t", 5.0, 3.0, 1.0, None, 5.0), ("s", 5.0, 3.0, 1.0, 80.0, nan), ("b", 1.0, 3.0, 1.0, 80.0, 5.0), ("calm", 1.0, 0.1, 1.0, None, None)]
    df = spark.createDataFrame([(n, d, m, g, None, None, t, s) for n, d, m, g, t, s in rows], "segment_id string, duration_s double, sma double, gyro_rms_x double, gyro_rms_y double, gyro_rms_z double, tilt_deg_mean double, tilt_deg_std double")
    want = {"ok": [], "j": ["jerk_energy_missing"], "t": ["tilt_missing"], "s": ["tilt_std_missing"], "b": ["short_segment"], "calm": []}
    assert {r["segment_id"]: r["flags"] for r in analytics.event_flags(df).collect()} == want


def test_burst_tensors(spark):
    bursts = _bursts(spark, [("u", 60, _still(10), _still(10)), ("u", 120, _still(0.5), None), ("u", 180, None, None)])
    r = ml.burst_sequences(bursts, steps=300).collect()
    assert [x["timestamp"] for x in r] == [60] and len(r[0]["seq"]) == 300 and {len(x) for x in r[0]["seq"]} == {6}
    n = sum(r[0]["valid"])
    assert 245 <= n <= 251 and all(v == 0 for x in r[0]["seq"][n + 1 :] for v in x) and r[0]["seq"][10][5] == pytest.approx(-1)
    w = recognition.windows(bursts)
    v = ml.burst_vectors(w).collect()
    assert [x["timestamp"] for x in v] == [60] and v[0]["sma"] == pytest.approx(0, abs=1e-3)
    assert ml.loco_features(w).where("rot_ratio is null or dom_hz is null").count() == 0
    hot = spark.createDataFrame([("bag",), ("sky",), (None,)], "p string").select(*ml.placement_onehot(F.col("p"))).collect()
    assert [sum(x) for x in hot] == [1.0, 0.0, 0.0] and hot[0]["phone_bag"] == 1.0


def test_window_starts_and_hop(spark):
    n = spark.createDataFrame([(10,), (4,), (3,)], "n int").select(windows.sliding_index(F.col("n"), 4, 3).alias("i")).collect()
    assert [x["i"] for x in n] == [[0, 3, 6], [0], []]
    rows = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("a", 2.5), ("a", 9.0), ("b", 1.0)], "k string, s double")
    assert {r["k"]: r["hop_s"] for r in windows.hop(rows, ["k"], ["s"], "s").collect()} == {"a": 2.5, "b": 1.0}


def test_slices_of_arrays(spark):
    t, x = (F.array(*[F.lit(float(i)) for i in v]) for v in ((0, 1, 2, 3), (5, 6, 7, 8)))
    r = spark.range(1).select(store.slice_signal(t, x, F.lit(1.0), F.lit(3.0)).alias("half"), store.slice_signal(t, x, F.lit(1.0), F.lit(3.0), closed=True).alias("closed")).first()
    assert r["half"] == [6.0, 7.0] and r["closed"] == [6.0, 7.0, 8.0]


def test_nearest_covered_equals_all_probes(spark, small):
    """Against all probes of each row, in NumPy; and no broadcast, which the driver could not hold."""
    rng = np.random.default_rng(5)
    samples = [(u, float(t), bool(k)) for u in "ab" for t, k in zip(np.round(rng.uniform(0, 4000, 120), 1), rng.random(120) < 0.6)]
    samples += [("c", 60.0, True), ("c", 61.0, None), ("c", 59.5, False), (None, 60.0, True)]
    rows = []
    for i in range(150):
        a, b = np.round(rng.uniform(0, 4000), 1), rng.choice([0.0, 1.0, 4.0, 31.5, 300.0])
        lo = a - rng.choice([-20.0, 0.0, 50.0, 500.0])
        rows.append(("ab"[i % 2], f"s{i}", float(a), float(a + b), float(lo), float(lo + rng.choice([1.0, 60.0, 800.0]))))
    rows += [("c", "edge", 20.0, 22.0, 0.0, 60.0), ("c", "at", 59.0, 60.0, 0.0, 300.0), ("c", "far", 181.0, 183.0, 0.0, 300.0), ("d", "none", 0.0, 1.0, 0.0, 2.0), (None, "null", 59.0, 60.0, 0.0, 300.0)]
    want = {}
    for u, i, a, b, seg_lo, seg_hi in rows:
        mid, wide = (a + b) / 2, max(K.PROBE_MIN_S, b - a)
        for o in range(2 * K.WIDEN_S + 1):
            at = mid + ((o + 1) / 2 if o % 2 else -o / 2) * K.PROBE_STEP_S
            q0, q1 = max(seg_lo, mid - K.WIDEN_S, at - wide / 2), min(seg_hi, mid + K.WIDEN_S, at + wide / 2)
            ok = [k for v, t, k in samples if u is not None and v == u and k is not None and q0 <= t < q1]
            if any(ok):
                want[i] = (o, q0, q1, pytest.approx(sum(ok) / len(ok)))
                break
    assert 60 < len(want) < 150 and "at" in want and "edge" not in want
    evidence = spark.createDataFrame(rows, "uuid string, segment_id string, t_start double, t_end double, seg_lo double, seg_hi double")
    found = intervals.nearest_covered(evidence, spark.createDataFrame(samples, "uuid string, t double, ok boolean"), ["uuid"], "segment_id")
    assert {r["segment_id"]: (r["ord"], r["q0"], r["q1"], r["coverage"]) for r in found.collect()} == want
    from kinetra.plans import registry

    assert "Broadcast" not in registry.QUERIES["nearest_covered_probe"](spark, small)._jdf.queryExecution().executedPlan().toString()


def test_windows_of_whole_bursts_equal_single_ones(spark, small):
    """Bursts computed together against the path of single ones; those with holes beside them."""
    rng = np.random.default_rng(3)
    t, rows = np.arange(400) / 40, []
    for k in range(24):
        step, amp, n = 1 + k % 4 * 0.5, k / 30, 400 if k % 5 else 300 + k
        wave = np.sin(2 * np.pi * step * t[:n])
        acc = np.column_stack([t[:n], 0.5 + amp * wave, np.full(n, 0.1), -0.86 - amp * wave]) + (k % 3 == 0) * np.column_stack([np.zeros(n), rng.normal(0, 0.05, (n, 3))])
        if k % 4 == 3:
            acc = np.delete(acc, slice(100, 200), axis=0)  # a gap of 2.5 s
        acc[:, 1:] *= [1, K.STANDARD_GRAVITY, 3][k % 7 % 3]
        gyro = np.column_stack([t[:n], 0.05 * wave, amp * wave, np.full(n, 0.01)]) if k % 2 else None
        rows.append(("u", 60 * k, acc, gyro))
    rows += [("v", 0, None, None), ("v", 60, rows[0][2][:1], None), ("v", 120, rows[1][2][:40], None)]
    got = {(r["uuid"], r["timestamp"], r["index"]): r for r in recognition.windows(_bursts(spark, [(u, ts, *(None if x is None else [tuple(map(float, c)) for c in x] for x in (a, g))) for u, ts, a, g in rows]), signals=True).collect()}
    want, whole = {}, 0
    for u, ts, a, g in rows:
        if a is None or len(a) < 2:
            continue
        gyro = (None, None) if g is None else (g[:, 0], g[:, 1:])
        whole += N.whole(N.resampled(a[:, 0], a[:, 1:], *gyro), 50)
        for r in recognition._single(u, ts, N.preprocess(a[:, 0], a[:, 1:], *gyro), 50, 25, True):
            want[u, ts, r["index"]] = r
    assert got.keys() == want.keys() and 15 <= whole < 24
    for key, r in want.items():
        for name, x in r.items():
            y = got[key][name]
            if name.startswith("sig_"):
                x, y = np.array(x, float), np.array(y, float)
                assert x.shape == y.shape and np.allclose(x, y, atol=1e-9, equal_nan=True)
                continue
            assert y is None if isinstance(x, float) and math.isnan(x) else y == (pytest.approx(x, abs=1e-9) if name != "flags" else x), (key, name)
        assert (got[key]["sig_t"] is None) == ("sig_t" not in r)
    from kinetra.plans import registry

    bursts = recognition.windows(registry._bursts(spark, small)).drop("flags")
    fused = registry.QUERIES["burst_windows"](spark, small)
    assert fused.schema == bursts.schema and fused.exceptAll(bursts).isEmpty() and fused.count() == bursts.count() > 0


def test_runs_decoded_together_equal_single_ones(spark):
    """Runs of many lengths cut anywhere between batches, against the lattice of one run."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    for n in (1, 2, 5, 9, 40):
        e, a = np.log(rng.dirichlet(np.ones(7), (30, n))), np.log(rng.dirichlet(np.ones(7), (3, 7)))
        steps = rng.integers(0, 3, (30, n - 1))
        for k in (1, 3, 5):
            got = N.viterbi_bulk(e, a, k, steps)
            assert all((got[i] == N.viterbi_min_run(e[i], a[0], k, log_a_steps=[a[j] for j in steps[i]])).all() for i in range(30))
    keys = [(u, r) for u in (None, "a", "b") for r in (1, 2, 3) for _ in range(1 + 3 * r)]
    table = pa.table({"uuid": [u for u, _ in keys], "run_id": [r for _, r in keys], "i": range(len(keys))})
    for size in (1, 2, 5, 100):
        parts = [(t, edges) for t, edges in decode.whole_runs(table.to_batches(max_chunksize=size))]
        runs_ = [t.slice(lo, hi - lo).to_pylist() for t, edges in parts for lo, hi in zip(edges, edges[1:])]
        assert [r["i"] for run in runs_ for r in run] == list(range(len(keys))) and len(runs_) == 9
        assert all(len({(r["uuid"], r["run_id"]) for r in run}) == 1 for run in runs_)
