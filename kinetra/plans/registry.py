"""Registered queries of the engine over the driver's tables, with their SQL oracles.

Stand-ins: ``events`` plays the labelled minutes and, with the next event of the user as end, the timeline;
``lineitem`` numbers play motion features; ``embeddings`` play exemplar vectors and distributions;
``conversations`` play questions.  Doubles are rounded on both sides before they are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetra import constants as K
from kinetra.functions import columns as C
from kinetra.operators import analytics, decode, intervals, labels, metrics, rollup, router, store, windows
from kinetra.plans import recognition

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if oracle is not None:
            ORACLES[name or f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(c, 6)


def sec():
    return F.col("ts").cast("timestamp").cast("double")


def minutes(spark, d) -> DataFrame:
    return rollup.as_minutes(table(spark, d, "events"))


def segments(spark, d) -> DataFrame:
    """Events as half-open intervals up to the user's next event."""
    e = table(spark, d, "events").select(F.col("event_id").alias("segment_id"), F.col("user_id").alias("uuid"), F.col("event_type").alias("label"), sec().alias("t_start"), F.col("value").alias("confidence"))
    return e.withColumn("t_end", F.lead("t_start").over(W.partitionBy("uuid").orderBy("t_start", "segment_id"))).where("t_end > t_start")


SEG = """seg AS (SELECT * FROM (SELECT event_id AS segment_id, user_id AS uuid, event_type AS label, epoch(ts)::DOUBLE AS t_start, value AS confidence,
 lead(epoch(ts)::DOUBLE) OVER (PARTITION BY user_id ORDER BY epoch(ts)::DOUBLE, event_id) AS t_end FROM events) WHERE t_end > t_start)"""
MIN = "m AS (SELECT user_id::VARCHAR AS uuid, event_type AS label, (floor(epoch(ts)/60)*60)::BIGINT AS timestamp, epoch(ts)::DOUBLE AS t_start FROM events)"


def _rollup_sql(gap: int) -> str:
    return f"""WITH {MIN}, o AS (SELECT uuid, to_timestamp(timestamp)::TIMESTAMP::DATE AS date, label AS activity, timestamp, min(t_start) AS lo, max(t_start) AS hi FROM m GROUP BY ALL),
k AS (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER w <= {(gap + 1) * 60} THEN 0 ELSE 1 END AS nw FROM o WINDOW w AS (PARTITION BY uuid, date, activity ORDER BY timestamp))
SELECT uuid, date, activity, (count(*)*60)::DOUBLE AS total_duration_s, sum(nw)::BIGINT AS bout_count, round((count(*)*60)::DOUBLE/sum(nw), 6) AS avg_bout_s, min(lo) AS first_onset, max(hi) AS last_onset, count(*) AS labeled_minutes FROM k GROUP BY uuid, date, activity"""


@query(_rollup_sql(1))
def daily_rollup(spark, d):
    return rollup.daily_rollup(minutes(spark, d)).withColumn("avg_bout_s", r6("avg_bout_s"))


@query(_rollup_sql(360))
def daily_rollup_wide_gap(spark, d):
    return rollup.daily_rollup(minutes(spark, d), 360).withColumn("avg_bout_s", r6("avg_bout_s"))


_DAILY = f"""{MIN}, dd AS (SELECT label AS activity, to_timestamp(timestamp)::TIMESTAMP::DATE AS date, uuid, count(DISTINCT timestamp)*60.0 AS s FROM m GROUP BY ALL),
sm AS (SELECT activity, date, sum(s)::DOUBLE AS v FROM dd GROUP BY ALL),
cal AS (SELECT activity, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS date FROM (SELECT activity, min(date) AS lo, max(date) AS hi FROM sm GROUP BY activity)),
z AS (SELECT cal.activity, cal.date, coalesce(v, 0.0) AS v, CASE WHEN v IS NULL THEN 0 ELSE 1 END AS has FROM cal LEFT JOIN sm ON cal.activity = sm.activity AND cal.date = sm.date)"""


@query(f"""WITH {_DAILY} SELECT activity, date, round(avg(v) OVER w, 6) AS rolling_mean_duration_s, sum(has) OVER w::BIGINT AS n_days_with_data FROM z
WINDOW w AS (PARTITION BY activity ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""".replace("sum(has) OVER w::BIGINT", "(sum(has) OVER w)::BIGINT"))
def rolling_7d(spark, d):
    out = rollup.rolling(rollup.daily_rollup(minutes(spark, d)), "7d")
    return out.withColumn("rolling_mean_duration_s", r6("rolling_mean_duration_s"))


def _orders_daily(spark, d):
    return table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("activity"), F.col("o_totalprice").cast("double").alias("total_duration_s"))


def _calendar_sql(unit: str) -> str:
    return f"""WITH sm AS (SELECT o_orderpriority AS activity, o_orderdate::DATE AS date, sum(o_totalprice)::DOUBLE AS v FROM orders GROUP BY ALL),
cal AS (SELECT activity, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS date FROM (SELECT activity, min(date) AS lo, max(date) AS hi FROM sm GROUP BY activity)),
z AS (SELECT cal.activity, date_trunc('{unit}', cal.date)::DATE AS date, coalesce(v, 0.0) AS v, CASE WHEN v IS NULL THEN 0 ELSE 1 END AS has FROM cal LEFT JOIN sm ON cal.activity = sm.activity AND cal.date = sm.date),
b AS (SELECT activity, date, avg(v) AS mv, sum(has) AS n FROM z GROUP BY ALL)
SELECT activity, date, round(avg(mv) OVER w, 4) AS rolling_mean_duration_s, (sum(n) OVER w)::BIGINT AS n_days_with_data FROM b WINDOW w AS (PARTITION BY activity ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@query(_calendar_sql("month"))
def rolling_month(spark, d):
    return rollup.rolling(_orders_daily(spark, d), "month").withColumn("rolling_mean_duration_s", F.round("rolling_mean_duration_s", 4))


@query(_calendar_sql("year"))
def rolling_year(spark, d):
    return rollup.rolling(_orders_daily(spark, d), "year").withColumn("rolling_mean_duration_s", F.round("rolling_mean_duration_s", 4))


TYPES = ("click", "error", "purchase", "signup", "view")


@query(f"WITH {SEG} SELECT to_timestamp(t_start)::TIMESTAMP::DATE AS date, " + ", ".join(f"round(coalesce(sum(CASE WHEN label = '{t}' THEN t_end - t_start END)/60, 0.0), 6) AS {t}" for t in TYPES) + " FROM seg GROUP BY 1")
def daily_pivot(spark, d):
    s = segments(spark, d).select(rollup.utc_day(F.col("t_start")).alias("date"), "label", (F.col("t_end") - F.col("t_start")).alias("duration_s"))
    return rollup.daily_pivot(s, list(TYPES)).select("date", *[r6(t).alias(t) for t in TYPES])


@query(f"WITH {SEG} SELECT label, round(sum(t_end - t_start), 3) AS total_s FROM seg GROUP BY label")
def duration_by_label(spark, d):
    return rollup.duration_by_label(segments(spark, d)).withColumn("total_s", F.round("total_s", 3))


@query(f"WITH {SEG} SELECT round(sum(t_end - t_start), 3) AS total_s, count(*) AS n, round(avg(confidence), 6) AS mean_conf, min(t_start) AS first_s, max(t_end) AS last_s FROM seg WHERE label = 'click'")
def activity_total(spark, d):
    return rollup.activity_total(segments(spark, d), "click").withColumn("total_s", F.round("total_s", 3)).withColumn("mean_conf", r6("mean_conf"))


@query(f"WITH {SEG} SELECT uuid, count(DISTINCT to_timestamp(t_start)::TIMESTAMP::DATE) AS n_days, min(to_timestamp(t_start)::TIMESTAMP::DATE) AS first_day, max(to_timestamp(t_start)::TIMESTAMP::DATE) AS last_day FROM seg GROUP BY uuid")
def data_coverage(spark, d):
    return rollup.data_coverage(segments(spark, d), ["uuid"])


@query("WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), w AS (SELECT *, (1-0.999)/(1-pow(0.999, n)) AS w FROM n) SELECT event_type, n, round(w/(SELECT avg(w) FROM w), 6) AS weight FROM w")
def class_weights(spark, d):
    return rollup.class_weights(table(spark, d, "events"), "event_type").withColumn("weight", r6("weight"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, min(epoch(ts)::DOUBLE) AS first_s FROM events GROUP BY 1")
def class_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users"), F.min(sec()).alias("first_s"))


@query(f"""WITH {SEG}, u AS (SELECT *, sum(CASE WHEN label = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY uuid ORDER BY t_start, t_end ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM (SELECT *, least(t_end, t_start + 1800) AS e FROM seg)),
b AS (SELECT *, max(e) OVER (PARTITION BY uuid, isl ORDER BY t_start, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM u WHERE label <> 'error'),
c AS (SELECT *, sum(CASE WHEN latest IS NULL OR t_start > latest + 21600 + 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY uuid ORDER BY t_start, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_id FROM b)
SELECT uuid, run_id::BIGINT AS run_id, count(*) AS n, min(t_start) AS run_start, max(e) AS run_end FROM c GROUP BY ALL""")
def usable_runs(spark, d):
    s = segments(spark, d).withColumn("e", F.least("t_end", F.col("t_start") + 1800))
    r = intervals.runs(s, ["uuid"], "t_start", "e", F.col("label") != "error", 21600.0)
    return r.groupBy("uuid", "run_id").agg(F.count(F.lit(1)).alias("n"), F.min("t_start").alias("run_start"), F.max("e").alias("run_end"))


@query("""WITH x AS (SELECT event_type, value, unnest([floor(epoch(ts)/3600)*3600 - 3600, floor(epoch(ts)/3600)*3600]) AS w FROM events)
SELECT event_type, to_timestamp(w)::TIMESTAMP AS w_start, count(*) AS n, round(avg(value), 6) AS mean_value FROM x GROUP BY ALL""")
def sliding_windows(spark, d):
    return windows.sliding_time(table(spark, d, "events"), ["event_type"], "ts", "value", "2 hours", "1 hour").withColumn("mean_value", r6("mean_value")).withColumn("w_start", F.col("w_start").cast("timestamp_ntz"))


@query("SELECT user_id, event_id, " + ", ".join(f"round(avg(value) OVER w{k}, 6) AS roll{k}_mean, round(stddev_pop(value) OVER w{k}, 6) AS roll{k}_std" for k in (2, 5)) + " FROM events WINDOW " + ", ".join(f"w{k} AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)" for k in (2, 5)))
def centred_context(spark, d):
    c = windows.context(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value")
    return c.select("user_id", "event_id", *[r6(f"roll{k}_{s}").alias(f"roll{k}_{s}") for k in (2, 5) for s in ("mean", "std")])


_PAIRS = "p AS (SELECT fr AS \"from\", event_type AS \"to\", count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS fr FROM events) WHERE fr IS NOT NULL GROUP BY ALL)"


@query(f"WITH {_PAIRS} SELECT * FROM p")
def transition_counts(spark, d):
    return metrics.transition_pairs(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query(f"""WITH {_PAIRS}, t AS (SELECT DISTINCT event_type AS c FROM events), pr AS (SELECT a.c AS "from", b.c AS "to", CASE WHEN a.c = b.c THEN 0.6 ELSE 0.1 END AS p FROM t a, t b),
r AS (SELECT "from", sum(n) AS row_n FROM p GROUP BY 1)
SELECT pr."from", pr."to", round(CASE WHEN coalesce(row_n, 0) < 2000 THEN pr.p ELSE (coalesce(n, 0) + 5.0*pr.p)/(row_n + 5.0) END, 9) AS p, CASE WHEN coalesce(row_n, 0) < 2000 THEN 'prior' ELSE 'blended' END AS source, coalesce(row_n, 0)::BIGINT AS row_n
FROM pr LEFT JOIN p ON pr."from" = p."from" AND pr."to" = p."to" LEFT JOIN r ON pr."from" = r."from\"""")
def transition_blend(spark, d):
    e = table(spark, d, "events")
    t = e.select("event_type").distinct()
    prior = t.select(F.col("event_type").alias("from")).crossJoin(t.select(F.col("event_type").alias("to"))).withColumn("p", F.when(F.col("from") == F.col("to"), 0.6).otherwise(0.1))  # classes squared
    return metrics.blend_transitions(metrics.transition_pairs(e, ["user_id"], ["ts", "event_id"], "event_type"), prior, least=2000).withColumn("p", F.round("p", 9))


_HOURS = "h AS (SELECT DISTINCT user_id AS uuid, floor(epoch(ts)/3600)*3600.0 AS l_start, floor(epoch(ts)/3600)*3600.0 + 3600 AS l_end FROM events)"


def _hours(spark, d):
    lo = F.floor(sec() / 3600) * 3600.0
    return table(spark, d, "events").select(F.col("user_id").alias("uuid"), lo.alias("l_start"), (lo + 3600).alias("l_end")).distinct()


@query(f"""WITH {SEG}, {_HOURS}, j AS (SELECT h.uuid, l_start, l_end, label, t_start AS r_start, least(l_end, t_end) - greatest(l_start, t_start) AS overlap FROM h JOIN seg ON h.uuid = seg.uuid AND t_start < l_end AND t_end > l_start)
SELECT uuid, l_start, l_end, label, r_start, round(overlap, 6) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY uuid, l_start ORDER BY overlap DESC, r_start, label) AS r FROM j WHERE overlap > 0) WHERE r = 1""")
def majority_overlap(spark, d):
    s = segments(spark, d).select("uuid", "label", F.col("t_start").alias("r_start"), F.col("t_end").alias("r_end"))
    return intervals.majority_label(_hours(spark, d), s, ["uuid"], 3600.0).select("uuid", "l_start", "l_end", "label", "r_start", r6("overlap").alias("overlap"))


@query(f"""WITH {_HOURS}, s AS (SELECT user_id AS uuid, epoch(ts)::DOUBLE AS t, CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END AS ok FROM events),
q AS (SELECT uuid, l_start - 5400 AS q0, l_end AS q1 FROM h)
SELECT q.uuid, q0, q1, round(coalesce(avg(ok), 0.0), 6) AS coverage FROM q LEFT JOIN s ON q.uuid = s.uuid AND t >= q0 AND t < q1 GROUP BY q.uuid, q0, q1""")
def coverage(spark, d):
    q = _hours(spark, d).select("uuid", (F.col("l_start") - 5400).alias("q0"), F.col("l_end").alias("q1"))
    s = table(spark, d, "events").select(F.col("user_id").alias("uuid"), sec().alias("t"), (F.col("event_type") != "error").alias("ok"))
    return intervals.coverage(q, s, ["uuid"], 3600.0).withColumn("coverage", r6("coverage"))


@query(f"""WITH {SEG}, ev AS (SELECT uuid, segment_id, t_start + 40.0 AS a, t_start + 44.0 AS b, t_start - 300.0 AS seg_lo, t_start + 300.0 AS seg_hi FROM seg),
o AS (SELECT *, unnest(range(0, 241)) AS ord FROM ev),
pb AS (SELECT uuid, segment_id, ord, greatest(greatest(seg_lo, (a+b)/2 - 120), (a+b)/2 + (CASE WHEN ord % 2 = 1 THEN (ord+1)/2.0 ELSE -ord/2.0 END) - 2.0) AS q0, least(least(seg_hi, (a+b)/2 + 120), (a+b)/2 + (CASE WHEN ord % 2 = 1 THEN (ord+1)/2.0 ELSE -ord/2.0 END) + 2.0) AS q1 FROM o),
s AS (SELECT user_id AS uuid, epoch(ts)::DOUBLE AS t FROM events),
hit AS (SELECT pb.uuid, segment_id, ord, q0, q1, row_number() OVER (PARTITION BY segment_id ORDER BY ord) AS r FROM pb JOIN s ON pb.uuid = s.uuid AND t >= q0 AND t < q1 WHERE q1 > q0)
SELECT uuid, segment_id, ord::INT AS ord, q0, q1, 1.0::DOUBLE AS coverage FROM hit WHERE r = 1""")
def nearest_covered_probe(spark, d):
    s = segments(spark, d)
    ev = s.select("uuid", "segment_id", (F.col("t_start") + 40.0).alias("t_start"), (F.col("t_start") + 44.0).alias("t_end"), (F.col("t_start") - 300.0).alias("seg_lo"), (F.col("t_start") + 300.0).alias("seg_hi"))
    points = table(spark, d, "events").select(F.col("user_id").alias("uuid"), sec().alias("t"), F.lit(True).alias("ok"))
    return intervals.nearest_covered(ev, points, ["uuid"], "segment_id")


def _vectors(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.where("vec_id >= 25"), e.where("vec_id < 25").withColumnRenamed("vec_id", "exemplar_id")


def _knn_sql(metric: str) -> str:
    score = "greatest(0.0, 1.0 - sum(zq*zb)/(CASE WHEN sqrt(sum(zq*zq)) = 0 THEN 1 ELSE sqrt(sum(zq*zq)) END * CASE WHEN sqrt(sum(zb*zb)) = 0 THEN 1 ELSE sqrt(sum(zb*zb)) END))" if metric == "cosine" else "sqrt(sum((zq-zb)*(zq-zb)))"
    return f"""WITH e AS (SELECT vec_id, i, embedding[i]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i)), st AS (SELECT i, avg(x) AS m, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS s FROM e WHERE vec_id < 25 GROUP BY i),
z AS (SELECT vec_id, e.i, (x - m)/s AS z FROM e JOIN st ON e.i = st.i), dd AS (SELECT q.vec_id, b.vec_id AS exemplar_id, round({score.replace("zq", "q.z").replace("zb", "b.z")}, 9) AS distance FROM z q JOIN z b ON q.i = b.i WHERE q.vec_id >= 25 AND b.vec_id < 25 GROUP BY ALL)
SELECT vec_id, exemplar_id, round(distance, 6) AS distance, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, exemplar_id) AS r FROM dd) WHERE r <= 3"""


@query(_knn_sql("cosine"))
def knn_cosine(spark, d):
    q, b = _vectors(spark, d)
    return analytics.nearest(q, b, 3, query_id="vec_id", bank_id="exemplar_id", vector="v").withColumn("distance", r6("distance"))


@query(_knn_sql("euclidean"))
def knn_euclidean(spark, d):
    q, b = _vectors(spark, d)
    return analytics.nearest(q, b, 3, query_id="vec_id", bank_id="exemplar_id", vector="v", metric="euclidean").withColumn("distance", r6("distance"))


@query("SELECT (i - 1)::INT AS pos, round(avg(embedding[i]::DOUBLE), 6) AS mean, round(CASE WHEN stddev_pop(embedding[i]::DOUBLE) = 0 THEN 1 ELSE stddev_pop(embedding[i]::DOUBLE) END, 6) AS std FROM embeddings, (SELECT unnest(range(1, 65)) AS i) WHERE vec_id < 25 GROUP BY i")
def bank_stats(spark, d):
    return analytics.bank_stats(_vectors(spark, d)[1], "v").select("pos", r6("mean").alias("mean"), r6("std").alias("std"))


@query("""WITH n AS (SELECT user_id AS k, event_id, event_type, value FROM events WHERE event_id % 3 = 0), b AS (SELECT user_id AS k, max(event_id) AS event_id FROM events WHERE event_id % 3 <> 0 GROUP BY 1),
o AS (SELECT b.k, b.event_id, e.event_type, e.value FROM b JOIN events e ON b.event_id = e.event_id), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY event_id DESC) AS r FROM n) WHERE r = 1)
SELECT k, event_id, event_type, value FROM o WHERE k NOT IN (SELECT k FROM l) UNION ALL SELECT k, event_id, event_type, value FROM l""")
def upsert_last_wins(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("k"), "event_id", "event_type", "value")
    old = store.last_wins(e.where("event_id % 3 <> 0"), ["k"], [F.col("event_id")])
    return store.upsert(old, e.where("event_id % 3 = 0"), "k", "event_id")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def foreign_key_orphans(spark, d):
    parent = table(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"))
    return store.orphans(table(spark, d, "orders"), parent, "o_custkey").select("o_orderkey")


_SIGNATURE = "sg AS (SELECT l_orderkey*10 + l_linenumber AS segment_id, l_extendedprice/20000.0 AS sma, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity/10.0 END AS gx, l_tax*10 AS gy, l_discount*10 AS gz, 50 + l_quantity AS tilt, l_discount*200 AS tstd, l_quantity/5.0 AS dur FROM lineitem)"


def _signature(spark, d):
    dbl = lambda c: F.col(c).cast("double")
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("segment_id"), F.lit(0.0).alias("t_start"), (dbl("l_quantity") / 5.0).alias("t_end"), (dbl("l_extendedprice") / 20000.0).alias("sma"), F.when(F.col("l_linenumber") % 3 != 0, dbl("l_quantity") / 10.0).alias("gyro_rms_x"), (dbl("l_tax") * 10).alias("gyro_rms_y"), (dbl("l_discount") * 10).alias("gyro_rms_z"), (dbl("l_quantity") + 50).alias("tilt_deg_mean"), (dbl("l_discount") * 200).alias("tilt_deg_std"), (dbl("l_quantity") / 5.0).alias("duration_s"))


@query(f"WITH {_SIGNATURE}, j AS (SELECT *, sma*sqrt(coalesce(gx*gx, 0) + gy*gy + gz*gz) AS je FROM sg) SELECT segment_id, round((je - 2)/2.0 + (tilt - 70)/110.0, 6) AS score, round(je, 6) AS trigger_jerk_energy FROM j WHERE round(je, 9) > 2 AND tilt >= 70 AND round(tstd, 9) <= 15 AND dur >= 2")
def event_rule(spark, d):
    s = _signature(spark, d).withColumn("tilt_deg_std", F.round("tilt_deg_std", 9))
    return analytics.physics_events(s).select("segment_id", r6("score").alias("score"), r6("trigger_jerk_energy").alias("trigger_jerk_energy"))


@query(f"WITH {_SIGNATURE} SELECT segment_id, round(sma*sqrt(coalesce(gx*gx, 0) + gy*gy + gz*gz), 6) AS jerk_energy FROM sg")
def jerk_energy(spark, d):
    s = _signature(spark, d)
    return s.select("segment_id", r6(analytics.jerk_energy(F.col("sma"), F.col("gyro_rms_x"), F.col("gyro_rms_y"), F.col("gyro_rms_z"))).alias("jerk_energy"))


_GAPS = "g AS (SELECT segment_id, CASE WHEN segment_id % 7 = 0 THEN NULL ELSE round(sma*sqrt(coalesce(gx*gx, 0) + gy*gy + gz*gz), 9) END AS je, CASE WHEN segment_id % 5 = 0 THEN NULL ELSE tilt END AS tilt, CASE WHEN segment_id % 11 = 0 THEN NULL ELSE tstd END AS tstd, dur FROM sg)"


@query(f"WITH {_SIGNATURE}, {_GAPS} SELECT segment_id, CASE WHEN je IS NULL THEN 'jerk_energy_missing' WHEN je <= 2 THEN '' WHEN tilt IS NULL THEN 'tilt_missing' WHEN tstd IS NULL THEN 'tilt_std_missing' WHEN dur < 2 THEN 'short_segment' ELSE '' END AS flags FROM g")
def event_flags(spark, d):
    """Every segment; by rule some lack motion, tilt or its deviation."""
    s = _signature(spark, d)
    gap = lambda c, n: F.when(F.col("segment_id") % n != 0, F.col(c))
    s = s.select("segment_id", "duration_s", "gyro_rms_x", "gyro_rms_y", "gyro_rms_z", gap("sma", 7).alias("sma"), gap("tilt_deg_mean", 5).alias("tilt_deg_mean"), gap("tilt_deg_std", 11).alias("tilt_deg_std"))
    return analytics.event_flags(s).select("segment_id", F.array_join("flags", ",").alias("flags"))


EVENT_MET = {"click": (3.5, 2.0, 4.5), "purchase": (8.0, 6.0, 13.5), "view": (1.5, 1.3, 1.8), "signup": (1.8, 1.3, 2.3)}
_MET = "met(activity, m, lo, hi) AS (VALUES " + ", ".join(f"('{k}', {a}, {b}, {c})" for k, (a, b, c) in EVENT_MET.items()) + ")"


@query(f"WITH {MIN}, {_MET}, r AS (SELECT uuid, to_timestamp(timestamp)::TIMESTAMP::DATE AS date, label AS activity, count(DISTINCT timestamp)*60.0 AS s FROM m GROUP BY ALL) SELECT uuid, date, r.activity, " + ", ".join(f"round({c}*62.0*3.5/200.0*(s/60.0), 6) AS {n}" for c, n in (("met.m", "kcal"), ("met.lo", "kcal_low"), ("met.hi", "kcal_high"))) + ", TRUE AS weight_is_assumed FROM r JOIN met ON r.activity = met.activity")
def energy(spark, d):
    daily = rollup.daily_rollup(minutes(spark, d)).select("uuid", "date", "activity", "total_duration_s")
    out = analytics.energy(daily, analytics.met_table(spark, EVENT_MET))
    return out.select("uuid", "date", "activity", *[r6(c).alias(c) for c in ("kcal", "kcal_low", "kcal_high")], "weight_is_assumed")


@query(f"WITH {SEG} SELECT round(sum(1.5*62.0*3.5/200.0*((t_end - t_start)/60.0)), 2) AS kcal FROM seg")
def flat_energy(spark, d):
    return analytics.flat_energy(segments(spark, d)).select(F.round("kcal", 2).alias("kcal"))


@query("""WITH g AS (SELECT i/100.0 AS a FROM (SELECT unnest(range(0, 101)) AS i)), l AS (SELECT a, avg(-ln(greatest(a*(0.05 + l_discount*8) + (1.0 - a)*(0.9 - l_tax*9), 1e-12))) AS loss FROM lineitem, g GROUP BY a)
SELECT a::DOUBLE AS value, round(loss, 6) AS loss FROM l ORDER BY round(loss, 12), a LIMIT 1""")
def alpha_grid(spark, d):
    li = table(spark, d, "lineitem")
    return metrics.fit_alpha(li, F.lit(0.05) + F.col("l_discount").cast("double") * 8, F.lit(0.9) - F.col("l_tax").cast("double") * 9).withColumn("loss", r6("loss"))


@query("""WITH g AS (SELECT 0.5 + 0.05*i AS t FROM (SELECT unnest(range(0, 31)) AS i)), l AS (SELECT t, avg(ln(exp(l_quantity/10.0/t) + exp(l_discount*20/t) + exp(l_tax*20/t)) - (l_quantity/10.0)/t) AS loss FROM lineitem, g GROUP BY t)
SELECT round(t, 6)::DOUBLE AS value, round(loss, 6) AS loss FROM l ORDER BY round(loss, 12), t LIMIT 1""")
def temperature_grid(spark, d):
    q, a, b = (F.col(c).cast("double") * k for c, k in (("l_quantity", 0.1), ("l_discount", 20.0), ("l_tax", 20.0)))
    return metrics.fit_temperature(table(spark, d, "lineitem"), q, F.array(q, a, b)).select(r6("value").alias("value"), r6("loss").alias("loss"))


@query("SELECT quality AS truth, toxic AS pred, count(*) AS n FROM labels GROUP BY ALL")
def confusion(spark, d):
    return metrics.confusion(table(spark, d, "labels"), "quality", "toxic")


_PC = """c AS (SELECT quality AS t, toxic AS p, count(*) AS n FROM labels GROUP BY ALL), k AS (SELECT t AS cls FROM c UNION SELECT p FROM c),
m AS (SELECT cls, (SELECT coalesce(sum(n), 0) FROM c WHERE t = cls)::DOUBLE AS support, (SELECT coalesce(sum(n), 0) FROM c WHERE t = cls AND p = cls)::DOUBLE AS tp, (SELECT coalesce(sum(n), 0) FROM c WHERE p = cls)::DOUBLE AS pr FROM k),
f AS (SELECT cls, CASE WHEN pr > 0 THEN tp/pr ELSE 0 END AS pre, CASE WHEN support > 0 THEN tp/support ELSE 0 END AS rec, support FROM m),
ff AS (SELECT cls, pre, rec, CASE WHEN pre + rec > 0 THEN 2*pre*rec/(pre + rec) ELSE 0 END AS f1, support FROM f)"""


@query(f"WITH {_PC} SELECT cls, round(pre, 6) AS precision, round(rec, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM ff")
def per_class_metrics(spark, d):
    return metrics.per_class(table(spark, d, "labels"), "quality", "toxic").select("cls", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"WITH {_PC}, a AS (SELECT avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) AS accuracy FROM labels), b AS (SELECT avg(f1) AS macro_f1, max(support)/sum(support) AS baseline FROM ff WHERE support > 0) SELECT round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(baseline, 6) AS baseline, round(accuracy - baseline, 6) AS gain FROM a, b")
def metric_summary(spark, d):
    return metrics.summary(table(spark, d, "labels"), "quality", "toxic").select(*[r6(c).alias(c) for c in ("accuracy", "macro_f1", "baseline", "gain")])


_NORM = ("l_quantity", "l_extendedprice", "l_discount")


@query("WITH s AS (" + " UNION ALL ".join(f"SELECT '{c}' AS channel, quantile_cont({c}::DOUBLE, 0.5) AS median, CASE WHEN quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25) > 0 THEN (quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25))/1.349 ELSE 1.0 END AS scale FROM lineitem" for c in _NORM) + ") SELECT channel, round(median, 6) AS median, round(scale, 6) AS scale FROM s")
def robust_normaliser(spark, d):
    return metrics.robust_normaliser(table(spark, d, "lineitem"), list(_NORM)).select("channel", r6("median").alias("median"), r6("scale").alias("scale"))


@query("WITH x AS (SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity::DOUBLE END AS q FROM lineitem), m AS (SELECT l_returnflag, median(q) AS md FROM x GROUP BY 1) SELECT l_orderkey, l_linenumber, x.l_returnflag, coalesce(q, md) AS q FROM x JOIN m ON x.l_returnflag = m.l_returnflag")
def impute_median(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.when(F.col("l_linenumber") != 2, F.col("l_quantity").cast("double")).alias("q"))
    return metrics.impute_median(x, ["q"], ["l_returnflag"]).select("l_orderkey", "l_linenumber", "l_returnflag", "q")


_ORDER = "(user_id * 7919) % 10007"


@query(f"WITH u AS (SELECT user_id, row_number() OVER (ORDER BY {_ORDER}, user_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events)) SELECT user_id, CASE WHEN r <= floor(n*0.6 + 0.5) THEN 'train' WHEN r <= floor(n*0.6 + 0.5) + floor(n*0.2 + 0.5) THEN 'val' ELSE 'test' END AS split FROM u")
def user_split(spark, d):
    return labels.split_users(table(spark, d, "events"), "user_id", F.expr(_ORDER))


@query(f"SELECT user_id, ((row_number() OVER (ORDER BY {_ORDER}, user_id) - 1) % 5)::INT AS fold FROM (SELECT DISTINCT user_id FROM events)")
def user_folds(spark, d):
    return labels.kfold(table(spark, d, "events"), "user_id", F.expr(_ORDER), 5)


@query("WITH a AS (SELECT *, (event_id*7919) % 100003 AS o FROM events), b AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY o) AS rd FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY rd, user_id, o) AS pk FROM b) SELECT event_id, event_type, user_id, rd::INT AS round FROM c WHERE pk <= 200")
def balanced_cap(spark, d):
    return labels.balanced_cap(table(spark, d, "events"), "event_type", "user_id", F.expr("(event_id * 7919) % 100003"), 200).select("event_id", "event_type", "user_id", "round")


_P7 = "e7 AS (SELECT vec_id, embedding[1:7] AS v FROM embeddings), x AS (SELECT vec_id, i, v[i]::DOUBLE AS z FROM e7, (SELECT unnest(range(1, 8)) AS i)), mx AS (SELECT vec_id, max(z) AS m FROM x GROUP BY 1), s AS (SELECT x.vec_id, i, exp(z - m) AS e FROM x JOIN mx ON x.vec_id = mx.vec_id), t AS (SELECT vec_id, sum(e) AS tot FROM s GROUP BY 1), p AS (SELECT s.vec_id, i, e/tot AS p FROM s JOIN t ON s.vec_id = t.vec_id)"


def _probs(spark, d):
    return table(spark, d, "embeddings").select("vec_id", C.softmax(F.slice(F.col("embedding").cast("array<double>"), 1, 7)).alias("p"))


@query(f"WITH {_P7} SELECT vec_id, round(-sum(p*ln(p)), 6) AS entropy, round(1 + sum(p*ln(p))/ln(7.0), 6) AS confidence, round(max(p), 6) AS top_prob, (arg_max(i, p) - 1)::INT AS best FROM p GROUP BY vec_id")
def distribution_stats(spark, d):
    p = F.col("p")
    return _probs(spark, d).select("vec_id", r6(C.entropy(p)).alias("entropy"), r6(C.confidence(p)).alias("confidence"), r6(F.array_max(p)).alias("top_prob"), C.argmax(p).alias("best"))


@query(f"WITH {_P7} SELECT vec_id, (i - 1)::INT AS index, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) AS r FROM p) WHERE r <= 3")
def top_classes(spark, d):
    return _probs(spark, d).select("vec_id", F.explode(C.top_k(F.col("p"), 3)).alias("x")).select("vec_id", F.col("x.index").cast("int").alias("index"), r6("x.p").alias("p"))


@query(f"WITH {_P7}, q AS (SELECT vec_id, i, greatest(1e-12, 0.3*p + 0.7/7.0) AS b FROM p), qs AS (SELECT vec_id, sum(b) AS tb FROM q GROUP BY 1) SELECT q.vec_id, (i - 1)::INT AS index, round(b/tb, 6) AS p FROM q JOIN qs ON q.vec_id = qs.vec_id")
def blended_distribution(spark, d):
    even = F.array(*[F.lit(1.0 / 7)] * 7)
    return _probs(spark, d).select("vec_id", F.posexplode(C.blend(F.col("p"), even, F.lit(0.3))).alias("index", "p")).withColumn("p", r6("p"))


@query("WITH a AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS u, embedding[5]::DOUBLE AS v, embedding[6]::DOUBLE AS w FROM embeddings) SELECT vec_id, round(degrees(acos(greatest(-1.0, least(1.0, -z/sqrt(x*x + y*y + z*z))))), 6) AS tilt, round((u*x + v*y + w*z)/sqrt(x*x + y*y + z*z), 6) AS vertical FROM a")
def orientation(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    g, b = F.slice("e", 1, 3), F.slice("e", 4, 3)
    return e.select("vec_id", r6(C.tilt(g)).alias("tilt"), r6(C.vertical(b, g)).alias("vertical"))


_G = "SELECT vec_id, abs(embedding[1]::DOUBLE) AS x, abs(embedding[2]::DOUBLE) AS y, abs(embedding[3]::DOUBLE) AS z FROM embeddings"


@query(f"WITH a AS ({_G}), t AS (SELECT *, x*x + y*y + z*z AS s FROM a) SELECT vec_id, round(greatest(x, y, z)/sqrt(s), 6) AS dominance, round(-(x*x/s*ln(x*x/s + 1e-12) + y*y/s*ln(y*y/s + 1e-12) + z*z/s*ln(z*z/s + 1e-12)), 6) AS spread, round(sqrt(s)/(x + 1e-6), 4) AS ratio FROM t")
def rotation_shape(spark, d):
    e = F.col("embedding").cast("array<double>")
    a = table(spark, d, "embeddings").select("vec_id", *[F.abs(F.element_at(e, i + 1)).alias(c) for i, c in enumerate("xyz")])
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return a.select("vec_id", r6(C.gyro_dominance(x, y, z)).alias("dominance"), r6(C.gyro_entropy(x, y, z)).alias("spread"), F.round(C.rotation_ratio(F.sqrt(x * x + y * y + z * z), x), 4).alias("ratio"))


def _features(spark, d):
    q, p, di, ta = (F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (p / 100000.0 * F.when(F.col("l_linenumber") == 1, 0.02).otherwise(1.0)).alias("sma"), (q * 3.6).alias("tilt_deg"), di.alias("periodicity"), (q * F.when(F.col("l_linenumber") % 2 == 0, 2.0).otherwise(0.0)).alias("cadence_bpm"), F.lit(0.0).alias("dominant_freq_hz"), (ta * 50).alias("jerk_mean"), di.alias("vertical_std"), (F.col("l_linenumber") % 3 != 0).alias("has_gyro"), (ta * 4).alias("gyro_rms"), F.when(F.col("l_linenumber") == 5, "bag").otherwise("pocket").alias("phone_placement"))
    return li


_FEAT = "f AS (SELECT l_orderkey, l_linenumber, l_extendedprice/100000.0*(CASE WHEN l_linenumber = 1 THEN 0.02 ELSE 1.0 END) AS sma, l_quantity*3.6 AS tilt, l_discount::DOUBLE AS per, l_quantity*(CASE WHEN l_linenumber % 2 = 0 THEN 2.0 ELSE 0.0 END) AS cad, l_tax*50 AS jerk, l_discount::DOUBLE AS vs, (l_linenumber % 3 <> 0) AS hg, l_tax*4 AS gr, (l_linenumber = 5) AS bag FROM lineitem)"


@query(f"""WITH {_FEAT} SELECT l_orderkey, l_linenumber, CASE
WHEN sma < 0.03 AND (NOT hg OR gr < 0.3) THEN CASE WHEN bag THEN CASE WHEN sma < 0.008 THEN 'lying down' WHEN sma < 0.03 THEN 'sitting' ELSE 'standing in place' END
  WHEN tilt < 20 OR tilt > 160 THEN 'lying down' WHEN tilt <= 70 AND sma < 0.004 THEN 'lying down' WHEN tilt > 70 THEN 'standing in place' ELSE 'sitting' END
WHEN (per > 0.15 OR cad > 0) AND (sma > 0.45 OR cad >= 135 OR jerk > 8.0) THEN 'running'
WHEN (per > 0.15 OR cad > 0) AND hg AND gr/(sma + 1e-6) > 2.0 THEN 'bicycling'
WHEN (per > 0.15 OR cad > 0) AND cad >= 80 THEN 'walking'
WHEN vs > 0 THEN CASE WHEN vs > 0.05 THEN 'standing and moving' ELSE 'standing in place' END
WHEN sma > 0.12 THEN 'standing and moving' ELSE 'standing in place' END AS label FROM f""")
def hard_labels(spark, d):
    f = _features(spark, d)
    return f.select("l_orderkey", "l_linenumber", C.label_activity({c: F.col(c) for c in f.columns}).alias("label"))


@query()
def soft_labels(spark, d):
    f = _features(spark, d).withColumns({f"gyro_{a}_rms": F.col("gyro_rms") / (i + 1) for i, a in enumerate("xyz")} | {"acc_gyro_phase": F.col("periodicity")})
    return f.select("l_orderkey", "l_linenumber", C.predict_proba({c: F.col(c) for c in f.columns}).alias("probs"))


def _router_sql() -> str:
    q = "regexp_replace(text, '\\s+', ' ', 'g')"
    def case(out) -> str:
        return "CASE " + " ".join(f"WHEN regexp_matches(q, '{p}', 'i') THEN {out(i)}" for i, (p, _, _) in enumerate(K.ROUTES)) + " END"
    return f"WITH t AS (SELECT conv_id, turn, trim({q}) AS q FROM conversations) SELECT conv_id, turn, coalesce({case(lambda i: repr(K.ROUTES[i][1]))}, 'unknown') AS route, coalesce({case(lambda i: K.ROUTES[i][2])}, 0.0)::DOUBLE AS confidence FROM t"


@query(_router_sql())
def question_routes(spark, d):
    c = router.route_columns(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", c["route"].alias("route"), c["confidence"].alias("confidence"))


@query("""WITH a AS (SELECT user_id, event_id, value - avg(value) OVER (PARTITION BY user_id) AS dv FROM events), b AS (SELECT user_id, event_id, round(abs(sum(dv) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS peak FROM a)
SELECT user_id, event_id, round(peak, 4) AS peak FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY peak DESC, event_id) AS r FROM b) WHERE r = 1""")
def change_points(spark, d):
    return windows.change_point(table(spark, d, "events"), ["user_id"], "event_id", "value").withColumn("peak", F.round("peak", 4))


def _label_rows(spark, d):
    li = table(spark, d, "lineitem")
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    cell = lambda hit, gone: F.when(gone, F.lit("")).otherwise(F.when(hit, F.lit(" 1 ")).otherwise(F.lit("0.0")))
    cols = {c: cell(q % 8 == i, (q + i) % 11 == 0) for i, c in enumerate(K.LABEL_COLUMNS)}
    cols["label:LYING_DOWN"] = cell((q % 8 == 0) | (q % 8 == 3), q % 11 == 0)
    return li.select("l_orderkey", n.alias("l_linenumber"), *[v.alias(c) for c, v in cols.items()], cell(n == 1, F.lit(False)).alias("label:PHONE_IN_POCKET"), cell(n <= 2, F.lit(False)).alias("label:PHONE_IN_HAND"))


@query("""WITH x AS (SELECT row_number() OVER () AS rn, l_orderkey, l_linenumber, l_quantity::INT AS q FROM lineitem),
c AS (SELECT *, [CASE WHEN q % 11 = 0 THEN NULL ELSE (q % 8 IN (0, 3))::INT END, CASE WHEN (q+1) % 11 = 0 THEN NULL ELSE (q % 8 = 1)::INT END, CASE WHEN (q+2) % 11 = 0 THEN NULL ELSE (q % 8 = 2)::INT END, CASE WHEN (q+3) % 11 = 0 THEN NULL ELSE (q % 8 = 3)::INT END, CASE WHEN (q+4) % 11 = 0 THEN NULL ELSE (q % 8 = 4)::INT END, CASE WHEN (q+5) % 11 = 0 THEN NULL ELSE (q % 8 = 5)::INT END] AS v,
 ['lying down', 'sitting', 'standing in place', 'walking', 'running', 'bicycling'] AS nm FROM x),
k AS (SELECT rn, l_orderkey, l_linenumber, i, v[i] AS y, nm[i] AS n FROM c, (SELECT unnest(range(1, 7)) AS i))
SELECT l_orderkey, l_linenumber, CASE WHEN sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) = 1 THEN max(CASE WHEN y = 1 THEN n END) END AS label, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END)::INT AS n_positive, sum(CASE WHEN y IS NULL THEN 1 ELSE 0 END)::INT AS n_missing,
 CASE l_linenumber WHEN 2 THEN 'hand' ELSE 'unknown' END AS placement FROM k GROUP BY rn, l_orderkey, l_linenumber HAVING sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) > 0 OR sum(CASE WHEN y IS NULL THEN 1 ELSE 0 END) > 0""")
def label_resolution(spark, d):
    rows = _label_rows(spark, d)
    out = labels.resolve(rows).where("in_subset")
    return out.select("l_orderkey", "l_linenumber", "label", F.size("positive_labels").alias("n_positive"), F.size("missing_labels").alias("n_missing"), labels.placement(rows).alias("placement"))


@query("""WITH x AS (SELECT l_quantity::INT AS q FROM lineitem), f AS (SELECT CASE WHEN (q+2) % 11 <> 0 AND q % 8 = 2 THEN 1 ELSE 0 END AS st, ((q % 11 <> 0 AND q % 8 IN (0, 3))::INT + ((q+1) % 11 <> 0 AND q % 8 = 1)::INT + ((q+2) % 11 <> 0 AND q % 8 = 2)::INT + ((q+3) % 11 <> 0 AND q % 8 = 3)::INT + ((q+4) % 11 <> 0 AND q % 8 = 4)::INT + ((q+5) % 11 <> 0 AND q % 8 = 5)::INT) AS np,
 ((q % 11 = 0)::INT + ((q+1) % 11 = 0)::INT + ((q+2) % 11 = 0)::INT + ((q+3) % 11 = 0)::INT + ((q+4) % 11 = 0)::INT + ((q+5) % 11 = 0)::INT) AS nm FROM x)
SELECT name, count(*) AS n FROM (SELECT 'multi_label' AS name FROM f WHERE np > 1 UNION ALL SELECT 'unresolved_missing_label' FROM f WHERE np = 0 AND nm > 0 UNION ALL SELECT 'standing_split_unresolved' FROM f WHERE np = 1 AND st = 1) GROUP BY 1""")
def ingest_flags(spark, d):
    out = labels.resolve(_label_rows(spark, d)).where("in_subset")
    return rollup.ingest_summary(out).where("kind = 'flag'").select("name", "n")


@query(f"WITH {SEG} SELECT segment_id, uuid, label, t_start FROM seg WHERE uuid = 7 AND t_start >= epoch(TIMESTAMP '2024-01-05') AND t_start < epoch(TIMESTAMP '2024-01-21') ORDER BY t_start, segment_id LIMIT 50")
def timeline_page(spark, d):
    return store.page(segments(spark, d), 7, "2024-01-05", "2024-01-20", 50).select("segment_id", "uuid", "label", "t_start")


@query(f"WITH {SEG} SELECT uuid, segment_id, label, t_start FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY t_start DESC, segment_id DESC) AS r FROM seg) WHERE r = 1")
def latest_segment(spark, d):
    return store.latest(segments(spark, d), ["uuid"]).select("uuid", "segment_id", "label", "t_start")


@query(f"WITH {SEG}, a AS (SELECT uuid, label, round(sum(t_end - t_start), 3) AS s FROM seg GROUP BY ALL) SELECT uuid, label, s AS total_s FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY s DESC, label) AS r FROM a) WHERE r = 1")
def dominant_label(spark, d):
    s = segments(spark, d).groupBy("uuid", "label").agg(F.round(F.sum(F.col("t_end") - F.col("t_start")), 3).alias("total_s"))
    return s.withColumn("r", F.row_number().over(W.partitionBy("uuid").orderBy(F.desc("total_s"), "label"))).where("r = 1").drop("r")


@query("SELECT event_id, CASE WHEN value >= 75 THEN 'good' WHEN value >= 25 THEN 'partial' ELSE 'low' END AS bucket, CASE WHEN value <= 0 THEN 'error' WHEN value < 25 THEN 'warning' ELSE 'ok' END AS severity, strftime(ts, '%Y-%m-%d %H:%M:%S UTC') AS label FROM events")
def coverage_labels(spark, d):
    x = F.col("value") / 100
    return table(spark, d, "events").select("event_id", C.coverage_bucket(x).alias("bucket"), C.coverage_severity(x).alias("severity"), C.time_label(sec()).alias("label"))


@query("SELECT event_id, props->>'$.k' AS k, props IS NOT NULL AS has FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.col("props").isNotNull().alias("has"))


@query(f"WITH {SEG} SELECT segment_id, greatest(0.0, least(1.0, 1800.0/(t_end - t_start))) AS coverage FROM seg")
def coverage_scalar(spark, d):
    s = segments(spark, d)
    return s.select("segment_id", intervals.coverage_scalar(F.lit(1800.0), F.col("t_start"), F.col("t_end")).alias("coverage"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_extendedprice > 45000)::INT + (l_tax*200 > 8)::INT + (l_quantity*4 >= 135)::INT >= 2")
def running_override(spark, d):
    dbl = lambda c, k: F.col(c).cast("double") * k
    even = F.array(*[F.lit(1.0 / 7)] * 7)
    p = C.running_override(even, dbl("l_extendedprice", 1e-5), dbl("l_tax", 200.0), dbl("l_quantity", 4.0))
    return table(spark, d, "lineitem").withColumn("p", p).where(F.element_at("p", 6) == 1.0).select("l_orderkey", "l_linenumber")


@query()
def anchored_chunks(spark, d):
    t = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(sec())).alias("t"))
    return t.select("user_id", F.explode(windows.anchored_chunks(F.col("t"), 86400.0, 2)).alias("c")).select("user_id", "c.*")


@query()
def viterbi_states(spark, d):
    import numpy as np

    e = table(spark, d, "events").select("user_id", "event_id", F.array(*[F.when(F.col("event_type") == t, 0.6).otherwise(0.1) for t in TYPES]).alias("p"))
    a = np.full((5, 5), 0.1) + np.eye(5) * 0.5
    return decode.viterbi(e, ["user_id"], "event_id", "p", a, 3)


def _bursts(spark, d):
    return recognition.synthetic_bursts(table(spark, d, "events"))


def _days(spark, d):
    return recognition.synthetic_days(table(spark, d, "events"))


@query()
def burst_timeline(spark, d):
    return recognition.timeline(_days(spark, d), source=recognition.synthetic_signals)


@query()
def burst_windows(spark, d):
    return recognition.windows(_days(spark, d), source=recognition.synthetic_signals).drop("flags")


@query()
def forest_events(spark, d):
    s = _signature(spark, d).withColumn("cadence_bpm", F.lit(0.0))
    return analytics.forest_events(s)
