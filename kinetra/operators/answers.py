"""Answers over the timeline: one small aggregate per question, coverage gate, rendering."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra import constants as K
from kinetra.operators import analytics, intervals
from kinetra.operators.router import Route, route


@dataclass
class Answer:
    route: str
    answer: str
    confidence: float = 0.0
    label: str | None = None
    t_start: float | None = None
    t_end: float | None = None
    segment_id: str | None = None
    coverage: float | None = None
    widened: bool = False
    details: dict = field(default_factory=dict)


def target(question: str) -> str | None:
    """The activity that a question names (plain substrings, in the order of the table)."""
    q = question.lower()
    return next((v for k, v in K.ALIASES.items() if k in q), None)


def _best(rows: DataFrame, by) -> dict | None:
    found = rows.agg(F.max_by(F.struct("segment_id", "label", "t_start", "t_end", "confidence"), by).alias("m")).first()
    return found["m"].asDict() if found and found["m"] is not None else None


def _span(row: dict) -> dict:
    return {k: row[k] for k in ("label", "t_start", "t_end", "segment_id")}


def look_up(rows: DataFrame, question: str) -> Answer:
    """Q4: whether the named activity occurs, with its longest segment; else the latest segment."""
    want = target(question)
    if want:
        own = rows.where(F.col("label") == want)
        n = own.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("t_end") - F.col("t_start")).alias("s")).first()
        if not n["n"]:
            return Answer("task1", f"No — {want} was not detected in the recording.", 0.85)
        seg = _best(own, F.col("t_end") - F.col("t_start"))
        return Answer("task1", f"Yes — {want} was detected ({n['s'] / 60:.1f} min total, {n['n']} segment(s)).", seg["confidence"], **_span(seg))
    seg = _best(rows, F.col("t_start"))
    return Answer("task1", f"Most recent activity: {seg['label']}.", seg["confidence"], **_span(seg)) if seg else Answer("task1", "No data available.")


def totals(rows: DataFrame, question: str) -> Answer:
    """Q5: data coverage, the named activity's total, or all totals."""
    q = question.lower()
    if any(w in q for w in ("data", "recording", "coverage", "dataset")):
        d = F.to_date(F.timestamp_seconds("t_start"))
        r = rows.agg(F.count_distinct(d).alias("n"), F.min(d).alias("a"), F.max(d).alias("b"), F.sum(F.col("t_end") - F.col("t_start")).alias("s")).first()
        return Answer("task2", f"{r['n']} day(s) of data, {r['a']} to {r['b']}, {(r['s'] or 0) / 3600:.1f} h.", 0.95) if r["n"] else Answer("task2", "No data available.")
    by = {r["label"]: r["s"] for r in rows.groupBy("label").agg(F.sum(F.col("t_end") - F.col("t_start")).alias("s")).collect()}  # one row per class
    want = target(question)
    if want:
        return Answer("task2", f"Total {want}: {by.get(want, 0.0) / 60:.1f} min.", 0.9, want)
    parts = [f"{k}: {v / 60:.1f} min" for k, v in sorted(by.items(), key=lambda x: (-x[1], x[0]))]
    return Answer("task2", "; ".join(parts) or "No data available.", 0.9, details=by)


def onset(rows: DataFrame, question: str) -> Answer:
    """Q6: prolonged periods by the longest segment (over 300 s likely, over 60 s possibly), else the first."""
    want = target(question)
    own = rows.where(F.col("label") == want) if want else rows
    if any(w in question.lower() for w in ("prolonged", "long period", "extended")):
        seg = _best(own, F.col("t_end") - F.col("t_start"))
        if seg is None:
            return Answer("task3", "No matching activity.")
        s = seg["t_end"] - seg["t_start"]
        verdict = "Likely yes" if s > 300 else "Possibly" if s > 60 else "Unlikely"
        return Answer("task3", f"{verdict} — longest {seg['label']}: {s:.0f} s.", seg["confidence"], **_span(seg))
    seg = _best(own, -F.col("t_start"))
    return Answer("task3", f"First {seg['label']} at {seg['t_start']:.0f} s.", seg["confidence"], **_span(seg)) if seg else Answer("task3", "No matching activity.")


def events(found: DataFrame) -> Answer:
    """Q7: the first ten events."""
    top = found.orderBy("t_start", "event_id").limit(10).collect()
    text = "; ".join(f"{r['method']} at {r['t_start']:.0f} s (score {r['score']:.2f})" for r in top)
    return Answer("b_anomaly", text or "No unusual events detected.", 0.9 if top else 0.8, t_start=top[0]["t_start"] if top else None, t_end=top[0]["t_end"] if top else None, segment_id=top[0]["segment_id"] if top else None)


def open_question(rows: DataFrame, bank: DataFrame | None = None, signatures: DataFrame | None = None) -> Answer:
    """Q9: dominant activity, narrated by its nearest exemplar where a bank and signatures are given."""
    top = rows.groupBy("label").agg(F.sum(F.col("t_end") - F.col("t_start")).alias("s")).orderBy(F.desc("s"), "label").limit(1).first()
    if top is None:
        return Answer("task4", "No data available.")
    seg = _best(rows.where(F.col("label") == top["label"]), F.col("t_end") - F.col("t_start"))
    text = f"Mostly {top['label']} ({top['s'] / 60:.1f} min)."
    if bank is not None and signatures is not None:
        near = analytics.nearest(signatures.where(F.col("segment_id") == seg["segment_id"]), bank.select("exemplar_id", "vector"), 1, query_id="segment_id", bank_id="exemplar_id", vector="vector").join(F.broadcast(bank.select("exemplar_id", "text")), "exemplar_id").first()
        text += f" {near['text']}" if near else ""
    return Answer("task4", text, seg["confidence"], **_span(seg))


def prompt(question: str, rows: DataFrame, exemplars: list[str]) -> str:
    """Q14: text for an optional narrator."""
    lines = [f"- {r['label']} {r['t_start']:.0f}-{r['t_end']:.0f} s" for r in rows.orderBy("t_start").limit(20).collect()]
    return "\n".join(["Question: " + question, "Timeline:", *lines, "Similar patterns:", *exemplars])


def gate(told: Answer, timeline: DataFrame, samples: DataFrame | None) -> Answer:
    """For gated routes with a cited segment the interval must be covered by signal; else the nearest
    covered probe replaces it, and without one the answer is withdrawn."""
    if told.route not in K.GATED_ROUTES or told.segment_id is None or samples is None:
        return told
    bounds = timeline.where(F.col("segment_id") == told.segment_id).select("uuid", F.col("t_start").alias("seg_lo"), F.col("t_end").alias("seg_hi"))
    evidence = bounds.select("uuid", F.lit(told.segment_id).alias("segment_id"), F.lit(float(told.t_start)).alias("t_start"), F.lit(float(told.t_end)).alias("t_end"), "seg_lo", "seg_hi")
    direct = intervals.coverage(evidence.select("uuid", F.col("t_start").alias("q0"), F.col("t_end").alias("q1")), samples, ["uuid"]).first()
    if direct is not None and direct["coverage"] > 0:
        told.coverage = direct["coverage"]
        return told
    hit = intervals.nearest_covered(evidence, samples, ["uuid"], "segment_id").first()
    if hit is None:
        return Answer(told.route, "Not answerable: no recorded signal covers this interval.", 0.0, coverage=0.0)
    told.t_start, told.t_end, told.coverage, told.widened = hit["q0"], hit["q1"], hit["coverage"], True
    return told


def render(told: Answer) -> str:
    """Q12/Q13."""
    from datetime import UTC, datetime

    lines = [told.answer, f"confidence: {told.confidence:.0%}"]
    if told.t_start is not None and told.t_end is not None:
        a, b = (datetime.fromtimestamp(x, UTC).strftime("%H:%M:%S") for x in (told.t_start, told.t_end))
        lines.append(f"evidence: {a} to {b} UTC" + (" (widened to the nearest covered time)" if told.widened else ""))
    if told.coverage is not None:
        lines.append(f"coverage: {told.coverage:.0%}")
    return "\n".join(lines)


def answer(question: str, timeline: DataFrame, found: DataFrame | None = None, samples: DataFrame | None = None, model=None, bank: DataFrame | None = None, signatures: DataFrame | None = None) -> Answer:
    """Q10: route, query, gate.  All rows of the timeline are looked at."""
    r: Route = route(question, model)
    if r.route == "task1":
        told = look_up(timeline, question)
    elif r.route == "task2":
        told = totals(timeline, question)
    elif r.route == "task3":
        told = onset(timeline, question)
    elif r.route == "b_energy":
        s = analytics.flat_energy(timeline).first()["kcal"]
        told = Answer("b_energy", f"About {s or 0.0:.0f} kcal.", 0.8)
    elif r.route == "b_anomaly" and found is not None:
        told = events(found)
    elif r.route == "personalization":
        told = Answer("personalization", "Profile changes are not kept here.", r.confidence)
    else:
        told = open_question(timeline, bank, signatures)
    return gate(told, timeline, samples)
