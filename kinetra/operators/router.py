"""Question routing: ordered patterns, an optional model behind them, arbitration."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinetra import constants as K

KNOWN = ("task1", "task2", "task3", "task4", "b_energy", "b_anomaly", "personalization")


@dataclass(frozen=True)
class Route:
    route: str
    confidence: float
    pattern: str | None
    by: str


def clean(q: Column) -> Column:
    return F.trim(F.regexp_replace(q, r"\s+", " "))


def route_columns(question: Column, rules: Sequence[tuple[str, str, float]] = K.ROUTES) -> dict[str, Column]:
    """Q1: route, confidence and rule number of the first pattern that matches; unknown, 0 and null else."""
    q = clean(question)
    route, conf, number = F, F, F
    for i, (p, name, c) in enumerate(rules):
        hit = q.rlike("(?i)" + p)
        route, conf, number = route.when(hit, F.lit(name)), conf.when(hit, F.lit(c)), number.when(hit, F.lit(i))
    return {"route": route.otherwise("unknown"), "confidence": conf.otherwise(F.lit(0.0)), "rule": number}


def route(question: str, model: Callable[[str], str] | None = None, rules: Sequence[tuple[str, str, float]] = K.ROUTES, extra: Sequence[tuple[str, str, float]] = ()) -> Route:
    """Q1-Q3 for one question.  The model (Q2) is asked only if no rule is sure; its answer wins where it is
    at least as confident.  A model that fails counts as none."""
    text = re.sub(r"\s+", " ", question).strip()
    rule = next((Route(r, c, p, "rule") for p, r, c in [*extra, *rules] if re.search(p, text, re.I)), None)
    if rule and rule.confidence >= K.ROUTE_THRESHOLD or model is None:
        return rule or Route("unknown", 0.0, None, "rule")
    try:
        said = re.findall(r"\w+", model(text).lower())
    except Exception:  # an optional model must not take the rules down
        return rule or Route("unknown", 0.0, None, "rule")
    found = next((w for w in said if w in KNOWN), None)
    told = Route(found or "unknown", K.MODEL_KNOWN if found else K.MODEL_UNKNOWN, None, "model")
    return told if rule is None or told.confidence >= rule.confidence else rule
