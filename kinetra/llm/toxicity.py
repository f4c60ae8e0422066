"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A document is a bag of sentences; a sentence's probability is a logistic function of the distinct subword
features of its words, and the document's is their noisy-or.  Weights are trained from document labels
through the noisy-or, so the sentences that carry the label can be pointed out afterwards.

Rules for odd input: null and empty text have no sentence and score 0; labels of null or of unknown
documents are not learned from, and of several labels of one document the highest counts; without both
classes to learn from, every score is 0.  Texts are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetra.llm.common import require, text_slices

PLACES = 1 << 20
#: Documents with at least this score count as toxic.
CUT = 0.7
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")
_TABLE = 400_000


def features(word: str) -> list[int]:
    """Hashed subword features of a lower-case word: itself, its beginnings, its inner five-grams."""
    found = {zlib.crc32(word.encode("utf-8", "surrogatepass"), 1) % PLACES}
    found.update(zlib.crc32(word[:n].encode("utf-8", "surrogatepass"), 2) % PLACES for n in (4, 5, 6) if len(word) >= n)
    found.update(zlib.crc32(word[i : i + 5].encode("utf-8", "surrogatepass"), 3) % PLACES for i in range(1, len(word) - 4))
    return list(found)


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of at most ``most_features`` features; the size does not depend on the corpus."""

    places: np.ndarray
    weights: np.ndarray
    bias: float

    def lookup(self) -> dict[int, float]:
        return dict(zip(self.places.tolist(), self.weights.tolist()))


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def train(bags: list[tuple[int, int, list[list[int]]]], count: int, start: np.ndarray, prior: float, rounds: int = 500, decay: float = 5e-6) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the noisy-or likelihood.

    ``bags``: label, number of sentences, and for each sentence with features their indices.  ``prior`` is
    the share of positives in the population; the classes are weighed to it.
    """
    label = np.array([y for y, _, _ in bags], dtype=np.float64)
    owner = np.array([d for d, (_, _, s) in enumerate(bags) for _ in s], dtype=np.int64)
    sent = np.array([k for k, x in enumerate(x for _, _, s in bags for x in s) for _ in x], dtype=np.int64)
    feat = np.array([f for _, _, s in bags for x in s for f in x], dtype=np.int64)
    bare = np.array([n - len(s) for _, n, s in bags], dtype=np.float64)
    share = max(label.mean(), 1e-9)
    weight = np.where(label == 1, prior / share, (1 - prior) / max(1 - share, 1e-9))
    weight /= weight.sum()
    w, b = start.copy(), -7.0
    m, v = np.zeros(count + 1), np.zeros(count + 1)
    for t in range(1, rounds + 1):
        z = b + np.bincount(sent, w[feat], len(owner)) if len(owner) else np.zeros(0)
        p, p0 = _sigmoid(z), float(_sigmoid(b))
        none = -(np.bincount(owner, np.logaddexp(0, z), len(bags)) if len(owner) else 0) - bare * np.logaddexp(0, b)
        some = -np.expm1(none)
        pull = weight * np.where(label == 1, -np.exp(none) / np.maximum(some, 1e-9), 1.0)
        each = p * pull[owner] if len(owner) else p
        grad = np.empty(count + 1)
        grad[:count] = np.bincount(feat, each[sent], count) + decay * w if len(feat) else decay * w
        grad[count] = each.sum() + (pull * bare).sum() * p0
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= step[:count]
        b -= float(step[count])
    return w, b


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, per_label: int = 4000, most_features: int = 8192) -> ToxicityModel:
    """Fits on a bounded sample: about ``per_label`` documents of each class among rows where ``learn``
    (over the id column) holds, chosen by a hash of the id.  The driver receives sums per feature and the
    sampled documents' selected features, never text.
    """
    require(docs, id_col, text_col)
    require(labels, id_col, label_col)
    nothing = ToxicityModel(np.empty(0, np.int64), np.empty(0), -60.0)
    known = labels.where(learn & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("k")).agg(F.max(label_col).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return nothing
    place = F.pmod(F.xxhash64("k", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.when(F.col("y") == 1, F.lit(min(1.0, per_label / counts[1]))).otherwise(F.lit(min(1.0, per_label / counts[0])))
    sample = F.broadcast(known.where(place < rate))  # about 2 * per_label rows at most
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(sample, "k").select("t", "y")

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, PLACES), dtype=np.int64)
        for part, texts in text_slices(batches, "t"):
            for text, y in zip(texts, part.column(1).to_pylist()):
                words = set(_WORD.findall((text or "").lower()))
                held[y, np.array(sorted({f for w in words for f in features(w)}), dtype=np.int64)] += 1
        at = np.flatnonzero(held[1])
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[1, at], pa.int64()), pa.array(held[0, at], pa.int64())], names=["f", "pos", "neg"])

    n1, n0 = float(min(per_label, counts[1])), float(min(per_label, counts[0]))
    totals = rows.mapInArrow(sums, "f long, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    a, b = (F.col("pos") + 0.5) / F.lit(n1 + 1), (F.col("neg") + 0.5) / F.lit(n0 + 1)
    top = totals.where("pos >= 2").withColumn("odds", F.log(a / b)).where("odds > 0.7").withColumn("gain", F.col("pos") * F.col("odds")).orderBy(F.desc("gain"), "f").limit(most_features).collect()
    if not top:
        return nothing
    places = np.array([r["f"] for r in top], dtype=np.int64)
    start = np.array([0.25 * r["odds"] for r in top])
    index = {int(f): i for i, f in enumerate(places)}

    def bagged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, list[int]] = {}
        for part, texts in text_slices(batches, "t"):
            out = []
            for text in texts:
                found, n = [], 0
                for piece in _SENTENCE.findall((text or "").lower()):
                    words = set(_WORD.findall(piece))
                    if not words:
                        continue
                    n += 1
                    own: set[int] = set()
                    for w in words:
                        if w not in table:
                            if len(table) > _TABLE:
                                table.clear()
                            table[w] = [index[f] for f in features(w) if f in index]
                        own.update(table[w])
                    if own:
                        found.append(sorted(own))
                flat = [n, *(x for s in found for x in (len(s), *s))]
                out.append(np.array(flat, dtype=np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(out, pa.binary())], names=["y", "b"])

    bags = []
    for r in rows.mapInArrow(bagged, "y int, b binary").collect():
        flat, at, found = np.frombuffer(bytes(r["b"]), np.int32), 1, []
        while at < len(flat):
            found.append(flat[at + 1 : at + 1 + flat[at]].tolist())
            at += 1 + int(flat[at])
        bags.append((r["y"], int(flat[0]), found))
    bags.sort(key=repr)
    weights, bias = train(bags, len(places), start, counts[1] / (counts[0] + counts[1]))
    return ToxicityModel(places, weights, bias)


def sentence_scores(text: str | None, model: ToxicityModel, table: dict[str, float] | None = None) -> list[tuple[int, int, float]]:
    """``(start, end, probability)`` of every sentence with a word, in order."""
    known = model.lookup()
    out = []
    for hit in _SENTENCE.finditer(text or ""):
        words = set(_WORD.findall(hit[0].lower()))
        if words:
            own = {f for w in words for f in features(w) if f in known}
            out.append((hit.start(), hit.end(), float(_sigmoid(model.bias + sum(known[f] for f in own)))))
    return out


def score(docs: DataFrame, model: ToxicityModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns with ``score`` and the most toxic sentence's bounds and probability (null without one)."""
    require(docs, text_col, *keep)
    slim = docs.select(*keep, F.col(text_col).alias("__text"))
    handle = docs.sparkSession.sparkContext.broadcast(model)  # bounded by most_features
    types = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    ddl = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "score double, top_start int, top_end int, top_score double"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = handle.value
        known, floor = m.lookup(), float(np.logaddexp(0, m.bias))
        table: dict[str, list[int]] = {}
        for part, texts in text_slices(batches, "__text"):
            rows = []
            for text in texts:
                low = (text or "").lower()
                words = set(_WORD.findall(low))
                for w in words.difference(table):
                    if len(table) > _TABLE:
                        table.clear()
                    table[w] = [f for f in features(w) if f in known]
                hot = {w: own for w in words if (own := table[w] if w in table else [f for f in features(w) if f in known])}
                none, top = 0.0, (None, None, None)
                if not words:
                    rows.append((0.0, *top))
                    continue
                same = len(low) == len(text)  # else lower-casing moved offsets, and sentences are lowered one by one
                if not hot and same:
                    n = sum(1 for piece in _SENTENCE.findall(low) if _WORD.search(piece))
                    rows.append((float(-np.expm1(-n * floor)), *top))
                    continue
                for hit in _SENTENCE.finditer(text):
                    piece = low[hit.start() : hit.end()] if same else hit[0].lower()
                    found = set(_WORD.findall(piece))
                    if not found:
                        continue
                    own = {f for w in found if w in hot for f in hot[w]}
                    z = m.bias + sum(known[f] for f in own)
                    none += float(np.logaddexp(0, z))
                    if own and (top[2] is None or z > top[2]):
                        top = (hit.start(), hit.end(), z)
                rows.append((float(-np.expm1(-none)), top[0], top[1], None if top[2] is None else float(_sigmoid(top[2]))))
            own_columns = [part.column(part.schema.get_field_index(c)) for c in keep]
            made = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([*own_columns, pa.array(made[0], pa.float64()), pa.array(made[1], pa.int32()), pa.array(made[2], pa.int32()), pa.array(made[3], pa.float64())], names=[*keep, "score", "top_start", "top_end", "top_score"])

    return slim.mapInArrow(run, ddl)
