"""Language identification by string kernels.

Documents are compared by a *blended-spectrum presence kernel*: the number of distinct character n-grams
(n = 1..``max_n``, hashed to ``2**bits`` places) that two texts share, divided by the geometric mean of
their own numbers.  A bounded set of training documents serves as Nystroem landmarks; kernel ridge
regression, one language against the rest, is fitted in the landmarks' feature space, and documents are
scored by two matrix products per batch (presence x landmarks, kernel x coefficients).

Rules for odd input: null text and text without any letter give ``und`` with score 0; rows of training
data without language are not learned from; if no row can be learned from, every document is ``und``.
Texts are read whole, block by block.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetra.llm.common import require, text_slices

UNDETERMINED = "und"
_BLOCK = 1 << 16
_U32 = np.uint32


@dataclass(frozen=True)
class LanguageModel:
    """Fitted model: bounded by landmarks x places, whatever the corpus size."""

    labels: tuple[str, ...]
    landmarks: np.ndarray  # (m, 2**bits) float32, rows scaled to unit norm
    weights: np.ndarray  # (m, labels) float32
    bits: int
    max_n: int
    sharpness: float


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)], dtype=bool)


def presence(text: str, bits: int, max_n: int, out: np.ndarray) -> bool:
    """Sets ``out`` to 1 at the places of the text's n-grams; tells whether the text has a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    lettered = False
    for at in range(0, len(codes), _BLOCK):
        part = codes[at : at + _BLOCK + max_n - 1]
        lettered = lettered or bool(_letters()[part].any())
        spread = (part + _U32(1)) * _U32(0x9E3779B1)
        run = np.zeros(len(part), dtype=np.uint32)
        for n in range(1, max_n + 1):
            run = run[: len(part) - n + 1] * _U32(0x01000193) if n > 1 else run
            if not len(run):
                break
            run = run ^ spread[n - 1 :]
            mixed = (run ^ (run >> _U32(15))) * _U32(0x85EBCA6B)
            out[(mixed >> _U32(32 - bits))] = 1
    return lettered


def _scored(batches: Iterable[pa.RecordBatch], model: LanguageModel, text: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    dim = 1 << model.bits
    board = np.zeros((128, dim), dtype=np.float32)
    for part, texts in text_slices(batches, text):
        names, scores = [], []
        for at in range(0, len(texts), len(board)):
            some = texts[at : at + len(board)]
            grid = board[: len(some)]
            grid[:] = 0
            known = np.array([bool(x) and presence(x, model.bits, model.max_n, grid[i]) for i, x in enumerate(some)], dtype=bool)
            norm = np.sqrt(np.maximum(grid.sum(axis=1, keepdims=True), 1))
            kernel = (grid @ model.landmarks.T) / norm
            raw = (kernel @ model.weights).astype(np.float64) * model.sharpness
            raw = np.exp(raw - raw.max(axis=1, keepdims=True)) if raw.shape[1] else np.zeros((len(some), 1))
            share = raw / np.maximum(raw.sum(axis=1, keepdims=True), 1e-300)
            best = share.argmax(axis=1)
            known &= bool(model.labels)
            names += [model.labels[b] if k else UNDETERMINED for b, k in zip(best, known)]
            scores += [float(share[i, b]) if k else 0.0 for i, (b, k) in enumerate(zip(best, known))]
        columns = [part.column(part.schema.get_field_index(f)) for f in schema.names[:-2]]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=schema)


def _unit_maps(packed: list[bytes]) -> np.ndarray:
    """Rows of presence maps, scaled to unit norm."""
    x = np.stack([np.unpackbits(np.frombuffer(m, np.uint8)) for m in packed]).astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, per_label: int = 256, landmarks: int = 96, bits: int = 15, max_n: int = 3, ridge: float = 1e-2, sharpness: float = 6.0, most_rows: int = 16384) -> LanguageModel:
    """Fits on a bounded sample of the rows where ``learn`` holds, chosen by a hash of the id: ``per_label``
    documents of every language, fewer of each if that makes more than ``most_rows`` (one at least, so no
    language is left out).  What reaches the driver is a packed presence map per sampled document
    (``2**bits / 8`` bytes), never text; the maps are unpacked a few hundred at a time.
    """
    require(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), F.col(lang_col).alias("g")).where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = rows.groupBy("g").count().collect()  # one row per language
    if not counts:
        return LanguageModel((), np.zeros((0, 1 << bits), np.float32), np.zeros((0, 0), np.float32), bits, max_n, sharpness)
    per_label = max(1, min(per_label, most_rows // len(counts)))
    share = {r["g"]: min(1.0, (1.5 * per_label + 8) / r["count"]) for r in counts}
    place = F.pmod(F.xxhash64(F.col("k"), F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rates = F.create_map(*[x for g, s in share.items() for x in (F.lit(g), F.lit(s))])
    sample = rows.where(place < F.coalesce(rates[F.col("g")], F.lit(0.0))).select("g", "t", place.alias("u"))

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "t"):
            maps = []
            for x in texts:
                grid = np.zeros(1 << bits, dtype=np.uint8)
                maps.append(np.packbits(grid).tobytes() if presence(x, bits, max_n, grid) else None)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(maps, pa.binary())], names=["g", "u", "m"])

    taken: dict[str, list] = {}
    for r in sample.mapInArrow(packed, "g string, u double, m binary").where("m is not null").collect():
        taken.setdefault(r["g"], []).append((r["u"], bytes(r["m"])))
    labels = tuple(sorted(taken))
    chosen = [(g, m) for g in labels for _, m in sorted(taken[g])[:per_label]]
    if not chosen:
        return LanguageModel((), np.zeros((0, 1 << bits), np.float32), np.zeros((0, 0), np.float32), bits, max_n, sharpness)
    y = np.where(np.array([[g == c for c in labels] for g, _ in chosen]), 1.0, -1.0)
    each = max(1, landmarks // len(labels))  # landmarks are spread over the languages
    firsts = {g: i for i, (g, _) in reversed(list(enumerate(chosen)))}
    marks = _unit_maps([chosen[i][1] for g in labels for i in range(firsts[g], firsts[g] + min(each, len(taken[g]), per_label))])
    k_mm = (marks @ marks.T).astype(np.float64)
    k_nm = np.concatenate([_unit_maps([m for _, m in chosen[at : at + 256]]) @ marks.T for at in range(0, len(chosen), 256)]).astype(np.float64)
    values, vectors = np.linalg.eigh(k_mm)
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])  # Nystroem feature map
    z = k_nm @ whiten
    balance = np.array([1.0 / len(taken[g]) for g, _ in chosen])
    balance = balance[:, None] * (len(chosen) / balance.sum())
    w = np.linalg.solve((z * balance).T @ z + ridge * len(chosen) * np.eye(z.shape[1]), (z * balance).T @ y)
    return LanguageModel(labels, marks, (whiten @ w).astype(np.float32), bits, max_n, sharpness)


def predict(docs: DataFrame, model: LanguageModel, keep: list[str], text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``keep`` columns with the predicted language and a score in [0, 1] for every row."""
    require(docs, text_col, *keep)
    slim = docs.select(*keep, F.col(text_col).alias("__text"))
    types = {f.name: f for f in slim.schema.fields}
    handle = docs.sparkSession.sparkContext.broadcast(model)  # bounded by landmarks x places
    ddl = ", ".join([*(f"`{c}` {types[c].dataType.simpleString()}" for c in keep), f"`{lang_out}` string", f"`{score_out}` double"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            if schema is None:
                schema = pa.schema([*(batch.schema.field(c) for c in keep), pa.field(lang_out, pa.string()), pa.field(score_out, pa.float64())])
            yield from _scored([batch], handle.value, "__text", schema)

    return slim.mapInArrow(run, ddl)
