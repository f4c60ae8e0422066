"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosine, components.

Equal vectors of a label are one class.  Each table hashes a class by the signs of ``bits`` random
projections; classes of one label with equal code share a bucket.  Buckets above ``block_rows`` are cut into
blocks that are compared block by block, so no task holds more than two blocks.  Every comparison is a cosine
in double precision.  A pair that several tables bring together is counted in the first of them only, so link
counts need no list of pairs; for components each bucket gives a spanning forest of its links.

``bits`` follows the largest label's count (random neighbours in a bucket stay few at any size) and the
number of tables follows from ``bits``, so that a pair at the threshold is missed with probability ``miss``.

Rules for odd input: null labels, null or zero vectors and vectors with null, NaN or infinite components
link with nothing; vectors of different length do not link; rows with a null id are alone; of rows with
equal ids each counts as a vector of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm.common import cut, require
from kinetra.llm.graph import components


#: Unrelated vectors of a label that a bucket should hold: fewer bits need fewer tables, and comparing a few
#: dozen rows costs less than moving each through more tables.
BUCKET_ROWS = 32


def plan_tables(count: int, threshold: float, miss: float, most_tables: int = 512) -> tuple[int, int]:
    """``(bits, tables)`` for labels of up to ``count`` classes.  Where ``most_tables`` would not keep ``miss``,
    bits are given up: buckets grow and their blocks cost more comparisons, but no pair more is missed."""
    same = 1.0 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    bits = max(6, min(30, math.ceil(math.log2(max(2, count / BUCKET_ROWS)))))
    while True:
        hit = same**bits
        tables = 1 if hit >= 1 else max(1, math.ceil(math.log(miss) / math.log1p(-hit)))
        if tables <= most_tables or not bits:
            return bits, tables
        bits -= 1


def _join_up(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Lowers ``root`` to the smallest place that the links ``a``-``b`` and earlier ones reach."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])  # only roots are hooked
        while not np.array_equal(root, root[root]):
            root[:] = root[root]


def _codes(vectors: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """int32 codes ``(rows, tables)``."""
    rng = np.random.default_rng(seed)
    out = np.empty((len(vectors), tables), dtype=np.int32)
    powers = (1 << np.arange(bits)).astype(np.int64)
    for t in range(tables):
        out[:, t] = ((vectors @ rng.standard_normal((vectors.shape[1], bits)) >= 0) @ powers).astype(np.int32)
    return out


def _compare(batches: list[pa.RecordBatch], threshold: float, width: str) -> pa.RecordBatch:
    """Links inside the whole buckets of some batches: ``(id, links, root)`` of every row with a link."""
    t = pa.Table.from_batches(batches)
    ids, table, bucket, own, i, j, copies = (t.column(k).to_numpy() for k in ("id", "table", "bucket", "own", "i", "j", "copies"))
    raw, codes = t.column("v").to_pylist(), np.frombuffer(b"".join(t.column("codes").to_pylist()), "<i4").reshape(len(ids), -1)
    cuts = np.concatenate(([0], np.flatnonzero((bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1, [len(ids)]))
    dims = np.array([len(x) for x in raw])
    links, root = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))

    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if hi - lo < 2:
            continue
        for d in {int(d) for d in dims[lo:hi]}:
            at = lo + np.flatnonzero(dims[lo:hi] == d)
            x = np.frombuffer(b"".join([raw[k] for k in at]), width).astype(np.float64).reshape(len(at), -1)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
            for first in range(0, len(at), 256):
                near = x[first : first + 256] @ x.T >= threshold
                a, b = np.nonzero(near)
                later = b > a + first
                a, b = at[a[later] + first], at[b[later]]
                if i[lo] != j[lo]:  # pairs inside a block belong to its own task
                    apart = own[a] != own[b]
                    a, b = a[apart], b[apart]
                if table[lo] and len(a):  # counted where the pair met first
                    fresh = ~(codes[a, : table[lo]] == codes[b, : table[lo]]).any(axis=1)
                    a, b = a[fresh], b[fresh]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                own_root = root[lo:hi] - lo
                _join_up(own_root, a - lo, b - lo)
                root[lo:hi] = own_root + lo
    hit = np.flatnonzero(links)
    tops = root[hit]
    return pa.RecordBatch.from_arrays([pa.array(ids[hit], pa.int64()), pa.array(links[hit], pa.int64()), pa.array(ids[tops] if len(hit) else [], pa.int64())], names=["id", "links", "root"])


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, threshold: float = 0.93, miss: float = 1e-5, block_rows: int = 1024, seed: int = 17) -> DataFrame:
    """One row per input row: ``(id, n_links, component_id, kept)``."""
    require(rows, id_col, vector_col, label_col)
    v = F.col(vector_col).cast("array<double>")
    sound = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0), F.lit(False)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    # -0.0 and 0.0 are one value to the class key
    base = cut(rows.select(F.col(id_col).cast("long").alias("id"), F.when(sound, F.transform(v, lambda x: x + F.lit(0.0))).alias("v"), F.when(sound, F.col(label_col).cast("string")).alias("g")))
    keyed = base.where("v is not null").select("id", "g", F.md5(F.concat_ws(",", F.col("v").cast("array<string>")).cast("binary")).alias("key"), "v")
    classes = cut(keyed.groupBy("g", "key").agg(F.min(F.struct("id", "v")).alias("m"), F.count(F.lit(1)).alias("copies")).select("g", "key", "m.id", "m.v", "copies"))
    largest = classes.groupBy("g").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
    bits, tables = plan_tables(largest, threshold, miss)
    width = "<f4" if "array<float>" in dict(rows.dtypes)[vector_col] else "<f8"  # as the input has them

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1).to_pylist()
            packed, coded = [], []
            for x in lists:
                x = np.array(x, dtype=np.float64)
                packed.append(x.astype(width).tobytes())
                coded.append(x / max(np.abs(x).max(), 1e-300))
            by_dim: dict[int, list[int]] = {}
            for i, x in enumerate(coded):
                by_dim.setdefault(len(x), []).append(i)
            codes = np.empty((len(lists), tables), dtype=np.int32)
            for at in by_dim.values():
                codes[at] = _codes(np.stack([coded[i] for i in at]), bits, tables, seed)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary()), pa.array([c.astype("<i4").tobytes() for c in codes], pa.binary()), b.column(2)], names=["id", "v", "codes", "copies"])

    with_codes = cut(classes.select("id", "v", "copies").mapInArrow(hashed, "id long, v binary, codes binary, copies long").join(classes.select("id", "g"), "id"))
    spread = with_codes.select("id", "g", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.substring("codes", t * 4 + 1, F.lit(4)))).alias("t", "code")).select("id", F.col("t").alias("table"), F.xxhash64("g", "t", "code").alias("bucket"))
    sizes = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = spread.join(sizes, "bucket")
    # a bucket of several blocks: each row goes to every pair of blocks that holds its own
    n_blocks = F.ceil(F.col("size") / F.lit(block_rows)).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(3)), n_blocks).cast("int")
    tasks = members.select("id", "table", "bucket", own.alias("own"), F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("other"))
    tasks = tasks.select("id", "table", "bucket", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    # buckets are small: many of them go through one batch, sorted so that a bucket's rows lie together
    full = tasks.join(with_codes.select("id", "v", "codes", "copies"), "id").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            keys = np.stack([b.column(k).to_numpy() for k in (2, 4, 5)])
            cut_at = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            if held and b.num_rows and all(held[-1].column(k)[held[-1].num_rows - 1] == b.column(k)[0] for k in (2, 4, 5)):
                head = int(cut_at[0]) if len(cut_at) else b.num_rows
                held.append(b.slice(0, head))
                if head == b.num_rows:
                    continue
                yield _compare(held, threshold, width)
                held, b = [], b.slice(head)
                cut_at = cut_at[1:] - head
            elif held:
                yield _compare(held, threshold, width)
                held = []
            tail = int(cut_at[-1]) if len(cut_at) else 0
            if tail:
                yield _compare([b.slice(0, tail)], threshold, width)
            held = [b.slice(tail)] if b.num_rows > tail else []
        if held:
            yield _compare(held, threshold, width)

    found = cut(full.select("id", "table", "bucket", "own", "i", "j", "v", "codes", "copies").mapInArrow(run, "id long, links long, root long"))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    told = classes.select("g", "key", "id", "copies").join(counts, "id", "left").join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
    told = told.select("g", "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("root"))
    sided = keyed.select("id", "g", "key").join(told, ["g", "key"]).select("id", "n_links", "root")
    alone = base.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("root"))
    out = sided.union(alone)
    return out.select(F.col("id").alias(id_col), "n_links", F.col("root").alias("component_id"), F.coalesce(F.col("root") == F.col("id"), F.lit(True)).alias("kept"))
