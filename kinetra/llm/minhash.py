"""Near-duplicate documents: MinHash signatures in an LSH forest, exact confirmation, components.

Every distinct shingle set gets a signature.  Each of ``trees`` orders sorts the documents by its own ``depth``
values of the signature; documents that share the first ``base`` of them form a region of that order.  Depth
adapts to the region: one with more than ``region_rows`` members is split by longer common prefixes, and as a
longer prefix agrees less often, its members also enter further orders, as many as keep the miss of a pair at
the threshold where ``trees`` at depth ``base`` have it (``trees_at``).

Candidates are neighbours in the sorted orders, which share the longest common prefixes: a document is compared
with the ``NEAR`` ones before it in its region, in the first ``ORDERS`` orders that bring it a like one, and
with the likest hub, the member of a region that has most prefix neighbours in all orders.  When
these links are joined into components, the pairs of a region that still lie in different components and whose
sketches agree well enough are compared too.  A region that is large at full depth is cut into blocks, others
in each order, for neighbours and pairs, so no task holds it.  Every link is
confirmed on the full sets, in exact integer arithmetic.

Rules for odd input: equal sets are one class from the start, whatever their number; null text and text
without words have an empty set and stay alone; fewer words than the width give one shingle; rows with a
null id stay alone and kept; repeated ids count as the same document; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetra.llm import shingles as S
from kinetra.llm.common import cut, require, text_slices
from kinetra.llm.graph import components

#: Ids up to this number (8 bytes each) may be broadcast to thin out a scan; more are joined instead.
BROADCAST_IDS = 1_000_000
#: MinHash values behind a sketch, two bits of each; they sit in ``SKETCH / 32`` signed 64-bit columns.
SKETCH = 512
#: Neighbours before a document that are looked at in a sorted order, and orders that give it candidates.
NEAR, ORDERS = 2, 3
_LANES = tuple(f"q{i}" for i in range(SKETCH // 32))


def _sketches(values: np.ndarray) -> np.ndarray:
    """Two bits of each value of ``(rows, SKETCH)``, as ``(rows, SKETCH / 32)`` signed integers."""
    two = (values & np.uint32(3)).astype(np.uint64).reshape(len(values), -1, 32)
    return (two << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=2, dtype=np.uint64).view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, values: int) -> DataFrame:
    """Rows ``(id, n, d1, d2, sig, q0..)``: set size, 128-bit digest of the set, the low 16 bits of the first
    ``values`` MinHash values, and the sketch of all of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "t"):
            sets = S.shingle_sets(texts, width)
            digests = [S.set_digest(s) for s in sets]
            minima = np.stack([S.signature(s, SKETCH) if len(s) else np.zeros(SKETCH, np.uint32) for s in sets])
            packed = [m[:values].astype(np.uint16).tobytes() if len(s) else None for m, s in zip(minima, sets)]
            lanes = _sketches(minima)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array(packed, pa.binary()), *(pa.array(lanes[:, i], pa.int64()) for i in range(len(_LANES)))],
                names=["id", "n", "d1", "d2", "sig", *_LANES],
            )

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return slim.mapInArrow(run, "id long, n long, d1 long, d2 long, sig binary, " + ", ".join(f"{q} long" for q in _LANES))


def _agreeing(a: str, b: str) -> Column:
    """Number of the sketch places at which two rows agree."""
    bits = None
    for q in _LANES:
        x = F.col(f"{a}.{q}").bitwiseXOR(F.col(f"{b}.{q}"))
        off = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
        bits = off if bits is None else bits + off
    return F.lit(SKETCH) - bits


def least_agreeing(num: int, den: int, miss: float = 1e-5) -> int:
    """Places that must agree so that a pair at the threshold is missed with probability ``miss`` at most."""
    p = num / den + (1 - num / den) / 4
    below = 0.0
    for k in range(SKETCH + 1):
        below += math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
        if below > miss:
            return k
    return SKETCH


def trees_at(depth: int, num: int, den: int, trees: int, base: int) -> int:
    """Trees that miss a pair at the threshold by prefixes of ``depth`` no more often than ``trees`` by prefixes
    of ``base``; no more than the sketch has values for."""
    j = num / den
    return trees if depth <= base or j >= 1 else min(SKETCH // depth, math.ceil(trees * math.log1p(-(j**base)) / math.log1p(-(j**depth)) - 1e-9))


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is among ``ids``, a written table; broadcast where its counted size allows."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def confirm(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets satisfy ``den * intersection >= num * union``."""
    ids = cut(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    texts = _only(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")), ids).dropDuplicates(["id"])
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for part, firsts in text_slices(batches, "ta"):
            a, b, seconds = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist()
            ok = []
            for x, tx, y, ty in zip(S.shingle_sets(firsts, width), firsts, b, seconds):
                if y not in held:
                    if len(held) >= 4:
                        held.clear()
                    held[y] = S.shingle_set(ty, width)
                z = held[y]
                common = S.overlap(x, z)
                ok.append(common > 0 and den * common >= num * (len(x) + len(z) - common))
            keep = [i for i, k in enumerate(ok) if k]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _regions(reps: DataFrame, longer: Callable[[DataFrame], DataFrame], counts: list[int], depth: int, base: int, region_rows: int) -> DataFrame:
    """``(region, size, blocks, block, id, tree, key)``: regions of every order after splitting, with the sort
    key inside; a region that is still large has several blocks, others in each order.

    ``counts``: orders at each depth from ``base`` on.  Whoever is in a region to be split enters the orders
    that are new at the next depth, so a pair that no settled region holds meets all of that depth's orders.
    Signatures in ``reps`` reach as far as the first orders; ``longer`` gives those of a table of ids whole.
    """

    def keyed(rows: DataFrame, first: int, last: int) -> DataFrame:
        """``(id, tree, key)`` for the orders from ``first`` to before ``last``."""
        key = F.substring("sig", F.col("tree") * (2 * depth) + 1, F.lit(2 * depth))
        return rows.select("id", "sig", F.explode(F.sequence(F.lit(first), F.lit(last - 1))).alias("tree")).select("id", "tree", key.alias("key"))

    def dealt(rows: DataFrame, d: int) -> DataFrame:
        return rows.withColumn("region", F.xxhash64("tree", F.substring("key", 1, 2 * d)))

    def shared(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("region").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        return cut(rows.join(sizes, "region").select("region", "size", "id", "tree", "key"))

    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    now = shared(dealt(keyed(reps, 0, counts[0]), base))
    done, pending, d = now.where(F.col("size") <= region_rows), now.where(F.col("size") > region_rows), base
    while d < depth and not pending.isEmpty():
        if d == base:
            deep = cut(longer(cut(pending.select("id").distinct())))
        d += 1
        old, now_trees = counts[d - 1 - base], counts[d - base]
        rows = pending.select("id", "tree", "key")  # the keys of orders entered before are whole already
        if now_trees > old:
            rows = rows.union(keyed(pending.select("id").distinct().join(deep, "id"), old, now_trees))
        now = shared(dealt(rows.coalesce(parts), d))
        done = done.union(now if d == depth else now.where(F.col("size") <= region_rows))
        pending = now.where(F.col("size") > region_rows)
    done = done.coalesce(parts)  # the levels' parts add up
    blocks = F.ceil(F.col("size") / F.lit(float(region_rows))).cast("int")
    return done.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id", "tree"), F.col("blocks")).cast("int"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, num: int = 85, den: int = 100, trees: int = 16, base: int = 4, depth: int = 8, region_rows: int = 512) -> DataFrame:
    """One row per input row: ``(id, n_shingles, component_id, kept)``."""
    require(docs, id_col, text_col)
    if trees * depth > SKETCH:
        raise ValueError(f"trees * depth must not exceed {SKETCH}")
    counts = [trees_at(d, num, den, trees, base) for d in range(base, depth + 1)]
    all_rows = cut(signatures(docs, id_col, text_col, width, trees * depth))
    classes = all_rows.where("n > 0 and id is not null").groupBy("d1", "d2").agg(F.min(F.struct("id", "n", "sig", *_LANES)).alias("r"))
    reps = cut(classes.select("d1", "d2", "r.*"))

    def longer(ids: DataFrame) -> DataFrame:
        texts = _only(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")), ids)
        return signatures(texts, "id", "t", width, max(counts) * depth).where("n > 0").select("id", "sig").distinct()

    split = _regions(reps.select("id", "sig"), longer, counts, depth, base, region_rows)
    weight = split.groupBy("id").agg(F.sum("size").alias("w"))
    info = cut(weight.join(reps.select("id", "n", *_LANES), "id"))
    enough = least_agreeing(num, den)

    def long_enough(a: str, b: str) -> Column:
        return F.lit(den) * F.least(F.col(f"{a}.n"), F.col(f"{b}.n")) >= F.lit(num) * F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n"))

    def in_blocks(rows: DataFrame) -> DataFrame:
        """Rows of a region, once for each of its blocks."""
        return rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    # sorted orders: the documents just before one share the longest prefixes with it
    # the further orders of split regions are for the pairs below, these rows would only repeat there
    members = split.where(F.col("tree") < trees).join(info, "id").select("region", "blocks", "block", "tree", "key", F.struct("id", "n", "w", *_LANES).alias("x"))
    hubs = in_blocks(members.groupBy("region", "blocks").agg(F.max(F.struct("x.w", (-F.col("x.id")).alias("neg"), "x")).alias("h")).select("region", "blocks", F.col("h.x").alias("hub")))
    order = W.partitionBy("region", "block").orderBy("key", "x.id")
    names = [f"y{k}" for k in range(1, NEAR + 1)]
    before = members.drop("blocks").join(hubs, ["region", "block"]).select("tree", "x", "hub", *(F.lag("x", k).over(order).alias(y) for k, y in enumerate(names, 1)))
    told = [F.struct(F.col(f"{y}.id").alias("b"), F.when((F.col("x.id") != F.col(f"{y}.id")) & long_enough("x", y), _agreeing("x", y)).alias("s"), F.col(f"{y}.w").alias("w"), F.lit(y == "hub").alias("star")) for y in (*names, "hub")]
    pairs = before.select("tree", F.col("x.id").alias("a"), F.explode(F.array(*told)).alias("o")).select("tree", "a", "o.*").where(F.col("s") >= enough)
    near = F.collect_set(F.when(~F.col("star"), F.struct("tree", "b")))  # ``NEAR`` for each order at most
    star = F.max(F.when(F.col("star"), F.struct("s", "w", (-F.col("b")).alias("neg"))))
    best = pairs.groupBy("a").agg(near.alias("near"), star.alias("star"))
    best = best.select("a", F.explode(F.concat(F.transform(F.slice(F.array_sort("near"), 1, ORDERS), lambda m: m["b"]), F.filter(F.array(-F.col("star.neg")), lambda b: b.isNotNull()))).alias("b"))
    tried = cut(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = cut(confirm(tried, docs, id_col, text_col, width, num, den))
    joined = components(links)

    inside = cut(split.join(joined.select(F.col("node").alias("id"), "root"), "id", "left").select("region", "blocks", "block", "id", F.coalesce("root", "id").alias("root")))
    held = inside.groupBy("region", "blocks", "root").agg(F.count(F.lit(1)).alias("c"))
    main = held.groupBy("region", "blocks").agg(F.max(F.struct("c", "root")).alias("m"), F.count(F.lit(1)).alias("k")).where("k > 1").select("region", "blocks", F.col("m.root").alias("main"))
    places = inside.groupBy("id").agg(F.collect_set("region").alias("places"))  # one for each tree at most
    mixed = cut(inside.join(in_blocks(main), ["region", "block"]).join(info.select("id", "n", *_LANES), "id").join(places, "id"))
    once = F.col("x.region") == F.array_min(F.array_intersect("x.places", "y.places"))
    minor = mixed.where("root <> main")
    every = in_blocks(mixed.drop("block"))
    across = minor.alias("x").join(every.alias("y"), (F.col("x.region") == F.col("y.region")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.main")) | (F.col("x.id") < F.col("y.id"))) & long_enough("x", "y") & (_agreeing("x", "y") >= F.lit(enough)) & once)
    more = across.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    more = cut(more.join(tried, ["a", "b"], "left_anti"))
    found = links if more.isEmpty() else links.union(cut(confirm(more, docs, id_col, text_col, width, num, den)))
    roots = components(found)

    named = reps.select("d1", "d2", F.col("id").alias("rep")).join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("d1", "d2", F.coalesce("root", "rep").alias("root"))
    out = all_rows.select("id", "n", "d1", "d2").join(named, ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("root", "id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
