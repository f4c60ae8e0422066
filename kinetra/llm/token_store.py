"""Token-id files with a minimal perfect hash index.

A store is a folder of Parquet files written by Spark, so it may lie in any file system Spark can write and
failed tasks leave nothing behind.  Each row is one *block*: consecutive documents in ascending order of
their keys, with

* ``payload``: the raw ids of all its documents, little-endian, 2 or 4 bytes each (``width``),
* ``keys``: int64 keys in order, ``valid``: one byte each, 0 for a null key, ``offsets``: int64 id offsets
  of the documents, one more than documents,
* ``seeds``, ``prints``, ``slots``: the index of the block's distinct keys: a key's bucket names a seed,
  the seed its slot, the slot a 32-bit fingerprint of the key and the document's position,
* ``part``, ``block``, ``n_docs``, ``n_ids``, ``before`` (ids of the same part's earlier blocks), ``lo``, ``hi``.

Null keys come first and can only be read in order; of repeated keys the index finds the first.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetra.llm.common import require, text_slices
from kinetra.llm.shingles import mix64

_U = np.uint64
#: Ids in a block (a longer document has a block of its own).
BLOCK_IDS = 1 << 20
_FIELDS = [("part", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("before", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("width", pa.int32()), *((n, pa.binary()) for n in ("keys", "valid", "offsets", "seeds", "prints", "slots", "payload"))]
BLOCK_DDL = "part int, block int, n_docs long, n_ids long, before long, lo long, hi long, width int, keys binary, valid binary, offsets binary, seeds binary, prints binary, slots binary, payload binary"


def _spread(keys: np.ndarray) -> np.ndarray:
    return mix64(keys.astype(np.int64).view(np.uint64) + _U(0x9E3779B97F4A7C15))


def _place(mixed: np.ndarray, seed, n: int) -> np.ndarray:
    return mix64(mixed ^ (np.asarray(seed, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))) % _U(n)


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimal perfect hash of distinct int64 keys: ``(seeds, prints, slots)``.

    Buckets of about three keys are placed in falling order of size; a seed moves all keys of a bucket to
    free slots.  A bucket of one key stores its slot itself, as ``-slot - 1``.
    """
    n = len(keys)
    seeds = np.zeros(max(1, n // 3), dtype=np.int32)
    prints, slots = np.zeros(n, dtype=np.uint32), np.zeros(n, dtype=np.uint32)
    if not n:
        return seeds, prints, slots
    mixed = _spread(keys)
    bucket = ((mixed >> _U(33)) % _U(len(seeds))).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(len(seeds) + 1))
    free, slot_of = np.ones(n, dtype=bool), np.zeros(n, dtype=np.int64)
    sizes = np.diff(edges)
    for b in np.argsort(-sizes, kind="stable"):
        own = order[edges[b] : edges[b + 1]]
        if len(own) < 2:
            break
        seed = 1
        while True:  # tried in groups
            tries = np.arange(seed, seed + 16)
            at = _place(mixed[own][None, :], tries[:, None], n).astype(np.int64)
            good = free[at].all(axis=1)
            if len(own) > 1:
                ranked = np.sort(at, axis=1)
                good &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            hit = np.flatnonzero(good)
            if len(hit):
                at = at[hit[0]]
                seeds[b] = tries[hit[0]]
                break
            seed += 16
        free[at] = False
        slot_of[own] = at
    left = np.flatnonzero(free)
    single = np.flatnonzero(sizes == 1)
    owners = order[edges[single]]
    slot_of[owners] = left
    seeds[single] = -left - 1
    prints[slot_of] = (mixed & _U(0xFFFFFFFF)).astype(np.uint32)
    slots[slot_of] = np.arange(n, dtype=np.uint32)
    return seeds, prints, slots


def find(keys: np.ndarray, seeds: np.ndarray, prints: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Positions of keys among the indexed ones, -1 where the fingerprint shows that a key is absent."""
    n = len(prints)
    if not n or not len(keys):
        return np.full(len(keys), -1, dtype=np.int64)
    mixed = _spread(keys)
    seed = seeds[((mixed >> _U(33)) % _U(len(seeds))).astype(np.int64)].astype(np.int64)
    at = np.where(seed < 0, -seed - 1, _place(mixed, np.maximum(seed, 0), n).astype(np.int64))
    return np.where(prints[at] == (mixed & _U(0xFFFFFFFF)).astype(np.uint32), slots[at].astype(np.int64), -1)


def _block(part: int, block: int, before: int, keys: list, ids: list[bytes], width: int) -> tuple:
    valid = np.array([k is not None for k in keys], dtype=np.uint8)
    numbers = np.array([0 if k is None else k for k in keys], dtype=np.int64)
    offsets = np.concatenate(([0], np.cumsum([len(i) // width for i in ids]))).astype("<i8")
    some = np.flatnonzero(valid)
    _, first = np.unique(numbers[some], return_index=True)
    held = some[np.sort(first)]
    seeds, prints, slots = build_index(numbers[held])
    slots = held[slots].astype("<u4") if len(held) else slots
    known = numbers[some]
    lo, hi = (int(known.min()), int(known.max())) if len(known) else (None, None)
    arrays = (numbers.astype("<i8"), valid, offsets, seeds.astype("<i4"), prints.astype("<u4"), slots)
    return (part, block, len(keys), int(offsets[-1]), before, lo, hi, width, *(a.tobytes() for a in arrays), b"".join(ids))


def write(docs: DataFrame, path: str, encode: Callable[[], tuple[Callable[[list], list[bytes]], int]], key_col: str, text_col: str = "text", end_id: int | None = 0, block_ids: int = BLOCK_IDS) -> None:
    """Writes a store of ``docs`` in ascending order of ``key_col``.

    ``encode()`` is called in the worker and gives the encoder (texts to little-endian ids) and its width.
    """
    require(docs, key_col, text_col)
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key_col).cast("long").alias("k"), F.col(text_col).alias("t")).repartitionByRange(parts, "k").sortWithinPartitions("k")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        to_ids, width = encode()
        end = b"" if end_id is None else int(end_id).to_bytes(width, "little")
        keys, ids, size, block, before = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            row = _block(part, block, before, keys, ids, width)
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, (_, kind) in zip(row, _FIELDS)], names=[n for n, _ in _FIELDS])

        for slice_, texts in text_slices(batches, "t"):
            for k, one in zip(slice_.column(0).to_pylist(), to_ids(texts)):
                if keys and size + len(one) // width + 1 > block_ids:
                    yield flush()
                    keys, ids, before, size, block = [], [], before + size, 0, block + 1
                keys.append(k)
                ids.append(one + end)
                size += len(ids[-1]) // width
        if keys:
            yield flush()

    rows.mapInArrow(run, BLOCK_DDL).write.option("compression", "zstd").parquet(path)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T._parse_datatype_string(BLOCK_DDL)).parquet(path)


def _load(row: dict) -> tuple[np.ndarray, ...]:
    kinds = {"keys": "<i8", "valid": "u1", "offsets": "<i8", "seeds": "<i4", "prints": "<u4", "slots": "<u4", "payload": "<u2" if row["width"] == 2 else "<u4"}
    return tuple(np.frombuffer(row[n], k) for n, k in kinds.items())


def _starts(spark: SparkSession, path: str) -> DataFrame:
    """Ids before each part: one row per written part, so its size is bounded by the partition number."""
    from pyspark.sql import Window

    sums = blocks(spark, path).groupBy("part").agg(F.sum("n_ids").alias("n"))
    return sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first_id"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a store, in file order: ``(key, start, n_tokens, ids)``, ids as uint32 bytes.

    Documents with a key are fetched through the index, and its answer is checked against the file order.
    """
    rows = blocks(spark, path).join(F.broadcast(_starts(spark, path)), "part").withColumn("at", F.col("first_id") + F.col("before"))
    names = ["width", "keys", "valid", "offsets", "seeds", "prints", "slots", "payload", "at"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one block at a time
                row = batch.slice(i, 1).to_pylist()[0]
                keys, valid, offsets, seeds, prints, slots, payload = _load(row)
                place = np.arange(len(keys))
                some = np.flatnonzero(valid)
                got = find(keys[some], seeds, prints, slots)
                if (got < 0).any() or (keys[got] != keys[some]).any():
                    raise ValueError("the index of a block does not find its keys")
                fresh = np.concatenate(([True], keys[some][1:] != keys[some][:-1])) if len(some) else np.empty(0, bool)
                place[some[fresh]] = got[fresh]
                for lo in range(0, len(keys), 512):
                    own = place[lo : lo + 512]
                    ids = [payload[offsets[p] : offsets[p + 1]].astype("<u4").tobytes() for p in own]
                    yield pa.RecordBatch.from_arrays([pa.array([int(k) if v else None for k, v in zip(keys[lo : lo + 512], valid[lo : lo + 512])], pa.int64()), pa.array(row["at"] + offsets[own], pa.int64()), pa.array(offsets[own + 1] - offsets[own], pa.int64()), pa.array(ids, pa.binary())], names=["key", "start", "n_tokens", "ids"])

    return rows.select(*names).mapInArrow(run, "key long, start long, n_tokens long, ids binary")


def lookup(spark: SparkSession, path: str, keys: DataFrame, key_col: str) -> DataFrame:
    """Keyed access: ``(key, ids)`` for the distinct non-null keys of a frame that a store holds.

    Keys go to the one or two blocks whose range holds them (the directory has a row per part and is joined
    by range); in a block each key costs one probe of the index.
    """
    wanted = keys.select(F.col(key_col).cast("long").alias("key")).where("key is not null").distinct()
    all_blocks = blocks(spark, path)
    ranges = all_blocks.groupBy("part").agg(F.min("lo").alias("plo"), F.max("hi").alias("phi"))  # one row per written part
    routed = wanted.join(F.broadcast(ranges), (F.col("key") >= F.col("plo")) & (F.col("key") <= F.col("phi"))).select("part", "key")
    inner = all_blocks.select("part", "block", "lo", "hi")
    asked = routed.join(inner, "part").where("key between lo and hi").groupBy("part", "block").agg(F.collect_set("key").alias("asked"))
    rows = all_blocks.join(asked, ["part", "block"]).select("asked", "width", "keys", "valid", "offsets", "seeds", "prints", "slots", "payload")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                stored, _, offsets, seeds, prints, slots, payload = _load(row)
                asked_here = np.array(sorted(row["asked"]), dtype=np.int64)
                at = find(asked_here, seeds, prints, slots)
                hit = np.flatnonzero((at >= 0) & (stored[np.maximum(at, 0)] == asked_here))
                yield pa.RecordBatch.from_arrays([pa.array(asked_here[hit], pa.int64()), pa.array([payload[offsets[p] : offsets[p + 1]].astype("<u4").tobytes() for p in at[hit]], pa.binary())], names=["key", "ids"])

    return rows.mapInArrow(run, "key long, ids binary").dropDuplicates(["key"])


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
