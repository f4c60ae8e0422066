"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards.

Links are kept as ``(document, group)`` rows: all documents of a group are neighbours of each other, so a
clique of n documents costs n rows and its votes are counts by group and shard, combined before the shuffle.

1. Every document starts in a random shard.
2. Each round counts, for every group that has not settled, its documents by shard.  The group's documents
   move to the shard with most of them among the shards that have room for the whole group; groups that want
   the same shard are let in by falling size, as far as its quota reaches, in sums by bucket.  The largest
   group, while no shard can hold it, fills the emptiest shard, documents that are there already first, and goes
   on with the rest before others move.  Who has settled stays; who was refused votes again with the quotas that are left.
3. Documents without links keep their shard where there is room and make way elsewhere, by exact ranks.

Every round settles a group or fills a shard, so propagation ends; ``rounds`` only stops it early.  Counts
differ by one at most (law ``rows``).  Groups above ``1 / PLANNED`` of the rows are joined by broadcast (there
are fewer than ``PLANNED`` of them), unlinked rows stay out of joins, ranks come from bucket sums: no task
sees a whole group or shard.

Rules for odd input: null text has no bytes, crc32 0 and forms no group; rows with a null id are placed as
any other; equal rows get slots of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetra.llm.common import cut, require

#: Rows that a bucket of ranks should hold at most; the number of buckets follows the count of rows.
BUCKET_ROWS = 4096
#: Groups above this part of the rows are joined by broadcast.
PLANNED = 4096
_ROW = ["id", "size", "crc", "u", "bucket", "shard"]


def _ranked(rows: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Adds the exact 0-based rank of each row among rows with equal ``keys``, bucket by bucket: bucket sums
    give offsets, ranks inside a bucket give the rest."""
    sums = rows.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow))
    offsets = sums.withColumn("offset", upto - F.col("c")).drop("c")
    inner = F.row_number().over(W.partitionBy(*keys, "bucket").orderBy("u", "id", "size", "crc")) - 1
    return rows.withColumn("__inner", inner).join(offsets, [*keys, "bucket"]).withColumn(out, (F.col("offset") + F.col("__inner")).cast("long")).drop("__inner", "offset")


def cut_edges(rows: DataFrame, group_col: str, shard_col: str = "shard") -> int:
    """Pairs of rows of one group that lie in different shards."""
    held = rows.where(F.col(group_col).isNotNull()).groupBy(group_col, shard_col).agg(F.count(F.lit(1)).alias("c"))
    cut_pairs = (F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2
    return int(held.groupBy(group_col).agg(cut_pairs.alias("e")).agg(F.coalesce(F.sum("e"), F.lit(0))).first()[0])


def _by_shard(values: list[int]) -> Column:
    """The value of a row's ``shard``."""
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("shard") + 1)


def _votes(open_rows: DataFrame, shards: int) -> DataFrame:
    """``(grp, hot, n, held)``: documents of each group, and how many of them each shard has."""
    near = open_rows.groupBy("grp", "hot", "shard").agg(F.count(F.lit(1)).alias("c"))
    held = F.array(*[F.coalesce(F.sum(F.when(F.col("shard") == s, F.col("c"))), F.lit(0)).cast("long") for s in range(shards)])
    return near.groupBy("grp", "hot").agg(F.sum("c").alias("n"), held.alias("held"))


def _let_in(groups: DataFrame, room: list[int], count: int) -> DataFrame:
    """``(grp, hot, n, to)`` of the groups that move whole: each wants the shard with most of its documents
    among those with room for it, and the larger come first while the sum fits into the room."""
    each = [F.when(F.col("n") <= r, F.struct(F.col("held")[s].alias("votes"), F.xxhash64("grp", F.lit(s)).alias("tie"), F.lit(s).alias("to"))) for s, r in enumerate(room)]
    wanted = groups.withColumn("to", (F.greatest(*each) if len(each) > 1 else each[0])["to"]).where("to is not null").select("grp", "hot", "n", "to")
    buckets = max(1, -(-count // BUCKET_ROWS))
    wanted = wanted.withColumn("turn", -F.floor(F.log2("n"))).withColumn("b", F.pmod(F.xxhash64("grp", F.lit(31)), F.lit(buckets)))
    sums = wanted.groupBy("to", "turn", "b").agg(F.sum("n").alias("c"))
    before = sums.withColumn("before", F.sum("c").over(W.partitionBy("to").orderBy("turn", "b").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("c")).drop("c")
    inner = F.sum("n").over(W.partitionBy("to", "turn", "b").orderBy(F.xxhash64("grp"), "grp").rowsBetween(W.unboundedPreceding, W.currentRow))
    limit = F.element_at(F.array(*[F.lit(r).cast("long") for r in room]), F.col("to") + 1)
    return wanted.withColumn("upto", inner).join(before, ["to", "turn", "b"]).where(F.col("before") + F.col("upto") <= limit).select("grp", "hot", "n", "to")


def propagate(open_rows: DataFrame, room: list[int], shards: int, rounds: int) -> tuple[list[DataFrame], DataFrame]:
    """The settled rows, in parts, and the rows that had not settled after ``rounds``; ``room`` is used up."""
    settled: list[DataFrame] = []
    for _ in range(rounds):
        groups = cut(_votes(open_rows, shards))
        count, largest = groups.agg(F.count(F.lit(1)), F.max(F.struct("n", "grp"))).first()
        if not count:
            break
        widest = max(range(shards), key=lambda s: (room[s], -s))
        if largest["n"] > room[widest]:  # no shard holds it: it fills the emptiest one
            own = F.col("grp") == F.lit(largest["grp"])
            ranked = _ranked(open_rows.where(own).withColumn("away", F.col("shard") != widest), ["away"], "rank")
            here = ranked.where(~F.col("away")).count()
            first = ranked.withColumn("rank", F.col("rank") + F.when(F.col("away"), F.lit(here)).otherwise(0))
            moved = cut(first.withColumn("to", F.when(F.col("rank") < room[widest], F.lit(widest))).drop("away", "rank"))
            settled.append(moved.where("to is not null").withColumn("shard", F.col("to")).select(*_ROW))
            open_rows = open_rows.where(~own).union(moved.where("to is null").select(open_rows.columns))
            room[widest] = 0
            continue  # the others wait, so that it fills as few shards as it can
        granted = cut(_let_in(groups, room, count))
        for r in granted.groupBy("to").agg(F.sum("n").alias("n")).collect():  # one row per shard
            room[r["to"]] -= r["n"]
        hot = open_rows.where("hot").join(F.broadcast(granted.where("hot").select("grp", "to")), "grp", "left")
        rest = open_rows.where("not hot").join(granted.where("not hot").select("grp", "to"), "grp", "left")
        moved = cut(hot.unionByName(rest))
        settled.append(moved.where("to is not null").withColumn("shard", F.col("to")).select(*_ROW))
        open_rows = moved.where("to is null").select(open_rows.columns)
    return settled, open_rows


def _fill(rows: DataFrame, room: list[int], shards: int) -> DataFrame:
    """The rows in shards that take exactly ``room`` of them; who need not move stays."""
    now = {r["shard"]: r["c"] for r in rows.groupBy("shard").agg(F.count(F.lit(1)).alias("c")).collect()}  # one row per shard
    over = [max(0, now.get(s, 0) - room[s]) for s in range(shards)]
    ranked = _ranked(rows, ["shard"], "rank")
    number = F.col("rank") + _by_shard([sum(over[:s]) for s in range(shards)])
    upto, dealt = 0, F.lit(None).cast("int")
    for s in reversed(range(shards)):
        upto = sum(max(0, room[t] - now.get(t, 0)) for t in range(s + 1))
        dealt = F.when(number < upto, s).otherwise(dealt)
    return ranked.withColumn("shard", F.when(F.col("rank") < _by_shard(over), dealt).otherwise(F.col("shard")).cast("int")).select(*_ROW)


def assign(docs: DataFrame, group: Column, id_col: str = "doc_id", text_col: str = "text", *, shards: int = 8, rounds: int = 64) -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` for every row; ``group`` links documents (null: unlinked)."""
    require(docs, id_col, text_col)
    text = F.col(text_col)
    size, crc = F.coalesce(F.octet_length(text), F.lit(0)) + 1, F.coalesce(F.crc32(text.cast("binary")), F.lit(0))
    base = docs.select(F.col(id_col).alias("id"), size.cast("long").alias("size"), crc.cast("long").alias("crc"), group.alias("grp"))
    base = cut(base.withColumn("u", F.xxhash64("id", "crc", F.monotonically_increasing_id())))
    total = base.count()
    buckets = max(1, -(-total // (shards * BUCKET_ROWS)))
    base = base.withColumn("bucket", F.pmod(F.xxhash64("u", F.lit(31)), F.lit(buckets)).cast("int")).withColumn("shard", F.pmod(F.xxhash64("u", F.lit(37)), F.lit(shards)).cast("int"))

    named = base.where("grp is not null")
    sizes = cut(named.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    large = F.broadcast(sizes.where(F.col("n") * PLANNED > total).select("grp"))
    hot = named.join(large, "grp", "left_semi").withColumn("hot", F.lit(True))
    others = named.join(large, "grp", "left_anti")
    small = sizes.where(F.col("n") * PLANNED <= total).select("grp", F.lit(False).alias("hot"))
    told = cut(hot.unionByName(others.join(small, "grp", "left")))  # ``hot`` is null where a text stands alone

    least, extra = divmod(total, shards)
    room = [least + (s < extra) for s in range(shards)]
    settled, left = propagate(told.where("hot is not null").select("grp", "hot", *_ROW), room, shards, rounds)
    free = base.where("grp is null").select(*_ROW).union(told.where("hot is null").select(*_ROW)).union(left.select(*_ROW))
    final = cut(reduce(DataFrame.union, settled, _fill(cut(free), room, shards)))
    return _ranked(final, ["shard"], "slot").select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def shard_equal_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shards: int = 8, rounds: int = 64) -> DataFrame:
    """``assign`` with documents of equal text as groups."""
    return assign(docs, F.md5(F.col(text_col).cast("binary")), id_col, text_col, shards=shards, rounds=rounds)
