"""Mixing sources to target weights by hash-threshold histograms, without sorting documents.

A document's 60-bit hash decides its place.  Sizes are summed by source and hash bucket (1,024 buckets a
level); the bucket in which a source's budget ends is refined, only its documents being looked at again,
until it holds one hash.  Documents below a source's threshold are taken once more than the others, so
thresholds are nested: a larger budget takes all that a smaller one took.

Rules for odd input: null text has size 0; null is a source of its own, the last one; rows with equal ids
share their fate; without words every target is 0.  Only a source's own documents compete, and the count of
sources, not of documents, bounds the tables that are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetra.llm.common import cut, require

BITS, LEVELS = 10, 6
_SPAN = 1 << (BITS * LEVELS)
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def place(*columns: Column, seed: int) -> Column:
    """60-bit hash of a row's key."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(_SPAN))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most_repeats: float) -> DataFrame:
    """``(source, source_size)`` with ``target``: weights repeat over the sources in code-point order (null
    last); a target stops at ``most_repeats`` times its size and the excess is shared anew by weight."""
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = cut(ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("most", F.col("source_size") * F.lit(float(most_repeats))).drop("rank"))
    wanted = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:  # each round the excess of full sources raises the level of the others
        row = ranked.agg(
            F.sum(F.when(F.col("most") <= F.col("weight") * F.lit(level), F.col("most")).otherwise(0.0)),
            F.sum(F.when(F.col("most") > F.col("weight") * F.lit(level), F.col("weight")).otherwise(0.0)),
            F.count(F.when(F.col("most") <= F.col("weight") * F.lit(level), 1)),
        ).first()
        if row[2] == full or not row[1]:
            break
        full, level = row[2], (wanted - row[0]) / row[1]
    return ranked.withColumn("target", F.least("most", F.col("weight") * F.lit(level)))


def _ends(rows: DataFrame, first: DataFrame, rest: DataFrame) -> DataFrame:
    """Where each source's budget ends: for ``(source, rest)`` the 60-bit interval ``[lower, upper)`` of the
    crossing bucket, the words ``below`` it and those ``inside``.  ``first`` is the first level's histogram."""
    zero = F.lit(0).cast("long")
    state, sums = rest.select("source", "rest", zero.alias("edge"), zero.alias("below"), zero.alias("inside"), zero.alias("n")), first
    for level in range(1, LEVELS + 1):
        joined = sums.alias("c").join(state.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).select("s.source", "rest", "edge", "below", "digit", "size", F.col("c.n").alias("n"))
        run = F.sum("size").over(W.partitionBy("source").orderBy("digit").rowsBetween(W.unboundedPreceding, W.currentRow))
        crossing = joined.withColumn("upto", F.col("below") + run).where(F.col("upto") >= F.col("rest"))
        hit = crossing.groupBy("source").agg(F.min(F.struct("digit", "edge", "size", "n", "upto")).alias("m"))
        # a source without a crossing wants more than there is: its interval is the end of the hash range
        found, none = F.col("m").isNotNull(), F.lit(1 << (BITS * level)).cast("long")
        state = cut(
            state.alias("s")
            .join(hit.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")), "left")
            .select(
                "s.source",
                "rest",
                F.when(found, F.col("m.edge") * (1 << BITS) + F.col("m.digit")).otherwise(none).alias("edge"),
                F.when(found, F.col("m.upto") - F.col("m.size")).otherwise(F.col("below")).alias("below"),
                F.when(found, F.col("m.size")).otherwise(zero).alias("inside"),
                F.when(found, F.col("m.n")).otherwise(zero).alias("n"),
            )
        )
        if level == LEVELS or (state.agg(F.max("n")).first()[0] or 0) <= 1:
            break
        edge = state.where("n > 1").select(F.col("source").alias("s_source"), F.col("edge").alias("s_edge"))
        narrow = rows.join(edge, F.col("source").eqNullSafe(F.col("s_source")) & (F.shiftright("h", BITS * (LEVELS - level)) == F.col("s_edge")))
        own = narrow.groupBy("source", F.shiftright("h", BITS * (LEVELS - level - 1)).bitwiseAND(F.lit((1 << BITS) - 1)).alias("digit")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        still = state.where("n = 1").select("source", zero.alias("digit"), F.col("inside").alias("size"), "n")  # one document already
        sums = own.select("source", "digit", "size", "n").union(still)
    scale = F.lit(1 << (BITS * (LEVELS - level)))
    return state.select("source", "rest", (F.col("edge") * scale).alias("lower"), ((F.col("edge") + 1) * scale).alias("upper"), "below", "inside")


def _histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source", F.shiftright("h", BITS * (LEVELS - 1)).alias("digit")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, most_repeats: float = 2.0, seed: int = 41, close: float = 1e-3) -> DataFrame:
    """One row per input row: ``(id, size, source_size, target, taken)``, ``taken`` with repeats counted.

    Documents are taken whole.  Where the document at the threshold leaves a source further from its target
    than ``close`` times the target, the rest goes to a second threshold among the documents that fit in it.
    """
    require(docs, id_col, text_col, source_col)
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), place(F.col(id_col), seed=seed).alias("h")))
    first = cut(_histogram(rows))
    goals = targets(first.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most_repeats)
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long")
    goals = cut(goals.select("source", "source_size", "target", base.alias("base"), F.greatest(F.lit(0.0), F.col("target") - base * F.col("source_size")).alias("rest")))

    one = _ends(rows, first, goals.where("rest > 0").select("source", "rest"))
    short = F.col("rest") - F.col("below")
    nearest = F.when(F.col("inside") - short < short, F.col("upper")).otherwise(F.col("lower"))
    off = F.least(short, F.abs(F.col("inside") - short))
    one = cut(goals.drop("rest").alias("g").join(one.alias("e"), F.col("g.source").eqNullSafe(F.col("e.source")), "left").select("g.source", "source_size", "target", "base", F.when(off <= F.lit(close) * F.col("target"), nearest).otherwise(F.col("lower")).alias("t1"), F.when(off <= F.lit(close) * F.col("target"), F.lit(0.0)).otherwise(short).alias("left")))
    after = one.where("left >= 1").select(F.col("source").alias("s_source"), F.col("t1").alias("s_t1"), F.col("left").alias("s_left"))
    ends = one.select("source", "source_size", "target", "base", F.coalesce("t1", F.lit(0)).alias("t1"), F.coalesce("left", F.lit(0.0)).alias("left"))
    if after.isEmpty():
        ends = ends.withColumn("t2", F.lit(0).cast("long"))
    else:
        fit = cut(rows.join(after, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("h") >= F.col("s_t1")) & (F.col("size") <= F.col("s_left")) & (F.col("size") > 0)).select("source", "h", "size"))
        two = _ends(fit, _histogram(fit), after.select(F.col("s_source").alias("source"), F.col("s_left").alias("rest")))
        two = two.select(F.col("source").alias("s_source"), nearest.alias("t2"))
        ends = ends.join(two, F.col("source").eqNullSafe(F.col("s_source")), "left").select(*ends.columns, F.coalesce("t2", F.lit(0)).alias("t2"))
    ends = cut(ends.withColumnRenamed("source", "s_source"))
    more = (F.col("h") < F.col("t1")) | ((F.col("h") < F.col("t2")) & (F.col("size") <= F.col("left")))
    taken = F.col("size") * (F.col("base") + more.cast("long"))
    return rows.join(ends, F.col("source").eqNullSafe(F.col("s_source"))).select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"))
