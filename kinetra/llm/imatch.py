"""Document fingerprints by I-Match over randomised lexicons, in DataFrame functions only.

The lexicon holds the terms whose document frequency lies in a band.  Copies of one text count once, so a
group of copies cannot push its terms out of the band; only groups of fewer than ``1 / COPIES`` of the rows,
which cannot move a frequency noticeably, are counted row by row.  A term occurs in at least ``least * N``
documents, so there are at most (mean distinct terms per document) / ``least`` of them, whatever ``N``; this
bound is checked before the lexicon travels with the tasks, as hashed buckets in which terms are looked up in
place.  A larger lexicon is joined by shuffle.

The randomised lexicons overlap: each of ``EACH`` chains draws lexicons with shares 1/4, 1/8, ... of the band
by bits of the terms' own hashes, independent of the other chains, and ``EACH`` further chains draw from all
terms, so that texts of rare or frequent words only have fingerprints too.  A document's distinct terms of a
lexicon are sorted and hashed; the fingerprint is the list of these hashes, 4 hex digits each.  The likeness
of two is the share of equal ones among those for which either document has terms, so documents with few
changes agree on the larger lexicons too.

Rules for odd input: null text is empty; a text without words has the fingerprint of zeros and is like another
only if that has none either (1); equal texts have equal fingerprints; rows with equal ids are ordered by
their texts' hashes; a null id comes last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetra.llm.common import cut, require

#: Terms (8 bytes each) up to which a lexicon travels with the tasks.
BROADCAST_TERMS = 1_000_000
#: Groups of copies above this part of the rows, so fewer than this many, count once.
COPIES = 100_000
#: Chains of lexicons over the band and as many over all terms, and the halvings of each.
EACH, BITS = 6, 10
#: Ranges of ids for each shuffle partition; many small ones even out long documents.
RANGES = 8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-cased words of a text."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(texts: DataFrame, text_col: str, *, least: float, most: float, floor: int = 2) -> DataFrame:
    """``(term)``: terms that occur in ``least`` to ``most`` of all texts and in ``floor`` at least."""
    rows = texts.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("th", F.xxhash64("t"))
    total = rows.count()
    copies = cut(rows.groupBy("th").agg(F.count(F.lit(1)).alias("c")).where((F.col("c") > 1) & (F.col("c") * COPIES > total)))
    n = total - (copies.agg(F.sum(F.col("c") - 1)).first()[0] or 0)
    share = F.coalesce(1 / F.col("c"), F.lit(1.0))
    weighed = rows.join(F.broadcast(copies), "th", "left").select(F.explode(terms(F.col("t"))).alias("term"), share.alias("w"))
    found = weighed.groupBy("term").agg(F.round(F.sum("w"), 3).alias("df"))
    return found.where((F.col("df") >= max(floor, least * n)) & (F.col("df") <= max(floor, most * n))).select("term")


def _buckets(lex: DataFrame, size: int) -> tuple[Column, int]:
    """The lexicon as one array of ``2**k`` small arrays, and the mask that names a term's."""
    mask = (1 << max(0, (size // 2).bit_length())) - 1
    held = lex.groupBy(F.col("term").bitwiseAND(F.lit(mask)).alias("b")).agg(F.collect_list("term").alias("own"))
    every = lex.sparkSession.range(mask + 1).select(F.col("id").alias("b")).join(held, "b", "left")
    row = every.agg(F.sort_array(F.collect_list(F.struct("b", F.coalesce("own", F.array().cast("array<bigint>")).alias("own")))).alias("all"))
    text = row.select(F.to_json(F.transform("all", lambda x: x["own"]))).first()[0]
    return F.from_json(F.lit(text), "array<array<bigint>>"), mask  # folded to a literal when the plan is made


def _bands(every: Column, held: Column) -> Column:
    """What a text's fingerprint is made of: its sorted terms in the band, and a second hash of all its terms."""
    return F.array(F.sort_array(held), F.sort_array(F.transform(every, lambda t: F.xxhash64(t))))


def _hashes(bands: Column) -> Column:
    """Hash of the sorted terms of each randomised lexicon as ``array<int>``, 0 where there are none."""

    def kept(own: Column, bit: Column) -> Column:
        return F.filter(own, lambda t: F.call_function("shiftrightunsigned", t, bit).bitwiseAND(F.lit(1)) == 0)

    def step(so_far: Column, bit: Column) -> Column:
        def told(own: Column) -> Column:
            one = F.when(F.size(own) > 0, F.pmod(F.hash(own), F.lit(0xFFFF)) + 1).otherwise(F.lit(0))
            return F.struct(own.alias("own"), F.concat(so_far["out"], F.array(F.when(bit % BITS > 0, one).otherwise(F.lit(-1)))).alias("out"))

        return _let(kept(so_far["own"], bit), told)

    def chain(own: Column, at: Column) -> Column:
        start = F.struct(own.alias("own"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(F.sequence(at, at + BITS - 1), start, step, lambda end: end["out"])

    def chains(own: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit((EACH - 1) * BITS), F.lit(BITS)), lambda at: chain(own, at)))

    return F.filter(F.flatten(F.transform(bands, chains)), lambda x: x >= 0)


def _held(rows: DataFrame, lex: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with the arrays of terms in ``columns`` replaced by what is fingerprinted (``_bands``)."""
    size = lex.count()
    rest = [c for c in rows.columns if c not in columns]
    if size <= BROADCAST_TERMS:
        buckets, mask = _buckets(lex, size)

        def known(t: Column) -> Column:
            return F.array_contains(F.get(buckets, t.bitwiseAND(F.lit(mask)).cast("int")), t)

        return rows.select(*rest, *(_let(F.col(c), lambda e: _bands(e, F.filter(e, known))).alias(c) for c in columns))
    marked = cut(rows.withColumn("__row", F.monotonically_increasing_id()))
    asked = marked.select("__row", F.explode(F.array_distinct(F.concat(*columns))).alias("term")).join(lex, "term", "left_semi")
    hits = asked.groupBy("__row").agg(F.collect_list("term").alias("__hits"))
    both = marked.join(hits, "__row", "left").withColumn("__hits", F.coalesce("__hits", F.array().cast("array<bigint>")))
    return both.select(*rest, *(_bands(F.col(c), F.array_intersect(c, "__hits")).alias(c) for c in columns))


def as_text(hashes: Column) -> Column:
    return F.lower(F.array_join(F.transform(hashes, lambda x: F.substring(F.hex(x + F.lit(0x10000)), 2, 4)), ""))


def fingerprints(rows: DataFrame, lex: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """``keep`` columns with ``fingerprint`` for every row."""
    require(rows, text_col, *keep)
    found = _held(rows.select(*keep, terms(F.col(text_col)).alias("__terms")), lex, ["__terms"])
    return found.select(*keep, as_text(_hashes(F.col("__terms"))).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the lexicons of which either side has terms; 1 if neither has any."""
    used = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != 0) | (y != 0)), lambda u: u))
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != 0) & (x == y)), lambda u: u))
    return F.when(used == 0, F.lit(1.0)).otherwise(equal / F.greatest(used, F.lit(1)))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds below a key, by bisection; 0 for null."""
    edges = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")

    def step(at: Column, _: Column) -> Column:
        middle = F.shiftright(at["lo"] + at["hi"], 1)
        above = F.coalesce(F.get(edges, middle) < key, F.lit(False))
        return F.struct(F.when(above, middle + 1).otherwise(at["lo"]).alias("lo"), F.when(above, at["hi"]).otherwise(middle).alias("hi"))

    if not bounds:
        return F.lit(0)
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds).bit_length())), start, step, lambda at: at["lo"])


def ranges(docs: DataFrame, id_col: str, text_col: str, parts: int) -> tuple[DataFrame, W]:
    """``(id, text, range, ghost)`` and the order of rows by descending id within a range of ids.

    Each range also holds, last and marked as ``ghost``, the row that follows it: the first one of the range
    below, or of the topmost range for the lowest one.  So whatever looks one row ahead stays in its range.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    at = F.split(F.lit(",".join(str(i / parts) for i in range(1, parts))), ",").cast("array<double>")
    cuts = rows.agg(F.percentile_approx("id", at, F.lit(max(10_000, 10 * parts)))).first()[0] if parts > 1 else None
    dealt = rows.withColumn("range", _range_of(F.col("id"), sorted({int(c) for c in cuts or []})))
    tops = dealt.groupBy("range").agg(F.max("id").alias("top"))  # a row per range
    above = F.coalesce(F.lead("range").over(W.orderBy("range")), F.min("range").over(W.partitionBy()))
    tops = tops.select(F.col("range").alias("__r"), F.col("top").alias("__top"), above.alias("__above"))
    opens = (F.col("range") == F.col("__r")) & F.col("id").eqNullSafe(F.col("__top"))
    own = F.struct(F.col("range"), F.lit(False).alias("ghost"))
    extra = F.struct(F.col("__above").alias("range"), F.lit(True).alias("ghost"))
    both = F.when(F.col("__above").isNull(), F.array(own)).otherwise(F.array(own, extra))
    spread = dealt.join(F.broadcast(tops), opens, "left").select("id", "text", F.xxhash64("text").alias("th"), F.explode(both).alias("x"))
    return spread.select("id", "text", "th", "x.range", "x.ghost"), W.partitionBy("range").orderBy("ghost", F.desc_nulls_last("id"), "th")


def edited(text: Column, following: Column) -> Column:
    """The last third of the code points replaced by as many first ones of the next document (or all)."""
    n = F.char_length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(F.coalesce(following, F.lit("")), F.lit(1), third))


def edit_study(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least: float = 0.002, most: float = 0.2) -> DataFrame:
    """Fingerprints of all texts and of their edited forms, with likenesses (see the query's contract).

    Texts are shuffled once, by ranges of ids; the next document's text and, later, its fingerprint are the
    next row's.
    """
    require(docs, id_col, text_col)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lex = cut(lexicon(docs, text_col, least=least, most=most))
    rows, order = ranges(docs, id_col, text_col, RANGES * parts)
    both = rows.withColumn("new", edited(F.col("text"), F.lead("text").over(order)))
    slim = both.select(
        "id", "th", "range", "ghost", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("new").cast("binary"), 256).alias("edited_sha256"), terms(F.col("text")).alias("own"), terms(F.col("new")).alias("new")
    )
    told = _held(slim, lex, ["own", "new"]).withColumn("fp", _hashes(F.col("own"))).withColumn("efp", _hashes(F.col("new")))
    told = told.drop("own", "new").withColumn("next_fp", F.lead("fp").over(order)).where(~F.col("ghost"))
    return told.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
