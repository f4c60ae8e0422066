"""Corpus pipeline over ``documents``: the stages below, each on all rows its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)``.  All but the last return the columns of ``documents`` and only
those; other columns that ``docs`` may have are dropped.  Null ids and texts are handled as the operators
say; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.llm import langid, minhash, mixing, piece_codec, toxicity
from kinetra.llm.common import cut, keyed_mod, read_table
from kinetra.llm.queries import PIECE_BPE, tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose best language has a smaller share are rejected, as are those without letters.
MIN_LANGUAGE_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; the model is learned from these documents' own labels."""
    model = langid.fit(docs, keyed_mod(F.col("doc_id"), 4) != 2)
    told = langid.predict(docs, model, COLUMNS, lang_out="__lang", score_out="__score")
    return told.where((F.col("__lang") != langid.UNDETERMINED) & (F.col("__score") >= MIN_LANGUAGE_SCORE)).select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity cut; the model is learned from the labels of the documents at hand."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), keyed_mod(F.col("doc_id"), 3) != 1)
    told = toxicity.score(docs.select(*COLUMNS).withColumn("__copy", F.col("text")), model, COLUMNS, "__copy")
    return told.where(F.col("score") < toxicity.CUT).select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component at a similarity of 0.8 on five-word shingles: the one of
    smallest id.  22 trees miss a pair at 0.8 with 1e-5, as 16 do at 0.85."""
    told = minhash.near_duplicates(docs, num=80, den=100, trees=22)
    gone = told.where("not kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document taken k times stands in k rows, one not taken goes; texts without words have no
    share in any budget and stay once."""
    told = mixing.mix(docs)
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")).otherwise(1)
    dealt = cut(told.groupBy(F.col("doc_id").alias("__id")).agg(F.max(copies).alias("__copies")))
    joined = docs.select(*COLUMNS).join(dealt, F.col("doc_id").eqNullSafe(F.col("__id"))).where("__copies > 0")
    return joined.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every row."""
    told = piece_codec.encode_decode(docs, tokenizer(PIECE_BPE), ["doc_id", "source"])
    return told.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("minhash_near_dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: The stages learn models and hash, which SQL cannot express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; each one's rows are cut into the shared folder, as a written table would be."""
    docs = read_table(spark, sf_dir, "documents").select(*COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
