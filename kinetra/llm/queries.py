"""Registered queries of the corpus operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.llm import embeddings, imatch, langid, minhash, mixing, piece_codec, sharding, token_counts, token_store, toxicity
from kinetra.llm.chunks import byte_pair_codec
from kinetra.llm.common import keyed_mod, read_table, scratch_path

#: Places of the public tokenizer files; a parameter of every operator that needs one.
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
TOKEN_LIMIT = 4096

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a quarter of the ids is held out from learning."""
    docs = read_table(spark, sf_dir, "documents")
    rest = keyed_mod(F.col("doc_id"), 4)
    model = langid.fit(docs, rest != 2)
    told = langid.predict(docs, model, ["doc_id"])
    return told.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix by weights 3, 1, 2 and 150 % of all words takes of every document."""
    return mixing.mix(read_table(spark, sf_dir, "documents"), weights=(3.0, 1.0, 2.0), share=1.5, most_repeats=2.0)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at a similarity of 0.85 on five-word shingles."""
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), num=85, den=100)


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document: equal texts together, row counts one apart at most."""
    told = sharding.shard_equal_texts(read_table(spark, sf_dir, "documents"), shards=8)
    return told.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written in ascending order of doc_id, with id 0 behind each, and read back."""
    vocabulary = tokenizer(BYTE_BPE)

    def encoder():
        codec = byte_pair_codec(vocabulary)
        return codec.encode, int(codec.width[-1])

    path = scratch_path(spark, "token-store")
    token_store.write(read_table(spark, sf_dir, "documents"), path, encoder, "doc_id", "text", end_id=0)
    return token_store.read(spark, path).select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors of equal label at a cosine of 0.93."""
    return embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids, with begin and end, and of the text decoded from them."""
    told = piece_codec.encode_decode(read_table(spark, sf_dir, "documents"), tokenizer(PIECE_BPE), ["doc_id"])
    return told.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of all documents and of their edited texts."""
    return imatch.edit_study(read_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, with its most toxic sentence; a third of the ids is held out."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    rest = keyed_mod(F.col("doc_id"), 3)
    model = toxicity.fit(docs, labels, rest != 1)
    told = toxicity.score(docs, model, ["doc_id"])
    return told.select("doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"), "top_start", "top_end", "top_score")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether they exceed the limit."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    told = token_counts.token_counts(docs, tokenizer(PIECE_BPE), ["doc_id", "n_bytes"])
    return told.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_mixing": op2_mixing,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_sharding": op4_sharding,
    "op5_token_store": op5_token_store,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_document_fingerprints": op8_document_fingerprints,
    "op9_toxicity": op9_toxicity,
    "op10_token_counts": op10_token_counts,
}

ORACLES: dict[str, str] = {}
