"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing, BPE.

Each stage takes the documents that its predecessor kept and returns what it keeps of them; all but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.bpe import bpe_columns
from ledgerline.llm.common import MADE, ascii_lower, clear_scratch, materialize
from ledgerline.llm.exact_dedup import exact_dedup, sha256_hex
from ledgerline.llm.jaccard import near_copies
from ledgerline.llm.langid import identify, train_profiles
from ledgerline.llm.mixing import emit_shards, mix_documents
from ledgerline.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which a language can be told: text with letters, and some n-gram of a learned profile.

    Profiles are learned from all rows that have a text and a language. Where there are none, no document stays."""
    return identify(docs, train_profiles(docs)).filter("lang_pred <> 'und' AND score > 0").select(COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each text: of equal texts the largest doc_id, null only where there is no other, and of several
    such rows the first by their columns. Rows that share a doc_id but differ in text both stay."""
    kept = materialize(exact_dedup(docs).filter("kept").select("doc_id", "digest").distinct())
    key = F.concat_ws("/", "digest", F.col("doc_id").cast("string")).alias("key")  # no doc_id: the digest alone
    keyed = docs.select(F.struct(*COLUMNS).alias("row"), "doc_id", sha256_hex(ascii_lower(F.col("text"))).alias("digest")).select(key, "row")
    return keyed.join(kept.select(key), "key", "left_semi").groupBy("key").agg(F.min("row").alias("row")).select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: texts that chains of a five-word Jaccard similarity of 0.8 or more join.

    It is the row with the smallest doc_id, null last; of several texts with that doc_id the one with the smallest
    digest, and of rows with that text too the first by their columns. So rows that share a doc_id, or have none, but
    are no copies all stay."""
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", sha256_hex(F.coalesce("text", F.lit(""))).alias("digest"))
    keyed = docs.select(F.struct(*COLUMNS).alias("row"), key.alias("key"), "text")
    kept = near_copies(keyed, "key").filter("key = component_id").select("key").distinct()
    own = F.to_json("key").alias("own")
    return keyed.select(own, "row").join(kept.select(own), "own", "left_semi").groupBy("own").agg(F.min("row").alias("row")).select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, each document as often as it is drawn: by output shard, and shuffled within each."""
    return emit_shards(mix_documents(docs)).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each document of the mix, and digests of them and of the decoded text."""
    return bpe_columns(docs, tokenizer_path(), ("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mix", mixed), ("bpe", tokens)]

#: SQL has no 64-bit hash of this kind, nor a tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs, begun = spark.read.parquet(f"{sf_dir}/documents.parquet"), len(MADE)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
            clear_scratch(spark, begun, keep=1)
    return docs
