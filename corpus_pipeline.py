"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as
the next stage's docs. All but the last return the columns of documents; further columns travel
along unchanged, whatever their names. What a stage does with nulls, empty and very long texts,
ties, repeated rows and empty tables is what its operator does: a document without letters goes in
the first stage, one of fewer than ten words in the second, repeated rows leave one in the third.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import language_id as languages
from lodestack.llm import mixing, packing, similar_texts
from lodestack.llm import quality_rules as rules
from lodestack.llm.shared import materialise, release, shield, written

#: Documents without letters are rejected; so are those of whose distinct 1- to 3-grams the languages' landmarks hold less than this share.
LEAST_KNOWN = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn languages from the labelled rows, drop what has none, and fill in missing labels."""
    model = languages.fit(docs, F.col("lang").isNotNull())
    own, restore = shield(docs, "lang_pred", "score", "known")
    found = languages.identify(own, model).where((F.col("lang_pred") != "und") & (F.col("known") >= LEAST_KNOWN))
    return restore(found.withColumn("lang", F.coalesce("lang", "lang_pred")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the second policy rejects."""
    own, restore = shield(docs, *rules.MEASURES, "failed", "base_failed", "kept")
    return restore(rules.apply_policy(rules.ledger(own), "v2").where("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of texts whose five-word shingles have a similarity of 0.8 or more."""
    return similar_texts.survivors(docs, shingle=5, similarity=0.8, most_bits=3)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and thin out documents so that sources weigh as the square root of their size."""
    own, restore = shield(docs, *mixing.ADDED)
    return restore(mixing.replicate(own, temperature=0.5))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens: a row per piece of a document."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=4096)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: SQL has neither the string kernel nor XXH64 nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder. Once a stage is written, what it was made from is deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, before, keep=1)
    return docs
