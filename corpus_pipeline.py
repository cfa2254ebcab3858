"""From raw documents to packed sequences: toxicity, near-duplicates, repeats, secrets, packing.

Every stage takes any columns beside those of ``documents`` and leaves them out. A null text counts as an empty one: it is
kept by all filters, holds no secret and packs as its end mark alone; a null source is one source. Rows with equal
keys are one document to the near-duplicate and repeat stages, and each a row to the others. An empty table stays one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgetrail.llm import minhash, packing, secret_scan, substring, toxicity
from lodgetrail.llm.common import table
from lodgetrail.llm.queries import CAPACITY, TOXIC, toxicity_model
from lodgetrail.session import prepare, stage

#: Percent of shingles that near-duplicates share at least.
SIMILAR = 80
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    prepare(spark)
    model = toxicity_model(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model, into="_score").where(F.col("_score") < TOXIC).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    prepare(spark)
    found = stage(minhash.near_duplicates(docs, SIMILAR), "near-duplicates")
    return docs.join(found.where("NOT kept").select("doc_id"), "doc_id", "left_anti").select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the word sequences that occur earlier; ``n_chars`` follows the text."""
    prepare(spark)
    found = substring.find_repeats(docs, 20).where("kept_text IS NOT NULL").select("doc_id", "kept_text").dropDuplicates(["doc_id"])
    joined = docs.select(*COLUMNS).join(stage(found, "shortened"), "doc_id", "left")
    text = F.coalesce("kept_text", "text")
    chars = F.when(F.col("kept_text").isNull(), F.col("n_chars")).otherwise(F.length("kept_text")).cast("long")
    return joined.withColumns({"text": text, "n_chars": chars}).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their secrets replaced; ``n_chars`` follows the text."""
    prepare(spark)
    clean = secret_scan.redact(docs.select(*COLUMNS), secret_scan.scan(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    prepare(spark)
    cut = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITY)
    return packing.pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), CAPACITY)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("substrings", drop_repeats),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: No SQL trains a classifier or tokenises; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each on what the one before it left, written and read again."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
