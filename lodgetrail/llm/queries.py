"""The registered queries of the operators: whole tables, production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgetrail.llm import bpe, conversations, decontaminate, embeddings, manifest, minhash, packing, quality, secret_scan, sharding, substring, toxicity, urls
from lodgetrail.llm.common import table
from lodgetrail.llm.twins import TWINS as _TWINS
from lodgetrail.session import prepare

HELD_OUT = 1
#: A document scoring this much is predicted toxic.
TOXIC = 0.7
CAPACITY = 1024

def held_out() -> F.Column:
    """Whether a document's label must not be learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == HELD_OUT

def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    """The model fitted on the labelled documents that are not held out."""
    return toxicity.fit(docs, labels.where(~held_out()))

def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))

def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all documents, as digests."""
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    listed = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What substring deduplication removes from all documents."""
    found = substring.find_repeats(table(spark, sf_dir, "documents"), 20)
    kept = F.when(F.col("kept_text").isNull(), F.col("words_sha256")).otherwise(F.sha2("kept_text", 256))
    return found.select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))

def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), 85)

def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates for secrets in all documents, judged."""
    return secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))

def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences."""
    cut = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), CAPACITY)
    return packing.pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), CAPACITY)

def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and kept vectors of all embeddings."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)

def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the URLs of all pages."""
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))

def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality ledger of all documents with the verdict of the standard policy."""
    book = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    book = quality.apply_policy(quality.apply_policy(book, quality.BASE, "_base"), quality.STANDARD, "kept")
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("_base")).alias("base_failed"), "kept", "failed")

def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards."""
    return sharding.shard(table(spark, sf_dir, "documents"), 16)

def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of all documents stands in the benchmark."""
    docs = table(spark, sf_dir, "documents")
    found = decontaminate.contamination(docs, decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark")))
    listed = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))

def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and proofs of all documents, folded from rows of which a fifth were tampered with."""
    docs = table(spark, sf_dir, "documents")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    changed = manifest.leaf_of([F.translate("text", upper, lower) if f == "text" else F.col(f) for f in manifest.FIELDS])
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = manifest.manifest(docs, carry={"other_leaf": F.unhex(F.when(touched, changed))})
    from_leaf = F.coalesce(F.lower(F.hex("other_leaf")), F.col("leaf"))
    rows = found.proofs.select(
        "doc_id", "leaf", "subroot", F.lit(found.root).alias("root"), manifest.siblings_digest(F.col("path")).alias("proof_sha256"),
        manifest.fold(from_leaf, F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))

def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair of all conversations after damage."""
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")), copies="copies")

_RAW = {f.__name__: f for f in (op1_toxicity, op2_bpe, op3_substrings, op4_minhash, op5_packing, op6_secrets, op7_embeddings, op8_urls, op9_quality, op10_sharding, op11_decontamination, op12_manifest, op13_conversations)}

def _prepared(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir.rstrip("/"))

    return run

QUERIES = {name: _prepared(fn) for name, fn in _RAW.items()}

TWINS = {name: sql.strip() for name, sql in _TWINS.items()}
