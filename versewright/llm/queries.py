"""Registered queries of the operators of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from versewright.llm import bpe, decontaminate, filters, images, langid, licenses, lines, quality, sharding, simhash, suffixes, toxicity, tries
from versewright.llm.common import id_hash, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@query("op1_line_dedup")
def line_dedup(spark, sf_dir):
    """What pairwise alignment deletes from every document, the earlier documents it's found in and what stays."""
    found = lines.deduplicated(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.size("line_cuts").alias("n_cuts"),
        F.aggregate("line_cuts", F.lit(0), lambda n, r: n + r["stop"] - r["start"] + 1).alias("lines_cut"),
        F.col("line_partners").alias("earlier_docs"), F.length("text").cast("long").alias("chars_left"),
        F.sha2("text", 256).alias("text_sha256"))


@query("op2_license_scan", licenses.scan_sql())
def license_scan(spark, sf_dir):
    found = licenses.scanned(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "license_digest", "license", "license_notices")


@query("op3_hypergeometric_shards")
def hypergeometric_shards(spark, sf_dir):
    """All documents, texts and all, dealt into 16 shards; sizes and checksums are taken where the texts arrive."""
    found = sharding.sharded(table(spark, sf_dir, "documents"), 16, stored=True)
    data = F.col("text").cast("binary")
    return found.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op4_byte_bpe")
def byte_bpe(spark, sf_dir):
    return bpe.tokenized(
        table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=False)


@query("op5_image_copies")
def image_copies(spark, sf_dir):
    """Classes of the pictures rendered from the whole table of embeddings."""
    return images.copies(images.rendered(table(spark, sf_dir, "embeddings"))).select("media_id", "class_id", "links")


@query("op6_benchmark_decontamination")
def benchmark_decontamination(spark, sf_dir):
    """Each item in each document that holds it."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


@query("op7_language_id")
def language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(id_hash(F.col("doc_id")), F.lit(3)) == 1, F.lit(False))
    model = langid.fitted(docs, F.col("doc_id").isNotNull() & ~held_out)
    return langid.identified(docs.withColumn("held_out", held_out), model, ("doc_id", "held_out"))


@query("op8_quality")
def quality_scores(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.pmod(id_hash(F.col("doc_id")), F.lit(5)) == 0, F.lit(False))
    model = quality.fitted(docs, labels, ~held_out)
    found = quality.scored(docs.withColumn("held_out", held_out), model, ("doc_id", "held_out"))
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op9_toxicity")
def toxicity_scores(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.pmod(id_hash(F.col("doc_id")), F.lit(4)) == 2, F.lit(False))
    model = toxicity.fitted(docs, labels, ~held_out)
    found = toxicity.scored(docs.withColumn("held_out", held_out), model, ("doc_id", "held_out"))
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op10_simhash_near_dedup")
def simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query("op11_suffix_array_dedup")
def suffix_array_dedup(spark, sf_dir):
    return suffixes.repeats(table(spark, sf_dir, "documents")).drop("spans")


@query("op12_conversation_trie", tries.rebuilt_nodes_sql())
def conversation_trie(spark, sf_dir):
    own = tries.paths(table(spark, sf_dir, "conversations"))
    shared = F.pmod(id_hash(F.col("conv_id")), F.lit(4)).cast("int")
    return tries.nodes(tries.rebuilt(own, shared, 3, F.col("conv_id") - F.col("conv_id") % 20))


@query("op13_filter_audit", filters.audit_sql())
def filter_audit(spark, sf_dir):
    return filters.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
