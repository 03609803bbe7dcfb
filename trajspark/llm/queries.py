"""One query for each training-data operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fill_middle, licenses, line_dedup, mixing, ngram_join, odd_sketch, secrets, sharding, topk, toxicity
from . import vector_codes, warc
from .common import table


def op1_toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the chain calls toxic, with the probabilities of its categories."""
    scored = toxicity.toxicity(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), toxicity.label_categories()
    )
    return scored.where(F.col("p_toxic") >= toxicity.THRESHOLD).select("doc_id", "p_low_quality", "p_toxic")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_top_k(vectors.where("vec_id % 100 = 0"), vectors, k=10)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"), width=3, percent=90)


def op4_warc_boundary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_pages(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "pair")
    text = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in secrets.KINDS],
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )


def op7_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.fair_queue(table(spark, sf_dir, "documents"))
    return plan.select(
        F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken", "finish_time"
    )


def op8_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the number of its lines, of those that stay, and the numbers of those that go."""
    docs = table(spark, sf_dir, "documents")
    gone = line_dedup.dropped_lines(docs)
    n_lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    counted = docs.select("doc_id", n_lines.cast("long").alias("n_lines"))
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return counted.join(gone, counted.doc_id == gone.doc, "left").select(
        "doc_id",
        "n_lines",
        (F.col("n_lines") - F.size(dropped)).alias("n_kept"),
        F.array_join(dropped.cast("array<string>"), ",").alias("dropped_lines"),
    )


def op9_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


def op10_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.compress(table(spark, sf_dir, "embeddings"), keep=["label"])
    return vector_codes.with_error_by(coded.rows, "label").select(
        "vec_id",
        F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "").alias("code"),
        "error",
        "label_error",
        F.lit(coded.digest()).alias("codebooks_sha256"),
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = odd_sketch.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


QUERIES = {
    "op1_toxic_documents": op1_toxic_documents,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_warc_boundary_chain": op4_warc_boundary_chain,
    "op5_decontamination": op5_decontamination,
    "op6_secret_scan": op6_secret_scan,
    "op7_fair_mix": op7_fair_mix,
    "op8_fuzzy_line_dedup": op8_fuzzy_line_dedup,
    "op9_license_digests": op9_license_digests,
    "op10_minimax_shards": op10_minimax_shards,
    "op11_vector_codes": op11_vector_codes,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_minhash_near_dedup": op13_minhash_near_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op9_license_digests": licenses.oracle_sql(),
    "op11_vector_codes": vector_codes.oracle_sql(),
    "op12_fill_in_middle": fill_middle.oracle_sql(),
}
