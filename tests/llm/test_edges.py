"""Columns that clash with names that the operators might use, and empty tables, for every operator that takes documents."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_ops_small import DOCS, words

import corpus_pipeline
from trajspark.llm import decontam, licenses, line_dedup, mixing, ngram_join, secrets, sharding, toxicity

NAMES = [
    "_key", "_chunk", "_row", "_before", "key", "chunk", "before", "at", "doc", "id", "line", "lines", "h", "g", "group", "n", "same", "kept", "size",
    "shard", "slot", "law", "spans", "rank", "item", "item_id", "k", "a", "b", "count", "finish_time", "taken", "_to", "row", "weight", "component_id",
]


def documents(spark):
    rows = [(k, "\n".join([" ".join(words(12, k % 5)), " ".join(words(9, 50 + k))]), "en", "ab"[k % 2], 10) for k in range(12)]
    rows += [(None, None, None, None, None), (3, rows[3][1], "en", "b", 10), (20, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    return docs.select("*", *[F.lit("x").alias(c) for c in NAMES])


def benchmark(spark, docs):
    return docs.where("doc_id in (1, 2)").select(F.col("doc_id").alias("item_id"), F.split("text", "\n")[1].alias("text"), F.lit(1).alias("doc"))


def labels(spark, docs):
    return docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"), (F.col("doc_id") % 2).alias("toxic"), F.lit(1).alias("n"))


OPERATORS = {
    "toxicity": lambda spark, docs: toxicity.toxicity(docs, labels(spark, docs), toxicity.label_categories()),
    "ngram_join": lambda spark, docs: ngram_join.similar_documents(docs),
    "one_of_each": lambda spark, docs: ngram_join.one_of_each(docs),
    "find_contaminated": lambda spark, docs: decontam.find_contaminated(docs, benchmark(spark, docs)),
    "decontaminate": lambda spark, docs: decontam.decontaminate(docs, benchmark(spark, docs)),
    "secrets": lambda spark, docs: secrets.find_secrets(docs),
    "fair_queue": lambda spark, docs: mixing.fair_queue(docs),
    "mix_documents": lambda spark, docs: mixing.mix_documents(docs),
    "dropped_lines": lambda spark, docs: line_dedup.dropped_lines(docs),
    "dedup_lines": lambda spark, docs: line_dedup.dedup_lines(docs),
    "licenses": lambda spark, docs: licenses.find_licenses(docs),
    "sharding": lambda spark, docs: sharding.shard_by_bytes(docs, 3),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_and_empty_tables(spark, name):
    docs = documents(spark)
    plain = [f.name for f in spark.createDataFrame([], DOCS).schema]
    clean = OPERATORS[name](spark, docs.select(*plain))
    clashing = OPERATORS[name](spark, docs)
    shared = [c for c in clean.columns if c in clashing.columns]
    assert shared == clean.columns
    rows = lambda df: sorted(map(str, df.select(*[F.col(f"`{c}`") for c in shared]).collect()))
    assert rows(clashing) == rows(clean)
    for empty in (docs.limit(0), docs.select(*plain).limit(0)):
        assert OPERATORS[name](spark, empty).count() == 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    docs = documents(spark)
    docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages_with_clashing_columns(spark, tmp_path):
    docs = documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark, docs).write.parquet(str(tmp_path / "labels.parquet"))
    benchmark(spark, docs).write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(docs.columns) <= set(out.columns) and out.count() == out.select("shard", "slot").distinct().count()
