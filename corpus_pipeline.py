"""A corpus pipeline of four operators: each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowtriage.llm import decontamination, piece_codec, simhash, toxicity
from flowtriage.llm.common import table
from flowtriage.llm.queries import CATEGORIES
from flowtriage.sources.workspace import durable


def _whole_rows(docs: DataFrame) -> DataFrame:
    """The text beside each whole row, so that no result can take the name of a column."""
    return docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the chain rejects go."""
    fitted = toxicity.fit_chain(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    scored = toxicity.score_chain(_whole_rows(docs), fitted, text="_text", keep=("_row",))
    return scored.where(~F.col("rejected")).select("_row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group linked by fingerprints, the document with the least doc_id stays.

    Rows that share the kept id stay once for each different text. Rows without
    an id stay once for each fingerprint, unless a document with an id is in
    their group.
    """
    classes = simhash.near_duplicates(docs)
    first = classes.where(F.col("component_id") == F.col("doc_id")).select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").select(*docs.columns)
    again = classes.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if not again.isEmpty():
        once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(again, "doc_id", "left_anti").unionByName(once).select(*docs.columns)
    lone = classes.where("doc_id IS NULL AND component_id IS NULL").select("fingerprint").distinct()
    if not lone.isEmpty():
        nameless = _whole_rows(docs.where("doc_id IS NULL"))
        marked = simhash.fingerprints(nameless, "_text", ("_row",)).withColumn("_print", simhash.shown("fingerprint"))
        alone = marked.join(lone.select(F.col("fingerprint").alias("_print")), "_print", "left_semi")
        kept = kept.unionByName(alone.dropDuplicates(["_print"]).select("_row.*"))
    return kept


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly benchmark go."""
    items = table(spark, sf_dir, "benchmark")
    found = decontamination.decontaminate(_whole_rows(docs), items, text="_text", keep=("_row",))
    cut = F.col("n_hit") > 0
    changed = {
        "text": F.when(cut, F.col("clean_text")).otherwise(F.col("_row.text")),
        "n_chars": F.when(cut, F.length("clean_text").cast("long")).otherwise(F.col("_row.n_chars")),
    }
    kept = found.where(~F.col("rejected"))
    return kept.select(*[changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as piece ids, with the digests that prove the way back."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return piece_codec.encode_decode(docs, path).select(
        "doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"
    )


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("piece_codec", encoding_stage),
]

#: Neither a fitted chain nor the encoding can be said in SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
