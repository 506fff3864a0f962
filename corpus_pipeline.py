"""Cleaning and packing of a corpus, each stage one operator of ``thoughtloom.llm``.

Every stage but the last takes and returns the columns of documents; where a stage
rewrites texts, ``n_chars`` follows. Rows without an id pass the stages that compare
documents as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thoughtloom.llm import host_rules, line_dedup, packing, secret_scan
from thoughtloom.llm import near_copies as shingle_copies
from thoughtloom.session import materialise


def _with_text(docs: DataFrame, text: Column) -> DataFrame:
    docs = docs.withColumn("text", text)
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and their host's verdict let pass."""
    return host_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that match an earlier one; documents of which no word is left go."""
    columns, counts = docs.columns, "_".join([*docs.columns, "counts"])  # a name of its own
    left = line_dedup.remove_lines(docs, counts)
    left = left.where(F.col("text").isNull() | (F.col(counts)["n_removed"] == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return _with_text(left, F.col("text")).select(*columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    found = shingle_copies.near_copies(docs)
    first = found.where((F.col("doc_id") == F.col("first_id")) & (F.col("digest") == F.col("first_digest")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = (F.col("row.doc_id").cast("long") == F.col("first_id")) & (F.xxhash64(F.col("row.text").cast("string")) == F.col("first_digest"))
    kept = rows.join(first.select("first_id", "first_digest"), same, "left_semi")
    kept = kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
    return kept.dropDuplicates(["doc_id", "text"]).union(docs.where(F.col("doc_id").isNull()))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets replaced."""
    text = F.col("text")
    found = secret_scan.findings(text, secret_scan.forest_for(docs))
    return _with_text(docs, host_rules.bound(found, lambda f: secret_scan.redacted(text, f)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_copies),
    ("secret scan", secrets),
    ("best-fit packing", packed),
]

#: The stages hash, train and plan; SQL can't express them (tests/llm compares them with plain Python).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each is written to the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
