"""A training corpus from raw documents: five stages, each over all that the one before it kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petriflow.functions.lineage import remove, shared_dir
from petriflow.llm import decontaminate, ngram_join, piece_transducer, quality_rules, substring_dedup


def _safe(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with names that no operator makes (but for doc_id and text), and the way back to its own columns."""
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    names = {c: c if c in ("doc_id", "text") else f"_column_{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*(F.col(quoted(c)).alias(n) for c, n in names.items()))
    return renamed, lambda out: out.select(*(F.col(n).alias(c) for c, n in names.items()))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of policy v1 rejects."""
    named, back = _safe(docs)
    return back(quality_rules.apply_policy(quality_rules.ledger(named), "v1").where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one of the least id."""
    named, back = _safe(docs)
    return back(ngram_join.one_of_each(named))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that an earlier document has in a window; a document left without words goes."""
    named, back = _safe(docs)
    out = substring_dedup.remove_repeated(named)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    kept = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    cut = back(kept.withColumn("text", text))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    named, back = _safe(docs)
    return back(decontaminate.clean(named, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids under the SentencePiece model, with their number and checksum, and doc_id, lang and source where there are such; the text and
    any other column have done their work and are left out."""
    kept = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    return piece_transducer.encode(docs.select(*kept, "text")).drop("text")


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", substrings),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece_encoding", encoding),
]

#: Near-duplicate classes and the encoding can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage keeps is written once, in the shared folder, and read by the next; the stage before it is then removed."""
    docs, folder, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
