"""Queries of this subpackage by name; `__spark_entry__` adds them when the subpackage is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from petriflow.llm.decontaminate import contamination_digest
from petriflow.llm.language_id import language_digest
from petriflow.llm.lexical_search import search
from petriflow.llm.license_scan import license_digest
from petriflow.llm.merkle_manifest import manifest_digest
from petriflow.llm.ngram_join import near_duplicates
from petriflow.llm.personal_data import personal_digest
from petriflow.llm.piece_transducer import encoding_digest
from petriflow.llm.quality_rules import ablations, ledger, quality_digest
from petriflow.llm.quality_svm import quality_scores
from petriflow.llm.shuffle_shards import shard_digest
from petriflow.llm.sql import ORACLES
from petriflow.llm.substring_dedup import substring_digest
from petriflow.llm.token_files import token_digest


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": lambda s, d: language_digest(_docs(s, d)),
        "op2_hypergeometric_shuffle": lambda s, d: shard_digest(_docs(s, d)),
        "op3_quality_classifier": lambda s, d: quality_scores(_docs(s, d), s.read.parquet(f"{d}/labels.parquet")),
        "op4_ngram_jaccard_join": lambda s, d: near_duplicates(_docs(s, d)),
        "op5_quality_rules": lambda s, d: quality_digest(_docs(s, d)),
        "op6_benchmark_decontamination": lambda s, d: contamination_digest(_docs(s, d), _benchmark(s, d)),
        "op7_license_scan": lambda s, d: license_digest(_docs(s, d)),
        "op8_sentencepiece_transducer": lambda s, d: encoding_digest(_docs(s, d)),
        "op9_substring_dedup": lambda s, d: substring_digest(_docs(s, d)),
        "op10_token_files": lambda s, d: token_digest(_docs(s, d)),
        "op11_lexical_search": lambda s, d: search(_docs(s, d), _benchmark(s, d)),
        "op12_merkle_manifest": lambda s, d: manifest_digest(_docs(s, d)),
        "op13_personal_data": lambda s, d: personal_digest(_docs(s, d)),
        # The columns of 7 and 13 that SQL can express.
        "license_phrases": lambda s, d: license_digest(_docs(s, d)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"),
        "personal_base": lambda s, d: personal_digest(_docs(s, d)).drop("spans"),
        "rule_ablations": lambda s, d: ablations(ledger(_docs(s, d).select("doc_id", "text"))),
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
