"""A training corpus from raw documents: what is kept, cleaned and how often it is taken.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it kept and returns a
DataFrame; between stages the documents are written as Parquet. All but the last return the columns
of ``documents``; the last adds ``size``, ``copies`` and ``taken`` and drops documents that the mix
takes zero times.

Rows: a null text and one without a letter have no language and go in the first stage. Rows are told apart by their
place in the files, so rows with one id or with a null id but different texts all stay; of equal texts, whatever
their ids, one stays: that with the smallest id, null last, then the first in the files. A null source is a source of
its own. Very long texts are worked on whole. Extra columns go through to the end, but none may be called ``size``,
``copies`` or ``taken`` (ValueError). An empty table gives an empty result with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm import decontam, langid, mixing, secrets, similar
from metricloom.llm.common import documents, stored


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known go on, with that language in ``lang``."""
    return langid.keep_identified(docs, langid.train(docs), lang_col="lang")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document goes on: the one with the smallest id (null last). Links are SimHash
    fingerprints (those of op2) within three bits and, for texts too unlike for that, likeness 0.8 of their sets of
    five-word shingles."""
    return similar.keep_one(docs, distance=3, least=0.8)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents go on, without the secrets in their texts."""
    return secrets.redact_secrets(docs, length_col="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, and how many copies of each."""
    return mixing.take_mix(docs)


STAGES = [
    ("language ID", identify_languages),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("secret scans", redact_secrets),
    ("mixing", mix),
]

#: Null: SQL has neither the fingerprints' hash nor the automaton, the alignments or the draws.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = stored(docs, f"stage{k}")
    return docs
