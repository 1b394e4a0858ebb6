"""The corpus pipeline: five operators of ``matchloom.llm`` one after another, each over all rows the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's result to the shared folder and
reads it back as the next one's input, so a lost executor costs at most one stage; a stage's own tables are deleted when it is done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchloom.llm.common import materialise, read_table, spread
from matchloom.llm.decontam import drop_contaminated
from matchloom.llm.mixing import mix
from matchloom.llm.simhash import keep_one
from matchloom.llm.suffix_dedup import remove_repeats
from matchloom.llm.toxicity import reject_toxic
from matchloom.session import only_last_table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier rejects."""
    return reject_toxic(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the one with the smallest id, of each group of near-duplicates."""
    return keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that a document with a smaller id has too; documents stay, if need be with an empty text."""
    return remove_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their share of the mix: whole repetitions, words of the fractional one, words taken in all."""
    mixed = mix(docs)
    return mixed.where("taken > 0")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_dedup),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mixture),
]

# A trained classifier, connected components and spans of bytes are beyond SQL; the tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spread(read_table(spark, sf_dir, "documents"), "doc_id")
    for name, stage in STAGES[:-1]:
        with only_last_table(spark):
            docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
