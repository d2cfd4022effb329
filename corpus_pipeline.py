"""From raw documents to packed sequences: toxic documents go, one of each group of near-duplicates stays, contaminated documents go, personal values become pseudonyms, what is left is packed.

Cases, for all stages: a null or empty text has no toxic passage, no near copy and no benchmark
window, so its row stays, and it is packed as the end token alone; rows with a null doc_id are
judged by their texts like any other; of rows that repeat doc_id and text the second stage leaves
one, the others treat each by itself; very long texts are read whole; columns of any name, also
such as the operators use themselves, stay as they are up to the last stage, which returns its own;
an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.common import materialize, table
from verdigris.llm.decontaminate import decontaminated
from verdigris.llm.neardup import deduplicated
from verdigris.llm.packing import packed
from verdigris.llm.pii import with_pseudonyms
from verdigris.llm.toxicity import without_toxic

#: For this pipeline's demonstration; whoever runs it brings a secret one.
PSEUDONYM_KEY = "demonstration key"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5; the model is learned from ``docs`` and the labels. Without a toxic label all stay."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest doc_id of each group; texts without words are in no group."""
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; with an empty benchmark all stay."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal values in their texts replaced; n_chars, where there is one, follows the text."""
    out = with_pseudonyms(docs, PSEUDONYM_KEY)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A place in a sequence of 4096 tokens for every piece of every document."""
    return packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("packing", packing),
]

#: SQL has no tokenizer and no segment search; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
