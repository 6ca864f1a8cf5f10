"""Five stages from `documents` to packed sequences; each reads what the one before it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from presswork.llm import lines, mixing, near_dup, packing, quality
from presswork.llm._shared import staged, table
from presswork.llm.queries import CAPACITY, GRADES, LANGUAGE_WEIGHTS, languages, ratings, tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tail probability of the best grade is below one half go."""
    model = quality.fit(docs, ratings(table(spark, sf_dir, "labels")), GRADES)
    return quality.selected(docs, model, GRADES)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; documents are linked from a similarity of 0.8 on."""
    return near_dup.deduplicated(docs, 80)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated until the languages' expected tokens meet the target weights."""
    return mixing.mixed(docs, languages(docs), LANGUAGE_WEIGHTS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), CAPACITY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: SQL has no way to state the trained classifier, so the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages keep.

    Null texts are empty ones; rows without an id are kept by the filters and
    packed nowhere; equal rows are judged, repeated and packed each, but for the
    copies that near dedup drops by their id; an empty table gives no rows; other
    columns are carried up to the packing, whatever their names.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
