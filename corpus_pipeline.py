"""The corpus pipeline: quality classifier, quality rules, near-duplicates, packing.

``run`` applies the stages to ``documents``; each stage is written as Parquet in the shared folder and read again by
the next.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vigilo.llm import nearcopies, packing, quality_cnn, quality_rules
from vigilo.llm.common import materialize, table

#: Documents scored below this are rejected.
LEAST_SCORE = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the byte-level network scores at ``LEAST_SCORE`` or more."""
    model = quality_cnn.fit(docs, table(spark, sf_dir, "labels"))
    return quality_cnn.keep_documents(docs, model, LEAST_SCORE)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base rules and the learned decision list.

    The list is learned from all labelled documents, those that an earlier stage removed included.
    """
    learned = quality_rules.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_rules.keep_documents(docs, learned)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the document with the smallest id; through SimHash, completed by MinHash bands."""
    return nearcopies.near_dedup(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of what is left into sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", rules), ("simhash_near_dedup", near_duplicates), ("best_fit_packing", pack)]

#: The classifier and the near-duplicate groups are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
