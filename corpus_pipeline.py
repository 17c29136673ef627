"""From raw documents to packed sequences, in five stages.

Every stage takes all that its predecessor kept, written as Parquet and read
again, and returns the columns of ``documents``; the last returns pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import toxicity
from tessera.llm.common import read_table
from tessera.llm.minhash import least_rows
from tessera.llm.packing import pack_documents
from tessera.llm.quality import filter_quality
from tessera.llm.repeats import without_repeats
from tessera.plans.shared import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return filter_quality(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; labels come from the table beside the documents."""
    labels = read_table(spark, sf_dir, "labels").where(toxicity.training_part(F.col("doc_id")))
    return toxicity.drop_toxic(docs, toxicity.learn(docs, labels))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id.

    A repeated row of a doc_id counts as a copy; another text under the same
    doc_id does not. A null doc_id is a document like others.
    """
    return least_rows(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that stand in a document with a smaller doc_id are cut out.

    Characters that a cut splits go whole; n_chars is counted anew. No document goes.
    """
    return without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens: document, place, ids."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=1)


STAGES = [("quality", quality), ("toxicity", toxic), ("near_duplicates", near_duplicate), ("suffix_dedup", suffix_dedup), ("packing", packing)]

#: Sketch quantiles, compression, hashing and tokenising have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, name)
    return docs
