"""A training corpus from raw documents: filter, drop near copies, cut repeats, pack.

Each stage takes all documents its predecessor kept; ``run`` writes a stage's
rows to the shared folder, reads them again for the next, and deletes them when
that has been written.

All stages take an empty table (and return none), rows that repeat, columns of
any other name (kept as they are up to the last stage) and nulls in any column:
a null text is empty, fails the base rules and goes in the first stage; the
later stages, on their own, keep a null text as it is, treat null ids as ids of
nobody (such rows are kept and take nothing from others), and rows of one id as
one document's.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import jaccard_join, packing, quality, suffix_dedup
from pairloom.llm._shared import discard, documents, materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the robust outlier test keep; rows of one id stay or go together."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles, similarity 0.8: the smallest id.

    Of equal texts under one id all rows stay; texts without words stay.
    """
    return jaccard_join.keep_first(docs, size=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings of earlier documents; whole characters only, n_chars anew."""
    cut = suffix_dedup.remove_repeats(docs, whole_characters=True, counts=False)
    kinds = {f.name: f.dataType for f in docs.schema}
    n = F.length("text").cast(kinds["n_chars"]) if "n_chars" in kinds else None
    return cut.withColumn("n_chars", F.coalesce(n, F.lit(0).cast(kinds["n_chars"]))) if n is not None else cut


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in as few sequences of 2048 as the search finds."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("best_fit_packing", packed_sequences),
]

#: The estimates of stage 1 and the search of stage 4 have no SQL; tests hold both against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
