"""The training-data pipeline: quality, exact duplicates, near duplicates, private data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of ``documents``;
each is written as Parquet and read again before the next.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewave.llm import exact_dedup, packing, pii, quality, simhash
from tidewave.llm.catalog import PII_KEY, WORD_BPE
from tidewave.llm.shared import release, shared_folder, stored, table, writing_to

#: The folder of what the stage before has stored, in this thread.
_earlier: ContextVar[str | None] = ContextVar("earlier", default=None)


def stage(operate: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``operate`` with a folder of its own for what it stores. It goes when the next stage begins, unless that reads from it, its input not having been written."""

    @wraps(operate)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        earlier = _earlier.get()
        if earlier and operate.__name__ != STAGES[0][1].__name__ and not any(earlier in f for f in docs.inputFiles()):
            release(spark, earlier)
        folder = shared_folder(spark)
        with writing_to(folder):
            out = operate(spark, docs, sf_dir)
        _earlier.set(folder)
        return out

    return run_stage


@stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney model doesn't reject."""
    return quality.drop_low_quality(docs, table(spark, sf_dir, "labels"))


@stage
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the largest doc_id."""
    return exact_dedup.drop_exact_duplicates(docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id: a similarity of 0.8 or more on five-word shingles."""
    return simhash.drop_similar(docs, shingle=5, similarity=0.8)


@stage
def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms in place of private data."""
    return pii.pseudonymise(docs, PII_KEY).select(*docs.columns)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids and places in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path(WORD_BPE), with_ids=True)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("pii", hide_private),
    ("packing", pack_sequences),
]

#: Language models, fingerprints and packing have no SQL form; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, each in STAGES[:-1]:
        docs = stored(each(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
