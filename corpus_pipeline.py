"""From documents to packed token ids: quality rules, near-duplicates, decontamination, mixing, packing.

Each stage reads what the stage before it kept and wrote. All stages but the last return rows with
the columns of ``documents``; the last returns packed rows. A stage's own tables lie in the shared folder until a later
stage begins: its input is written then, so nothing reads them any more.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.llm import decontam, mixing, neardup, packing, quality  # noqa: E402
from tidemark.llm.storage import Scratch, table  # noqa: E402

#: Near-duplicates share 80 % of their 5-word shingles.
SHINGLE, SIMILARITY_PERCENT = 5, 80


_open: list[tuple[int, Scratch]] = []


def _scratch(spark: SparkSession, stage: int, name: str) -> Scratch:
    """A folder for the tables of a stage; those of the stages before it, whose results are written, go."""
    for old in [x for x in _open if x[0] < stage]:
        old[1].close()
        _open.remove(old)
    _open.append((stage, Scratch(spark, name)))
    return _open[-1][1]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.drop_near_duplicates(docs, _scratch(spark, 1, "stage-neardup"), SHINGLE, SIMILARITY_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), _scratch(spark, 2, "stage-decontam"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.apply_mix(docs, _scratch(spark, 3, "stage-mix"))


def token_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    _scratch(spark, 4, "stage-rows")
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_rows", token_rows),
]

#: Signatures, tokenizer and schedule have no SQL form: tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written to the shared folder and read again."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
