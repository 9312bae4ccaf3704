"""From raw documents to training sequences: five stages, each over all that its predecessor kept.

A stage is called with (spark, docs, sf_dir); its result is written as Parquet and reread as the
next one's docs. The stages keep the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from logweir.llm import packing, secrets
from logweir.llm.common import Workspace, table
from logweir.llm.decontam import Decontaminator
from logweir.llm.near_dup import NearDuplicates
from logweir.llm.toxicity import ToxicityClassifier


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of the documents at hand; toxic documents go.

    Null and empty texts, null ids and repeated rows that are not toxic stay; long texts are scored whole; without labels none goes, or all alike.
    An empty table stays empty; all columns stay.
    """
    return ToxicityClassifier().fit(docs, table(spark, sf_dir, "labels")).clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 0.8 of their five-word shingles, through any chain, the least id stays.

    Texts without words and null ids stay; rows that repeat id and text become one, an id's different texts are documents of their own; long texts
    count whole. An empty table stays empty; all columns stay.
    """
    return NearDuplicates(k=5, percent=80).deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go.

    Null and empty texts stay, and so do repeated rows and null ids without such a passage; an empty benchmark removes nothing. All columns stay.
    """
    return Decontaminator().clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts.

    Every row stays, null and empty texts, repeated rows and null ids too; all columns stay, and n_chars follows the text.
    """
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens.

    A null or empty text is the end id alone; repeated rows and null ids are packed as often as they come; long texts are cut over sequences, no id is lost.
    An empty table gives no piece; further columns are not read.
    """
    return packing.pieces(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("packing", pack)]
ORACLE_SQL = None  # trained models and tokenizers have no SQL form; tests/llm checks against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    work, docs, last = Workspace(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, last = work.stage(stage(spark, docs, sf_dir), name), docs
        work.drop(last)
    return docs
