"""Five stages from raw to tokenised documents; each reads what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docspark.llm import decontam, near_dedup, piece, quality, toxicity
from docspark.llm.common import Scratch, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go.

    Each row is judged by its own whole text: null and empty ones by zero statistics, very long ones like all others. Null and repeated ids,
    repeated rows and columns of any names stay with their row. Empty tables give an empty result; without labels all rows stay.
    """
    return quality.keep_good(docs, quality.fit_on(docs, table(spark, sf_dir, "labels")))


def toxicity_chain(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go.

    Each row is judged by its own whole text; null and empty ones have no words. Null and repeated ids, repeated rows and columns of any
    names stay with their row. Empty tables give an empty result; without labels, or with one kind only, no word tells.
    """
    return toxicity.drop_toxic(docs, toxicity.fit_on(docs, table(spark, sf_dir, "labels")))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id.

    Null and empty texts and rows without an id stay; rows that repeat an id are one document; repeated rows that stay, stay repeated. Texts are
    read whole, columns may have any names, empty tables give an empty result.
    """
    return near_dedup.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    Each row is judged by its own whole text, also where ids are null or repeated; null and empty texts stay, columns may have any names.
    Without items all rows stay, empty tables give an empty result.
    """
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with an end id, as digests beside the text that they decode to.

    Null and empty texts give the end id alone, very long ones are read whole, a null id stays null, repeated rows give equal rows, other columns
    are not read. Empty tables give empty results.
    """
    return piece.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("toxicity", toxicity_chain),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: The classifiers, sketches and tokenizers have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each result but the last is written in the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep(docs, f"stage-{i}")
    return docs
