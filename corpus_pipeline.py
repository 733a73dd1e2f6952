"""Five stages over documents: toxicity, line dedup, n-gram Jaccard join, benchmark decontamination, best-fit packing.

Each stage reads what its predecessor wrote; all but the last return the columns
of ``documents``.  The last returns a row for each packed piece, with its ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from descra.llm import decontaminate, jaccard, kit, line_dedup, packing, toxicity


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5, learned from the labels outside the held-out fold."""
    return toxicity.remove_toxic(docs, docs, kit.read(spark, sf_dir, "labels"))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that a document with a smaller doc_id has."""
    return line_dedup.deduplicate(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles."""
    return jaccard.deduplicate(docs, n=5, percent=80)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth."""
    return decontaminate.decontaminate(docs, kit.read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset of every piece."""
    return packing.place(packing.pieces(docs))


STAGES = [
    ("toxicity", remove_toxic),
    ("line_dedup", remove_repeated_lines),
    ("jaccard_join", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("packing", pack),
]

#: SQL can express neither the tokenizer nor the trained model; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = kit.read(spark, sf_dir, "documents"), None
    for name, step in STAGES:
        with kit.recorded() as made:
            docs = kit.written(step(spark, docs, sf_dir), f"stage-{name}")
        # What the stage wrote last is its result; its own tables, and its predecessor's result, are not needed any more.
        for path in made[:-1] + ([before] if before else []):
            kit.drop(spark, path)
        before = made[-1]
    return docs
