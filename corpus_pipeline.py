"""The training-data pipeline over the table documents; every stage works on all that the one before kept.

The stages keep rows with null ids, repeated rows and columns of any name,
unless stated below; each gives no rows for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seatrack.llm.base import saved, table
from seatrack.llm.decontaminate import drop_contaminated
from seatrack.llm.exact_dedup import drop_exact_copies
from seatrack.llm.jaccard_join import drop_similar
from seatrack.llm.language import fit_languages, keep_identified
from seatrack.llm.mixing import mixture


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay; null and empty texts, and those without a letter, go."""
    return keep_identified(docs, fit_languages(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays, of rows that repeat or all lack an id one; null counts as empty."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar documents, one stays; null and empty texts all stay, of repeated rows one does."""
    return drop_similar(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts hold none."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents that it takes, with the words it takes of each; a document without a word is never taken."""
    return mixture(docs)


STAGES = [
    ("language_id", identify),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", decontaminated),
    ("source_mix", mixed),
]

#: Seeded hashes pick the blocks of the last stage and trained filters decide the first one, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared scratch folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs)
    return docs
