"""From documents to packed sequences: quality rules, toxicity, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's documents. All but the last return the columns of documents, those with
names that operators use inside and further ones too.

Defined results in every stage: an empty table gives an empty one; texts are worked on whole, however long;
rows that repeat a key are told apart by their texts; columns that a stage doesn't name are carried along.
What each stage makes of NULLs, empty texts, ties and repeated rows is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import neardup, packing, passages, quality, toxicity
from veilspark.llm.common import read, written

#: SQL has neither the learned grammar of the second stage nor the vocabulary of the last.
ORACLE_SQL = None
#: Near-duplicates share this part of their five-word shingles.
SHINGLE, PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or consist mostly of lines their host repeats; removes such lines from the others, n_chars follows.

    NULL and empty texts fail the base rules and go; a NULL source is the empty one; a line at the limit stays; repeated rows stay or go together.
    """
    return quality.kept_documents(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the clause grammar scores as toxic, at the threshold too.

    A NULL or empty text has the lowest score and stays; a NULL key is scored like others but never learned from; repeated rows stay or go together.
    """
    return toxicity.keep_clean(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps exactly one row of each group of near-duplicates, that with the smallest doc_id.

    A NULL key is the smallest; of rows that share the key the least text hash stays, and of repeated rows one. NULL and
    empty texts are near nothing and stay, but repeated ones once.
    """
    return neardup.without_near_duplicates(docs, shingle=SHINGLE, percent=PERCENT)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that stand elsewhere too out of the texts; n_chars follows.

    No copy is preferred, so ties don't arise and repeated rows lose all their windows; a NULL text becomes the empty one.
    """
    return passages.without_passages(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences, a row for each piece.

    NULL and empty texts have the end id only; a NULL key comes out as NULL; repeated rows are packed each; equal lengths take any order.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
