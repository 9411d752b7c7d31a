"""A corpus pipeline of the training-data operators: each stage's result is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cityloom.llm.common import settled, table
from cityloom.llm.jaccard import one_of_each
from cityloom.llm.mixing import mixed_documents
from cityloom.llm.packing import pack_documents, vocabulary_path
from cityloom.llm.secrets import redacted
from cityloom.llm.toxicity import fitted, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model predicts toxic go."""
    return without_toxic(docs, fitted(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, Jaccard similarity of 0.8 and more."""
    return one_of_each(docs, width=5, percent=80)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark."""
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with the words it takes."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token pieces, packed into sequences."""
    return pack_documents(docs, vocabulary_path())


STAGES = [
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_copies),
    ("secret scans", secret_spans),
    ("mixing sources to target weights", mixing),
    ("best-fit packing", packing),
]

#: Learned scores, automata, compressed lengths and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
