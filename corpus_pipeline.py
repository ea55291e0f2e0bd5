"""A corpus pipeline: each stage works on all that its predecessor kept, and its decisions take effect.

Toxic documents go; of near duplicates one stays; secrets are masked; sources are mixed to their target weights, where a
document may come twice or, at the end of its source's share, be cut; and what is left is packed into sequences.

All stages take null ids, texts, languages and sources, empty and very long texts, repeated rows and an empty table: a null
text counts as empty, a null source is a source of its own, and rows with one id are documents of their own in every stage
but the second, where a class of near duplicates keeps one row. Other columns, whatever their names, go through all stages
but the last unchanged. Labels are read for fitting alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plansheet.llm._common import materialize, table
from plansheet.llm.mixing import mixed
from plansheet.llm.packing import pack_documents
from plansheet.llm.secrets import redacted
from plansheet.llm.simhash import keep_one
from plansheet.llm.tokens import vocabulary
from plansheet.llm.toxicity import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that score 0.5 or more. A null or empty text has a score like any other; the model is fitted on labelled rows with their crc32 fold, whatever else docs holds."""
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of linked fingerprints, the first by id. Null and empty texts have fingerprint zero and are one class; repeated rows are one class."""
    return keep_one(docs)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every span of a secret replaced by a mark and n_chars made to fit. Null texts become empty ones."""
    return redacted(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document. Documents without words are taken no times; a null source comes last among the sources."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 4096 tokens. Each row of docs is packed by itself, so a document taken twice has two pieces of each number."""
    return pack_documents(docs, vocabulary())


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("secret_masking", secret_masking), ("source_mixing", source_mixing), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = materialize(docs, name)
    return docs
