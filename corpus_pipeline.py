"""From raw documents to packed training sequences.

Stages: documents that the quality classifier rejects go; of exact copies the one with the largest id stays; of each group of near
copies (five-word n-grams, Jaccard similarity 0.8 or more) the one with the smallest id stays; secrets are replaced in the texts;
the texts are packed. Each stage works on all that the one before it kept, and is written to the shared folder before the next. Every
stage takes empty tables (and gives none), other columns, and names that its operator uses inside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dimstar.functions.runtime import materialize
from dimstar.llm import exact_dedup, ngram_join, packing, quality, queries, secrets


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores 0.5 or more; the model is fitted on the labelled rows of `docs` that aren't held out.

    Null and empty texts are scored as empty ones; repeated rows go or stay together; rows with a null id are scored like any other.
    """
    return quality.keep_good(docs, quality.train_quality(docs, queries.table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each text, that of the largest id; one without an id only where no row of the text has one. Null counts as empty."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row of the smallest id, one without an id only where no row has one; texts without words stay."""
    return ngram_join.keep_one_per_component(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts replaced and n_chars counted anew; a null text stays null."""
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their places in sequences; a null text is one piece of one token, repeated rows are packed each."""
    return packing.pack_documents(docs, queries.public_vocabulary())


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack),
]

#: SQL can express neither the fitted models nor the tokeniser.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that the stages keep."""
    docs = queries.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{i}")
    return docs
