"""From documents to packed training sequences.

Each stage calls one operator of ``quarry.llm`` on all that the stage before it
kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import line_dedup, packing, quality_classifier, secrets, simhash
from quarry.llm.common import read, written
from quarry.session import ship_package

#: SQL can't express the classifier, the fingerprints or the packing; the tests
#: hold every stage against a plain version instead.
ORACLE_SQL = None


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.7 go."""
    ship_package(spark)
    return quality_classifier.keep_quality(docs, read(spark, sf_dir, "labels"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more have go from all of them."""
    ship_package(spark)
    return line_dedup.drop_shared_lines(docs, length_col="n_chars")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group the document with the smallest id stays."""
    ship_package(spark)
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts become the names of their kinds; all documents stay."""
    ship_package(spark)
    return secrets.redact_secrets(docs, length_col="n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the packed sequences."""
    ship_package(spark)
    return packing.best_fit_pack(docs)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("line dedup", drop_shared_lines),
    ("simhash near-dedup", drop_near_copies),
    ("secret scan", redact_secrets),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared
    folder as Parquet and read again as the documents of the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
