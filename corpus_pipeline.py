"""The corpus pipeline: toxicity, exact and near deduplication, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``. ``run`` writes each stage's result to
the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from edgewise.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from edgewise.llm.common import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from ``labels`` of the given documents.

    Null and empty texts stay, repeated rows stay or go together, an empty
    table stays empty. Without labels of both classes nothing goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn_from_tables(docs, labels)
    return toxicity.drop_toxic(docs, model)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text, that of the smallest id.

    Null and empty texts are one text; of repeated rows one stays, by the order
    of all columns; an empty table stays empty.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked documents.

    Texts without words (null, empty) stay; rows repeated exactly stay or go
    together; an empty table stays empty.
    """
    return near_dedup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents so that sources come near their target weights, in global hash order.

    A null source is a source, a null id draws as the empty string, repeated
    rows draw alike; an empty table stays empty.
    """
    return mixing.mix_sources(docs, copy_col=None, order_col=None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences.

    Null and empty texts are the end id alone; repeated rows are pieces of
    their own; an empty table gives no pieces.
    """
    return packing.pack_documents(docs, 1024)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_exact), ("near dedup", drop_near), ("mixing", mix), ("packing", pack)]
#: A learned model and a trained tokenizer are beyond SQL; ``tests/llm`` holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
