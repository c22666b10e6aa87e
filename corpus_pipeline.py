"""A training-data pipeline over ``documents``: filter, deduplicate, mix and pack.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import minhash, mixing, packing, quality, toxicity
from tallymark.llm.common import on_path, stored

#: Percent of common five-word shingles from which two documents are near-duplicates here.
SIMILARITY = 80
#: The classifiers, packing and connected components have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    on_path(spark)
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    model = toxicity.fit_model(docs, _labels(spark, sf_dir))
    return toxicity.scored(docs, model, "__scored").where(F.col("__scored.predicted") == 0).select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the quality classifier."""
    model = quality.fit_model(docs, _labels(spark, sf_dir))
    return quality.rated(docs, model, into="__rated").where("__rated.kept").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that are SIMILARITY percent alike."""
    on_path(spark)
    return minhash.deduplicated(docs, SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    on_path(spark)
    return packing.packed(docs)


STAGES = [("toxicity", drop_toxic), ("quality", keep_quality), ("near_duplicates", drop_near_duplicates),
          ("mixing", mix_sources), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one stage keeps is stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        docs = stored(docs) if number < len(STAGES) else docs
    return docs
