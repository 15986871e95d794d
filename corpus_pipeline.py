"""A training corpus from ``documents`` in five stages, each written as Parquet before the next one reads it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave.llm import language, mixing, packing, repeats, simhash
from auditweave.llm.base import held_out
from auditweave.plans.joins import stored

#: Bytes of a passage that recurs: below the length of 50 words in the shortest-worded of the languages.
PASSAGE_BYTES = 240


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels teach; texts without letters or in no clear language go."""
    model = language.fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return language.in_known_languages(docs, model)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints are linked within two bits."""
    return simhash.without_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that recur; a document of nothing else goes."""
    return repeats.without_repeats(docs, PASSAGE_BYTES)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document and epoch, by the sources' target weights and in training order."""
    return mixing.curriculum(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs)


STAGES = [
    ("language", identify),
    ("near_duplicates", deduplicate),
    ("repeats", cut_repeats),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL cannot express the models, fingerprints and tokens of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
