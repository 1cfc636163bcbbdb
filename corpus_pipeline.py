"""The corpus pipeline: quality rules, near duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. Its result is
written as Parquet and read back as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.llm import decontaminate, near_duplicates, packing, quality_rules, surrogates
from adjudica.llm.queries import SURROGATE_KEY, vocabulary_path
from adjudica.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base checks and the threshold table."""
    return quality_rules.judge(docs).where("kept").select("row.*")


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest id."""
    return near_duplicates.without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates; ``n_chars`` follows the new text."""
    replaced = surrogates.replace_personal_data(docs, SURROGATE_KEY)
    new = {"text": F.col("new_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("new_text").cast(docs.schema["n_chars"].dataType)
    frame = replaced.select("row", F.col("text").alias("new_text"))
    return frame.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens, ids included."""
    return packing.pack_documents(docs, vocabulary_path())


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicate_groups),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("packing", sequences),
]

#: Packing is not expressible in SQL. The operators are tested against brute force; the test of the stages
#: checks columns, that rows only go, and that packed ids are those of the documents kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
