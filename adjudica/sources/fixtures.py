"""Decision tables derived from the order and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.operators.features import engineer
from adjudica.operators.quality import repair_impossible
from adjudica.spec import APPLICANTS, TableSpec

DOCUMENTS = TableSpec(
    key="doc_id",
    target="quality",
    numeric=("n_chars", "n_words"),
    categorical=("lang", "source"),
    sensitive=("source",),
    integers=("n_chars", "n_words"),
)


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def applicants(spark: SparkSession, folder: str) -> DataFrame:
    """One loan applicant per order, with planted nulls and negatives."""
    orders = load(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"
    )
    places = load(spark, folder, "nation").join(
        load(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    people = (
        load(spark, folder, "customer")
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", "c_acctbal", "r_name")
    )
    joined = orders.join(people, F.col("o_custkey") == F.col("c_custkey"))

    order, person = F.col("o_orderkey"), F.col("o_custkey")
    income = F.col("c_acctbal") * 12
    loan = F.col("o_totalprice") / 10
    score = F.lit(340) + (order * 7919 + person * 104729) % 531
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    favourable = (
        (order % 29 != 0)
        & (score > 580)
        & (priority != "1-URGENT")
        & (order % 23 != 0)
        & (income > 40000)
    )
    approved = F.when(favourable, (order * 17 + person) % 10 != 0).otherwise(
        (order * 13 + person) % 25 == 0
    )
    return joined.select(
        order.alias("applicant_id"),
        (F.lit(21) + person % 49).cast("long").alias("Age"),
        F.when(order % 23 != 0, income).alias("Income"),
        F.when(order % 97 == 0, -loan).otherwise(loan).alias("LoanAmount"),
        F.when(order % 29 != 0, score.cast("double")).alias("CreditScore"),
        ((person * 31 + order) % 41).cast("long").alias("YearsExperience"),
        F.when(person % 2 == 0, "Male").otherwise("Female").alias("Gender"),
        F.when(order % 25 == 0, None)
        .when(status == "F", "High School")
        .when(status == "O", "Bachelors")
        .otherwise("Masters")
        .alias("Education"),
        F.col("r_name").alias("City"),
        F.when(priority == "1-URGENT", "Unemployed")
        .when(priority.isin("2-HIGH", "3-MEDIUM"), "Self-Employed")
        .otherwise("Salaried")
        .alias("EmploymentType"),
        approved.cast("long").alias("LoanApproved"),
    )


def repaired(spark: SparkSession, folder: str) -> DataFrame:
    return repair_impossible(applicants(spark, folder), APPLICANTS.nonnegative)


def engineered(spark: SparkSession, folder: str) -> DataFrame:
    return engineer(repaired(spark, folder))


def scorecard(frame: DataFrame) -> DataFrame:
    """A fixed score ``p`` with many ties, for metrics that need no fitted model."""
    points = (
        F.lit(5)
        + F.when(F.col("EmploymentType") == "Unemployed", 0).otherwise(30)
        + F.when(F.col("CreditScore") >= 580, 25).otherwise(0)
        + F.when(F.col("Income") >= 40000, 20).otherwise(0)
        + (F.col("applicant_id") * 37) % 20
    )
    return frame.withColumn("p", points.cast("double") / 100)


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A second decision table of another shape: documents with a quality label."""
    documents = load(spark, folder, "documents")
    return documents.join(load(spark, folder, "labels"), "doc_id").select(
        "doc_id",
        "n_chars",
        F.size(F.split("text", " ")).cast("long").alias("n_words"),
        "lang",
        "source",
        F.col("quality").cast("long").alias("quality"),
    )
