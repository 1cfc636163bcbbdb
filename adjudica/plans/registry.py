"""Named queries over the given tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The steps every SQL twin may start from; a step uses the ones before it.
STEPS = {
    "applicants": """
SELECT o.o_orderkey AS applicant_id,
       CAST(21 + o.o_custkey % 49 AS BIGINT) AS Age,
       CASE WHEN o.o_orderkey % 23 = 0 THEN NULL ELSE c.c_acctbal * 12 END AS Income,
       CASE WHEN o.o_orderkey % 97 = 0 THEN -o.o_totalprice / 10 ELSE o.o_totalprice / 10 END AS LoanAmount,
       CASE WHEN o.o_orderkey % 29 = 0 THEN NULL
            ELSE CAST(340 + (o.o_orderkey * 7919 + o.o_custkey * 104729) % 531 AS DOUBLE) END AS CreditScore,
       CAST((o.o_custkey * 31 + o.o_orderkey) % 41 AS BIGINT) AS YearsExperience,
       CASE WHEN o.o_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS Gender,
       CASE WHEN o.o_orderkey % 25 = 0 THEN NULL WHEN o.o_orderstatus = 'F' THEN 'High School'
            WHEN o.o_orderstatus = 'O' THEN 'Bachelors' ELSE 'Masters' END AS Education,
       r.r_name AS City,
       CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'Unemployed'
            WHEN o.o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'Self-Employed' ELSE 'Salaried' END AS EmploymentType,
       CAST(CASE WHEN (CASE WHEN o.o_orderkey % 29 <> 0 AND 340 + (o.o_orderkey * 7919 + o.o_custkey * 104729) % 531 > 580
                             AND o.o_orderpriority <> '1-URGENT' AND o.o_orderkey % 23 <> 0 AND c.c_acctbal * 12 > 40000
                        THEN (o.o_orderkey * 17 + o.o_custkey) % 10 <> 0
                        ELSE (o.o_orderkey * 13 + o.o_custkey) % 25 = 0 END) THEN 1 ELSE 0 END AS BIGINT) AS LoanApproved
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "repaired": """
SELECT * REPLACE (CASE WHEN Income < 0 THEN NULL ELSE Income END AS Income,
                  CASE WHEN LoanAmount < 0 THEN NULL ELSE LoanAmount END AS LoanAmount)
FROM applicants""",
    "engineered": """
SELECT *,
       CAST(CreditScore IS NULL AS BIGINT) AS credit_score_missing,
       CAST(Income IS NULL AS BIGINT) AS income_missing,
       CAST(coalesce(EmploymentType = 'Unemployed', false) AS BIGINT) AS is_unemployed,
       CAST(CreditScore IS NULL OR CreditScore < 580 AS BIGINT) AS low_credit_score,
       CAST(coalesce(Income < 40000, false) AS BIGINT) AS low_income,
       CreditScore * CASE WHEN EmploymentType = 'Unemployed' THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS credit_score_x_employed,
       Income * CASE WHEN EmploymentType = 'Unemployed' THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS income_x_employed,
       CASE WHEN LoanAmount IS NULL OR Income IS NULL THEN NULL
            WHEN LoanAmount / CASE WHEN Income < 1 THEN CAST(1 AS DOUBLE) ELSE Income END > 5 THEN CAST(5 AS DOUBLE)
            ELSE LoanAmount / CASE WHEN Income < 1 THEN CAST(1 AS DOUBLE) ELSE Income END END AS debt_to_income,
       CASE WHEN Age = 0 THEN NULL ELSE CAST(YearsExperience AS DOUBLE) / Age END AS experience_per_age,
       CASE WHEN CreditScore <= 0 THEN NULL WHEN CreditScore <= 500 THEN 'poor' WHEN CreditScore <= 580 THEN 'fair'
            WHEN CreditScore <= 670 THEN 'near_prime' WHEN CreditScore <= 740 THEN 'prime'
            WHEN CreditScore <= 850 THEN 'super_prime' END AS credit_band
FROM repaired""",
    "scored": """
SELECT *, LoanApproved AS y,
       CAST(5 + CASE WHEN EmploymentType = 'Unemployed' THEN 0 ELSE 30 END
              + CASE WHEN CreditScore >= 580 THEN 25 ELSE 0 END
              + CASE WHEN Income >= 40000 THEN 20 ELSE 0 END
              + (applicant_id * 37) % 20 AS DOUBLE) / 100 AS p
FROM engineered""",
    "classified": """
SELECT *, CAST(p >= 0.5 AS BIGINT) AS predicted,
       CASE WHEN p >= 0.5 THEN CASE WHEN y = 1 THEN 'true_positive' ELSE 'false_positive' END
            ELSE CASE WHEN y = 1 THEN 'false_negative' ELSE 'true_negative' END END AS outcome,
       (p >= 0.5) <> (y = 1) AS is_error,
       abs(p - y) AS confidence_error
FROM scored""",
    "contributions": """
SELECT applicant_id, 'low_credit_score' AS feature, CAST(low_credit_score AS DOUBLE) AS value,
       (low_credit_score - (SELECT avg(low_credit_score) FROM engineered)) * -0.25 AS contribution FROM engineered
UNION ALL
SELECT applicant_id, 'low_income', CAST(low_income AS DOUBLE),
       (low_income - (SELECT avg(low_income) FROM engineered)) * -0.2 FROM engineered
UNION ALL
SELECT applicant_id, 'is_unemployed', CAST(is_unemployed AS DOUBLE),
       (is_unemployed - (SELECT avg(is_unemployed) FROM engineered)) * -0.3 FROM engineered
UNION ALL
SELECT applicant_id, 'EmploymentType_Self-Employed', CAST(CAST(EmploymentType = 'Self-Employed' AS INTEGER) AS DOUBLE),
       (CAST(EmploymentType = 'Self-Employed' AS INTEGER) -
        (SELECT avg(CAST(EmploymentType = 'Self-Employed' AS INTEGER)) FROM engineered)) * 0.05 FROM engineered""",
    "audit": """
SELECT attribute, grp AS "group", count(*) AS applicants,
       round(avg(CAST(predicted = 1 AS INTEGER)), 3) AS selection_rate,
       round(avg(CAST(is_error AS INTEGER)), 3) AS error_rate,
       round(avg(CAST(outcome = 'false_positive' AS INTEGER)), 3) AS false_positive_rate,
       round(avg(CAST(outcome = 'false_negative' AS INTEGER)), 3) AS false_negative_rate
FROM (SELECT 'Gender' AS attribute, Gender AS grp, * FROM classified
      UNION ALL SELECT 'City', City, * FROM classified) t
WHERE grp IS NOT NULL GROUP BY attribute, grp""",
}
NEEDS = {
    "applicants": [],
    "repaired": ["applicants"],
    "engineered": ["applicants", "repaired"],
    "scored": ["applicants", "repaired", "engineered"],
    "classified": ["applicants", "repaired", "engineered", "scored"],
    "contributions": ["applicants", "repaired", "engineered"],
    "audit": ["applicants", "repaired", "engineered", "scored", "classified"],
}


def steps(*names: str, **extra: str) -> str:
    """A WITH clause holding the named steps, what they need, and further named queries."""
    order: list[str] = []
    for name in names:
        for step in [*NEEDS[name], name]:
            if step not in order:
                order.append(step)
    parts = [f"{n} AS ({STEPS[n].strip()})" for n in order]
    parts += [f"{n} AS ({text.strip()})" for n, text in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and its SQL twin if there is one."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def rounded(frame: DataFrame, places: int = 6) -> DataFrame:
    """Round every double, so that two engines' last digits compare equal."""
    return frame.select(
        *[
            F.round(F.col(f.name), places).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in frame.schema
        ]
    )
