"""Row-wise credit columns; nothing here is learned from the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adjudica.functions.attach import stacked
from adjudica.spec import RULES, CreditRules


def _flag(condition: Column) -> Column:
    return condition.cast("long")


def band(value: Column, bands: Sequence[tuple[str, float]], floor: float = 0.0) -> Column:
    """The name of the right-closed band a value falls in; null outside all bands."""
    column = F.when(value <= floor, None)
    for name, limit in bands:
        column = column.when(value <= limit, name)
    return column


def engineer(frame: DataFrame, rules: CreditRules = RULES) -> DataFrame:
    """Add the engineered columns.

    A missing score counts as low, a missing income does not, and a missing employment type counts
    as employed. Products and the ratio stay null where an input is null.
    """
    score, income, loan = (F.col(c) for c in (rules.score, rules.income, rules.loan))
    unemployed = F.col(rules.employment).eqNullSafe(F.lit(rules.unemployed))
    employed = _flag(~unemployed).cast("double")
    return frame.withColumns(
        {
            "credit_score_missing": _flag(score.isNull()),
            "income_missing": _flag(income.isNull()),
            "is_unemployed": _flag(unemployed),
            "low_credit_score": _flag(F.coalesce(score < rules.low_score, F.lit(True))),
            "low_income": _flag(F.coalesce(income < rules.low_income, F.lit(False))),
            "credit_score_x_employed": score * employed,
            "income_x_employed": income * employed,
            "debt_to_income": F.when(
                loan.isNotNull() & income.isNotNull(),
                F.least(loan / F.greatest(income, F.lit(1.0)), F.lit(rules.debt_cap)),
            ),
            "experience_per_age": F.try_divide(F.col(rules.experience), F.col(rules.age)),
            "credit_band": band(score, rules.bands),
        }
    )


def target_correlations(frame: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Pearson correlation of each column with the target, strongest first."""
    row = frame.agg(*[F.corr(F.col(c).cast("double"), F.col(target)).alias(c) for c in columns])
    table = stacked(row, [(F.lit(c), F.col(c)) for c in columns], ("feature", "correlation"))
    return table.orderBy(F.desc(F.abs("correlation")), "feature")


def rate_by(frame: DataFrame, column: str, target: str) -> DataFrame:
    """Target rate and number of rows per value of a column, the null group kept."""
    return frame.groupBy(column).agg(
        F.avg(target).alias("approval_rate"), F.count(F.lit(1)).alias("n")
    )


def subset_rate(frame: DataFrame, condition: Column, target: str) -> DataFrame:
    """Share of rows meeting a condition and their target rate, beside the rate of all rows."""
    met = F.coalesce(condition, F.lit(False))
    return frame.agg(
        F.avg(met.cast("long")).alias("share"),
        F.avg(F.when(met, F.col(target))).alias("subset_rate"),
        F.avg(target).alias("base_rate"),
    )
