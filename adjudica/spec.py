"""What a table means: roles of its columns, and the knobs of an analysis."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T


@dataclass(frozen=True)
class TableSpec:
    """Roles of the columns of a decision table.

    ``numeric`` and ``categorical`` are model inputs, ``target`` is the 0/1 decision, ``sensitive``
    columns are kept for audits but never given to a model, and a negative value in a
    ``nonnegative`` column is impossible.
    """

    key: str
    target: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    sensitive: tuple[str, ...] = ()
    nonnegative: tuple[str, ...] = ()
    integers: tuple[str, ...] = ()

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    @property
    def candidates(self) -> list[str]:
        """Model inputs without the sensitive ones."""
        return [c for c in self.features if c not in self.sensitive]

    def split_types(self, columns) -> tuple[list[str], list[str]]:
        """The numeric and the categorical columns among ``columns``, in the spec's order."""
        wanted = set(columns)
        return (
            [c for c in self.numeric if c in wanted],
            [c for c in self.categorical if c in wanted],
        )

    def with_features(self, numeric=(), categorical=()) -> "TableSpec":
        return replace(
            self,
            numeric=(*self.numeric, *numeric),
            categorical=(*self.categorical, *categorical),
        )

    def types(self) -> dict[str, T.DataType]:
        declared: dict[str, T.DataType] = {self.key: T.LongType()}
        for c in self.numeric:
            declared[c] = T.LongType() if c in self.integers else T.DoubleType()
        for c in self.categorical:
            declared[c] = T.StringType()
        declared[self.target] = T.LongType()
        return declared


# The applicants table, its roles, and the columns engineered from it.
APPLICANTS = TableSpec(
    key="applicant_id",
    target="LoanApproved",
    numeric=("Age", "Income", "LoanAmount", "CreditScore", "YearsExperience"),
    categorical=("Gender", "Education", "City", "EmploymentType"),
    sensitive=("Gender", "City"),
    nonnegative=("Income", "LoanAmount"),
    integers=("Age", "YearsExperience"),
)
ENGINEERED_NUMERIC = (
    "debt_to_income",
    "experience_per_age",
    "credit_score_x_employed",
    "income_x_employed",
    "credit_score_missing",
    "income_missing",
    "is_unemployed",
    "low_credit_score",
    "low_income",
)
ENGINEERED_CATEGORICAL = ("credit_band",)
ENGINEERED = APPLICANTS.with_features(ENGINEERED_NUMERIC, ENGINEERED_CATEGORICAL)


@dataclass(frozen=True)
class Knobs:
    """Defaults of an analysis (fixed values)."""

    seed: int = 42
    informative_delta: float = 0.05
    signal_information: float = 0.01
    holdout: float = 0.2
    folds: int = 5
    threshold: float = 0.5
    false_approval_cost: float = 5.0
    false_rejection_cost: float = 1.0
    trials: int = 30
    contamination: float = 0.01
    votes: int = 2
    bottleneck: int = 3
    network_steps: int = 500
    resamples: int = 500
    fair_ratio: float = 0.8
    permutation_repeats: int = 5
    top_reasons: int = 3


@dataclass(frozen=True)
class CreditRules:
    """Inputs and cut-offs of the engineered credit columns (fixed values)."""

    score: str = "CreditScore"
    income: str = "Income"
    loan: str = "LoanAmount"
    experience: str = "YearsExperience"
    age: str = "Age"
    employment: str = "EmploymentType"
    unemployed: str = "Unemployed"
    low_score: float = 580.0
    low_income: float = 40_000.0
    debt_cap: float = 5.0
    bands: tuple[tuple[str, float], ...] = field(
        default=(
            ("poor", 500.0),
            ("fair", 580.0),
            ("near_prime", 670.0),
            ("prime", 740.0),
            ("super_prime", 850.0),
        )
    )


# Wording a reader sees for each column in a decision reason.
READABLE_NAMES = {
    "CreditScore": "credit score",
    "EmploymentType": "employment",
    "Income": "income",
    "LoanAmount": "loan amount",
    "YearsExperience": "years of experience",
    "Age": "age",
    "Education": "education",
    "credit_score_missing": "missing credit score",
    "income_missing": "missing income",
    "is_unemployed": "unemployed",
    "low_credit_score": "low credit score",
    "low_income": "low income",
    "credit_score_x_employed": "credit score while employed",
    "income_x_employed": "income while employed",
    "debt_to_income": "debt-to-income ratio",
    "experience_per_age": "experience relative to age",
    "credit_band": "credit band",
}

KNOBS = Knobs()
RULES = CreditRules()
