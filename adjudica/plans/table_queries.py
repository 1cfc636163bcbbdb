"""Queries over the table itself: sources, repair, engineered columns, profile, association."""

from __future__ import annotations

from pyspark.sql import functions as F

from adjudica.operators import association, features, outliers, profile, quality, splits
from adjudica.plans.registry import query, rounded, steps
from adjudica.session import new_path
from adjudica.sources import fixtures, tables
from adjudica.spec import APPLICANTS, ENGINEERED, ENGINEERED_NUMERIC

NUMERIC = APPLICANTS.numeric
CATEGORICAL = APPLICANTS.categorical
TARGET = APPLICANTS.target


def per_column(columns, text: str, joiner: str = "\nUNION ALL\n") -> str:
    """The text once per column, ``{c}`` replaced by the column."""
    return joiner.join(text.replace("{c}", c) for c in columns)


APPLICANT_COLUMNS = (
    "applicant_id, Age, round(Income, 6) AS Income, round(LoanAmount, 6) AS LoanAmount, CreditScore, "
    "YearsExperience, Gender, Education, City, EmploymentType, LoanApproved"
)


@query("typed_read", steps("applicants") + f"SELECT {APPLICANT_COLUMNS} FROM applicants")
def typed_read(spark, folder):
    """Write as CSV text, read back typed: nulls, numbers and categories must survive."""
    path = new_path(spark, "csv")
    tables.write_csv(fixtures.applicants(spark, folder), path)
    frame = tables.read_table(spark, path, APPLICANTS)
    return rounded(tables.check_whole_numbers(frame, APPLICANTS))


@query("parquet_round_trip", steps("repaired") + f"SELECT {APPLICANT_COLUMNS} FROM repaired")
def parquet_round_trip(spark, folder):
    path = new_path(spark, "parquet") + ".parquet"
    tables.write_parquet(fixtures.repaired(spark, folder), path)
    return rounded(tables.training_input(spark, APPLICANTS, path))


@query(
    "scoring_projection",
    steps("applicants")
    + "SELECT applicant_id, Age, round(Income, 6) AS Income, round(LoanAmount, 6) AS LoanAmount, "
    "CreditScore, YearsExperience, Gender, Education, City, EmploymentType "
    "FROM applicants ORDER BY applicant_id LIMIT 100",
)
def scoring_projection(spark, folder):
    frame = tables.project_features(fixtures.applicants(spark, folder), APPLICANTS)
    return rounded(tables.first_rows(frame, APPLICANTS.key, 100))


@query(
    "impossible_counts",
    steps("applicants")
    + "SELECT count(*) FILTER (Income < 0) AS Income, count(*) FILTER (LoanAmount < 0) AS LoanAmount FROM applicants",
)
def impossible_counts(spark, folder):
    return quality.count_impossible(fixtures.applicants(spark, folder), APPLICANTS.nonnegative)


@query("repaired", steps("repaired") + f"SELECT {APPLICANT_COLUMNS} FROM repaired")
def repaired(spark, folder):
    return rounded(fixtures.repaired(spark, folder))


@query(
    "engineered",
    steps("engineered")
    + f"SELECT {APPLICANT_COLUMNS}, credit_score_missing, income_missing, is_unemployed, low_credit_score, "
    "low_income, credit_score_x_employed, round(income_x_employed, 6) AS income_x_employed, "
    "round(debt_to_income, 6) AS debt_to_income, round(experience_per_age, 6) AS experience_per_age, "
    "credit_band FROM engineered",
)
def engineered(spark, folder):
    return rounded(fixtures.engineered(spark, folder))


@query(
    "engineered_corr",
    steps("engineered")
    + per_column(
        ENGINEERED_NUMERIC,
        "SELECT '{c}' AS feature, round(corr(CAST({c} AS DOUBLE), LoanApproved), 6) AS correlation FROM engineered",
    ),
)
def engineered_corr(spark, folder):
    frame = fixtures.engineered(spark, folder)
    return rounded(features.target_correlations(frame, ENGINEERED_NUMERIC, TARGET))


@query(
    "rate_by_credit_band",
    steps("engineered")
    + "SELECT credit_band, round(avg(LoanApproved), 6) AS approval_rate, count(*) AS n FROM engineered GROUP BY credit_band",
)
def rate_by_credit_band(spark, folder):
    return rounded(features.rate_by(fixtures.engineered(spark, folder), "credit_band", TARGET))


@query(
    "favourable_share",
    steps("repaired")
    + """SELECT round(avg(CAST(f AS INTEGER)), 6) AS share,
       round(avg(CASE WHEN f THEN LoanApproved END), 6) AS subset_rate,
       round(avg(LoanApproved), 6) AS base_rate
FROM (SELECT LoanApproved, coalesce(CreditScore > 580 AND EmploymentType <> 'Unemployed' AND Income > 40000, false) AS f
      FROM repaired) t""",
)
def favourable_share(spark, folder):
    condition = (
        (F.col("CreditScore") > 580)
        & (F.col("EmploymentType") != "Unemployed")
        & (F.col("Income") > 40000)
    )
    return rounded(features.subset_rate(fixtures.repaired(spark, folder), condition, TARGET))


@query(
    "overview",
    steps("repaired")
    + """SELECT count(*) AS rows, CAST(4 AS BIGINT) AS columns,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT Gender, Education, City, EmploymentType FROM repaired) d)
         AS duplicate_rows FROM repaired""",
)
def overview(spark, folder):
    """Over the categorical columns alone, where nearly every row repeats an earlier one."""
    return profile.overview(fixtures.repaired(spark, folder).select(*CATEGORICAL))


@query(
    "overview_all_columns",
    steps("repaired")
    + """SELECT count(*) AS rows, CAST(10 AS BIGINT) AS columns,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (applicant_id) FROM repaired) d) AS duplicate_rows
FROM repaired""",
)
def overview_all_columns(spark, folder):
    return profile.overview(fixtures.repaired(spark, folder), APPLICANTS.key)


@query(
    "numeric_summary",
    steps("repaired")
    + per_column(
        NUMERIC,
        """SELECT '{c}' AS feature, round((count(*) - count({c})) * 100.0 / count(*), 6) AS missing_pct,
       round(CAST(min({c}) AS DOUBLE), 6) AS min, round(CAST(quantile_cont(CAST({c} AS DOUBLE), 0.5) AS DOUBLE), 6) AS median,
       round(CAST(max({c}) AS DOUBLE), 6) AS max, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
       round(skewness({c}), 6) AS skew, round(kurtosis({c}), 6) AS kurtosis FROM repaired""",
    ),
)
def numeric_summary(spark, folder):
    return rounded(profile.numeric_summary(fixtures.repaired(spark, folder), NUMERIC))


@query(
    "categorical_summary",
    steps(
        "repaired",
        counts=per_column(
            CATEGORICAL,
            "SELECT '{c}' AS feature, {c} AS value, count(*) AS n FROM repaired GROUP BY {c}",
        ),
        ranked="""SELECT *, row_number() OVER (PARTITION BY feature ORDER BY (value IS NULL), n DESC, value) AS rn,
       sum(n) OVER (PARTITION BY feature) AS total FROM counts""",
    )
    + """SELECT feature, count(value) AS cardinality,
       round(CAST(sum(CASE WHEN value IS NULL THEN n ELSE 0 END) AS DOUBLE) * 100 / CAST(max(total) AS DOUBLE), 6) AS missing_pct,
       max(CASE WHEN rn = 1 THEN value END) AS mode,
       round(CAST(max(CASE WHEN rn = 1 THEN n END) AS DOUBLE) * 100 / CAST(max(total) AS DOUBLE), 6) AS mode_pct
FROM ranked GROUP BY feature""",
)
def categorical_summary(spark, folder):
    return rounded(profile.categorical_summary(fixtures.repaired(spark, folder), CATEGORICAL))


@query(
    "category_counts",
    steps("repaired")
    + "SELECT * FROM ("
    + per_column(
        CATEGORICAL,
        "SELECT '{c}' AS feature, {c} AS value, count(*) AS n FROM repaired GROUP BY {c}",
    )
    + ") t",
)
def category_counts(spark, folder):
    return profile.category_counts(fixtures.repaired(spark, folder), CATEGORICAL)


@query(
    "missingness",
    steps("repaired")
    + "SELECT feature, missing_count, round(missing_count * 100.0 / n, 6) AS missing_pct FROM ("
    + per_column(
        [*NUMERIC, *CATEGORICAL, TARGET],
        "SELECT '{c}' AS feature, count(*) - count({c}) AS missing_count, count(*) AS n FROM repaired",
    )
    + ") t WHERE missing_count > 0",
)
def missingness(spark, folder):
    frame = fixtures.repaired(spark, folder)
    return rounded(profile.missingness(frame, [*NUMERIC, *CATEGORICAL, TARGET]))


@query(
    "missing_mechanism",
    steps("repaired")
    + """SELECT feature, round(missing * 100.0 / n, 6) AS missing_pct, round(rp, 6) AS rate_present, round(rm, 6) AS rate_missing,
       round(rm - rp, 6) AS delta, round(base, 6) AS base_rate,
       CASE WHEN abs(rm - rp) >= 0.05 THEN 'informative' ELSE 'at random' END AS mechanism FROM ("""
    + per_column(
        [*NUMERIC, *CATEGORICAL],
        """SELECT '{c}' AS feature, count(*) - count({c}) AS missing, count(*) AS n,
       avg(CASE WHEN {c} IS NOT NULL THEN LoanApproved END) AS rp, avg(CASE WHEN {c} IS NULL THEN LoanApproved END) AS rm,
       avg(LoanApproved) AS base FROM repaired""",
    )
    + ") t WHERE missing > 0",
)
def missing_mechanism(spark, folder):
    frame = fixtures.repaired(spark, folder)
    return rounded(profile.missing_mechanism(frame, TARGET, [*NUMERIC, *CATEGORICAL]))


OUTLIER_SQL = per_column(
    NUMERIC,
    """SELECT '{c}' AS feature, count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1)) AS iqr_low,
       count(*) FILTER ({c} > q3 + 1.5 * (q3 - q1)) AS iqr_high,
       count(*) FILTER (abs(({c} - m) / s) > 3) AS z_over_3,
       count(*) FILTER ({c} < 0 AND '{c}' IN ('Income', 'LoanAmount')) AS impossible_negative
FROM applicants, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3,
                         avg({c}) AS m, stddev_samp({c}) AS s FROM applicants) f""",
)


@query("outlier_summary", steps("applicants") + OUTLIER_SQL)
def outlier_summary(spark, folder):
    frame = fixtures.applicants(spark, folder)
    return profile.outlier_summary(frame, NUMERIC, APPLICANTS.nonnegative)


def _band_sql(source: str, column: str, bins: int) -> str:
    shares = ", ".join(repr(i / bins) for i in range(bins + 1))
    return f"""edges AS (SELECT list_sort(list_distinct(quantile_cont(CAST({column} AS DOUBLE), [{shares}]))) AS e FROM {source}),
banded AS (SELECT t.*, e, CAST(len(list_filter(e[2:len(e) - 1], lambda x: x < {column})) AS INTEGER) AS band
           FROM {source} t, edges WHERE {column} IS NOT NULL)"""


def _rate_by_band_sql(source: str, column: str, bins: int) -> str:
    return (
        steps(source).rstrip()
        + ",\n"
        + _band_sql(source, column, bins)
        + """
SELECT band, round(any_value(e[band + 1]), 6) AS low, round(any_value(e[band + 2]), 6) AS high,
       round(avg(LoanApproved), 6) AS approval_rate, count(*) AS n FROM banded GROUP BY band"""
    )


@query("rate_by_quantile_band", _rate_by_band_sql("repaired", "Income", 5))
def rate_by_quantile_band(spark, folder):
    return rounded(
        profile.rate_by_quantile_band(fixtures.repaired(spark, folder), "Income", TARGET, 5)
    )


@query("rate_by_score_band", _rate_by_band_sql("repaired", "CreditScore", 7))
def rate_by_score_band(spark, folder):
    return rounded(
        profile.rate_by_quantile_band(fixtures.repaired(spark, folder), "CreditScore", TARGET, 7)
    )


RATE_SQL = (
    "SELECT EmploymentType, ROUND(AVG(LoanApproved), 3) AS approval_rate, COUNT(*) AS n "
    "FROM applicants GROUP BY EmploymentType ORDER BY approval_rate DESC"
)


@query("rate_by_employment", steps("applicants") + RATE_SQL)
def rate_by_employment(spark, folder):
    return tables.run_sql(fixtures.applicants(spark, folder), RATE_SQL)


def cramers_sql(source: str, columns, other: str) -> str:
    return per_column(
        columns,
        f"""SELECT '{{c}}' AS feature, round(coalesce(CASE WHEN least(kx, ky) < 2 THEN 0
         ELSE sqrt(greatest(s - 1, 0) / (least(kx, ky) - 1)) END, 0), 6) AS cramers_v
FROM (SELECT sum(CAST(n AS DOUBLE) * n / (CAST(nx AS DOUBLE) * CAST(ny AS DOUBLE))) AS s, count(DISTINCT x) AS kx, count(DISTINCT y) AS ky
      FROM (SELECT x, y, n, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny
            FROM (SELECT {{c}} AS x, {other} AS y, count(*) AS n FROM {source}
                  WHERE {{c}} IS NOT NULL AND {other} IS NOT NULL GROUP BY {{c}}, {other}) a) b) c""",
    )


@query("cramers_v", steps("repaired") + cramers_sql("repaired", CATEGORICAL, TARGET))
def cramers_v(spark, folder):
    return rounded(
        association.cramers_v(fixtures.repaired(spark, folder), CATEGORICAL, TARGET)
    )


@query(
    "correlation_ratio",
    steps("repaired")
    + per_column(
        NUMERIC,
        """SELECT '{c}' AS feature, round(coalesce(sqrt(sum(CASE WHEN g IS NOT NULL THEN n * (m - gm) * (m - gm) ELSE 0 END) / max(sst)), 0), 6) AS correlation_ratio
FROM (SELECT Education AS g, count({c}) AS n, avg({c}) AS m FROM repaired WHERE {c} IS NOT NULL GROUP BY Education) a,
     (SELECT avg({c}) AS gm, var_pop({c}) * count({c}) AS sst FROM repaired) b""",
    ),
)
def correlation_ratio(spark, folder):
    return rounded(
        association.correlation_ratio(fixtures.repaired(spark, folder), "Education", NUMERIC)
    )


def auc_sql(source: str, columns, target: str) -> str:
    return per_column(
        columns,
        f"""SELECT '{{c}}' AS feature, round(sum(o * (zb + z / 2.0)) / (CAST(sum(o) AS DOUBLE) * CAST(sum(z) AS DOUBLE)), 6) AS auc
FROM (SELECT o, z, CAST(coalesce(sum(z) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS zb
      FROM (SELECT {{c}} AS v, CAST(sum({target}) AS DOUBLE) AS o, CAST(sum(1 - {target}) AS DOUBLE) AS z
            FROM {source} WHERE {{c}} IS NOT NULL GROUP BY {{c}}) a) b""",
    )


@query("feature_auc", steps("repaired") + auc_sql("repaired", NUMERIC, TARGET))
def feature_auc(spark, folder):
    return rounded(association.feature_auc(fixtures.repaired(spark, folder), NUMERIC, TARGET))


def information_sql(source: str, numeric, categorical, target: str, bins: int = 10) -> str:
    """The twin of ``binned_information``: coded columns, then one plug-in sum per column."""
    shares = ", ".join(repr(i / bins) for i in range(bins + 1))
    coded = [
        f"""SELECT '{c}' AS feature, CAST(len(list_filter(e[2:len(e) - 1], lambda x: x < coalesce(CAST({c} AS DOUBLE), md))) AS VARCHAR) AS v, {target} AS t
FROM {source}, (SELECT list_sort(list_distinct(quantile_cont(CAST({c} AS DOUBLE), [{shares}]))) AS e,
                       quantile_cont(CAST({c} AS DOUBLE), 0.5) AS md FROM {source}) q"""
        for c in numeric
    ] + [
        f"SELECT '{c}' AS feature, coalesce({c}, '(missing)') AS v, {target} AS t FROM {source}"
        for c in categorical
    ]
    return f"""(SELECT feature, greatest(sum(n / tot * ln(n * tot / (nv * nt))), 0) AS mutual_info
FROM (SELECT feature, n, CAST(sum(n) OVER (PARTITION BY feature) AS DOUBLE) AS tot,
             CAST(sum(n) OVER (PARTITION BY feature, v) AS DOUBLE) AS nv,
             CAST(sum(n) OVER (PARTITION BY feature, t) AS DOUBLE) AS nt
      FROM (SELECT feature, v, t, CAST(count(*) AS DOUBLE) AS n FROM ({" UNION ALL ".join(coded)}) c GROUP BY feature, v, t) a) b
GROUP BY feature)"""


ALL_NUMERIC, ALL_CATEGORICAL = ENGINEERED.split_types(ENGINEERED.candidates)


@query(
    "binned_mi",
    steps("engineered")
    + "SELECT feature, round(mutual_info, 6) AS mutual_info FROM "
    + information_sql("engineered", ALL_NUMERIC, ALL_CATEGORICAL, TARGET)
    + " m",
)
def binned_mi(spark, folder):
    """The filter ranking of every original and engineered candidate."""
    return rounded(
        association.binned_information(
            fixtures.engineered(spark, folder),
            ENGINEERED,
            numeric=ALL_NUMERIC,
            categorical=ALL_CATEGORICAL,
        )
    )


def association_sql(source: str, numeric, categorical, target: str) -> str:
    return f"""SELECT m.feature AS feature, type, mutual_info, auc_or_cramers_v,
       CASE WHEN mutual_info >= 0.01 THEN 'signal' ELSE 'noise' END AS signal
FROM {information_sql(source, numeric, categorical, target)} m
JOIN (SELECT feature, 'numeric' AS type, auc AS auc_or_cramers_v FROM ({auc_sql(source, numeric, target)}) a
      UNION ALL SELECT feature, 'categorical', cramers_v FROM ({cramers_sql(source, categorical, target)}) v) s
ON m.feature = s.feature"""


@query(
    "association",
    steps("repaired", assoc=association_sql("repaired", NUMERIC, CATEGORICAL, TARGET))
    + "SELECT feature, type, round(mutual_info, 6) AS mutual_info, auc_or_cramers_v, signal FROM assoc",
)
def target_association(spark, folder):
    return rounded(association.target_association(fixtures.repaired(spark, folder), APPLICANTS))


@query(
    "decision_table",
    steps(
        "applicants",
        assoc=association_sql("applicants", NUMERIC, CATEGORICAL, TARGET),
        mech=per_column(
            [*NUMERIC, *CATEGORICAL],
            """SELECT '{c}' AS feature, (count(*) - count({c})) * 100.0 / count(*) AS missing_pct,
       abs(avg(CASE WHEN {c} IS NULL THEN LoanApproved END) - avg(CASE WHEN {c} IS NOT NULL THEN LoanApproved END)) >= 0.05 AS informative
FROM applicants""",
        ),
        outl=OUTLIER_SQL,
    )
    + """SELECT a.feature AS feature, round(mutual_info, 6) AS mutual_info, round(m.missing_pct, 6) AS missing_pct,
       coalesce(o.impossible_negative, 0) AS impossible_negatives,
       CASE WHEN a.feature IN ('Gender', 'City') THEN 'exclude (sensitive attribute); audit for bias'
            WHEN signal = 'signal' AND coalesce(informative, false) THEN 'keep (primary); missingness is itself informative'
            WHEN signal = 'signal' THEN 'keep (predictive)'
            WHEN coalesce(o.impossible_negative, 0) > 0 THEN 'repair impossible values; weak signal'
            ELSE 'drop candidate (noise)' END AS recommendation
FROM assoc a JOIN mech m ON a.feature = m.feature LEFT JOIN outl o ON a.feature = o.feature""",
)
def decision_table(spark, folder):
    frame = fixtures.applicants(spark, folder)
    table = profile.decision_table(
        association.target_association(frame, APPLICANTS),
        profile.missing_mechanism(frame, TARGET, APPLICANTS.features),
        profile.outlier_summary(frame, NUMERIC, APPLICANTS.nonnegative),
        APPLICANTS,
    )
    return rounded(table)


PAIRED = [*NUMERIC, TARGET]
PAIRS = [(a, b) for i, a in enumerate(PAIRED) for b in PAIRED[i + 1 :]]


@query(
    "pearson",
    steps("repaired")
    + "\nUNION ALL\n".join(
        f'SELECT \'{a}\' AS "left", \'{b}\' AS "right", round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS pearson FROM repaired'
        for a, b in PAIRS
    ),
)
def pearson(spark, folder):
    return rounded(association.pearson(fixtures.repaired(spark, folder), PAIRED))


@query(
    "spearman",
    steps("repaired")
    + "\nUNION ALL\n".join(
        f"""SELECT '{a}' AS "left", '{b}' AS "right", round(corr(rx, ry), 6) AS spearman
FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS rx,
             rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS ry
      FROM repaired WHERE {a} IS NOT NULL AND {b} IS NOT NULL) t"""
        for a, b in PAIRS
    ),
)
def spearman(spark, folder):
    return rounded(association.spearman(fixtures.repaired(spark, folder), PAIRED))


_fences = " OR ".join(
    f"coalesce({c} < q_{c}[1] - 1.5 * (q_{c}[2] - q_{c}[1]) OR {c} > q_{c}[2] + 1.5 * (q_{c}[2] - q_{c}[1]), false)"
    for c in NUMERIC
)
_far = " OR ".join(f"coalesce(abs(({c} - m_{c}) / s_{c}) > 3, false)" for c in NUMERIC)
_stats = ", ".join(
    f"quantile_cont(CAST({c} AS DOUBLE), [0.25, 0.75]) AS q_{c}, avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}"
    for c in NUMERIC
)
FLAGGED = f"""SELECT a.*, coalesce(Income < 0, false) OR coalesce(LoanAmount < 0, false) AS impossible,
       {_fences} AS iqr, {_far} AS zscore
FROM applicants a, (SELECT {_stats} FROM applicants) s"""


def _flagged(spark, folder):
    return outliers.rule_flags(fixtures.applicants(spark, folder), APPLICANTS)


@query(
    "rule_flags",
    steps("applicants", flagged=FLAGGED) + "SELECT applicant_id, impossible, iqr, zscore FROM flagged",
)
def rule_flags(spark, folder):
    return _flagged(spark, folder).select("applicant_id", *outliers.RULES)


@query(
    "flag_summary",
    steps("applicants", flagged=FLAGGED)
    + per_column(
        outliers.RULES,
        """SELECT '{c}' AS method, count(*) FILTER ({c}) AS flagged, round(count(*) FILTER ({c}) * 100.0 / count(*), 6) AS share_pct,
       round(avg(CASE WHEN {c} THEN LoanApproved END), 6) AS approval_rate,
       round(avg(CASE WHEN {c} THEN LoanApproved END) - avg(LoanApproved), 6) AS approval_lift FROM flagged""",
    ),
)
def flag_summary(spark, folder):
    return rounded(outliers.flag_summary(_flagged(spark, folder), outliers.RULES, TARGET))


@query(
    "flag_jaccard",
    steps("applicants", flagged=FLAGGED)
    + "\nUNION ALL\n".join(
        f"""SELECT '{a}' AS "left", '{b}' AS "right", round(coalesce(CAST(count(*) FILTER ({a} AND {b}) AS DOUBLE)
       / nullif(count(*) FILTER ({a} OR {b}), 0), 1), 6) AS jaccard FROM flagged"""
        for a in outliers.RULES
        for b in outliers.RULES
    ),
)
def flag_jaccard(spark, folder):
    return rounded(outliers.flag_jaccard(_flagged(spark, folder), outliers.RULES))


_votes = "CAST(impossible AS INTEGER) + CAST(iqr AS INTEGER) + CAST(zscore AS INTEGER)"


@query(
    "consensus_rows",
    steps("applicants", flagged=FLAGGED)
    + f"""SELECT applicant_id, concat_ws(', ', CASE WHEN impossible THEN 'impossible' END, CASE WHEN iqr THEN 'iqr' END,
       CASE WHEN zscore THEN 'zscore' END) AS flagged_by FROM flagged WHERE {_votes} >= 1""",
)
def consensus_rows(spark, folder):
    marked = outliers.consensus(_flagged(spark, folder), outliers.RULES, 1)
    return outliers.flagged_rows(marked, outliers.RULES).select("applicant_id", "flagged_by")


@query(
    "rows_kept",
    steps("applicants", flagged=FLAGGED)
    + f"SELECT applicant_id, round(Income, 6) AS Income, LoanApproved FROM flagged WHERE {_votes} < 1",
)
def rows_kept(spark, folder):
    marked = outliers.consensus(_flagged(spark, folder), outliers.RULES, 1)
    kept = outliers.remove_flagged(marked)
    return rounded(kept.select("applicant_id", "Income", "LoanApproved"))


@query(
    "hist",
    steps("repaired")
    + "SELECT feature, bin, round(lo + (hi - lo) * bin / 20, 6) AS low, round(lo + (hi - lo) * (bin + 1) / 20, 6) AS high, count(*) AS n FROM ("
    + per_column(
        NUMERIC,
        """SELECT '{c}' AS feature, lo, hi, CAST(least(floor((CAST({c} AS DOUBLE) - lo) * 20 / (hi - lo)), 19) AS BIGINT) AS bin
FROM repaired, (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM repaired) r WHERE {c} IS NOT NULL""",
    )
    + ") t GROUP BY feature, bin, lo, hi",
)
def hist(spark, folder):
    return rounded(profile.histogram(fixtures.repaired(spark, folder), NUMERIC, 20))


@query(
    "box_stats",
    steps("applicants")
    + per_column(
        NUMERIC,
        """SELECT '{c}' AS feature, a.LoanApproved AS LoanApproved, round(any_value(q[1]), 6) AS q1, round(any_value(q[2]), 6) AS median,
       round(any_value(q[3]), 6) AS q3,
       round(CAST(min(CASE WHEN {c} >= q[1] - 1.5 * (q[3] - q[1]) THEN {c} END) AS DOUBLE), 6) AS whisker_low,
       round(CAST(max(CASE WHEN {c} <= q[3] + 1.5 * (q[3] - q[1]) THEN {c} END) AS DOUBLE), 6) AS whisker_high,
       count(*) FILTER ({c} < q[1] - 1.5 * (q[3] - q[1]) OR {c} > q[3] + 1.5 * (q[3] - q[1])) AS outliers
FROM applicants a JOIN (SELECT LoanApproved, quantile_cont(CAST({c} AS DOUBLE), [0.25, 0.5, 0.75]) AS q FROM applicants GROUP BY LoanApproved) s
  ON a.LoanApproved = s.LoanApproved GROUP BY a.LoanApproved""",
    ),
)
def box_stats(spark, folder):
    return rounded(profile.box_statistics(fixtures.applicants(spark, folder), NUMERIC, TARGET))


@query(
    "rate_by_category",
    steps("repaired")
    + per_column(
        CATEGORICAL,
        """SELECT '{c}' AS feature, {c} AS value, round(avg(LoanApproved), 6) AS approval_rate, count(*) AS n,
       round((SELECT avg(LoanApproved) FROM repaired), 6) AS base_rate FROM repaired WHERE {c} IS NOT NULL GROUP BY {c}""",
    ),
)
def rate_by_category(spark, folder):
    return rounded(profile.rate_by_category(fixtures.repaired(spark, folder), CATEGORICAL, TARGET))


def draw_sql(purpose: str) -> str:
    text = f"applicant_id || '|42|{purpose}'"
    return f"CAST(('0x' || substr(md5({text}), 1, 13))::BIGINT AS DOUBLE) / {float(16**13)!r}"


@query(
    "holdout_split",
    steps("applicants")
    + f"SELECT applicant_id, LoanApproved, {draw_sql('holdout')} < 0.2 AS is_holdout FROM applicants",
)
def holdout_split(spark, folder):
    marked = splits.mark_holdout(fixtures.applicants(spark, folder), APPLICANTS)
    return marked.select("applicant_id", "LoanApproved", "is_holdout")


@query(
    "holdout_split_exact",
    steps("applicants")
    + f"""SELECT applicant_id, LoanApproved,
       row_number() OVER (PARTITION BY LoanApproved ORDER BY {draw_sql('holdout')})
         <= ceil(count(*) OVER (PARTITION BY LoanApproved) * 0.2 - 1e-9) AS is_holdout FROM applicants""",
)
def holdout_split_exact(spark, folder):
    marked = splits.mark_holdout(fixtures.applicants(spark, folder), APPLICANTS, exact=True)
    return marked.select("applicant_id", "LoanApproved", "is_holdout")


@query(
    "fold_assignment",
    steps("applicants")
    + f"SELECT applicant_id, LoanApproved, CAST(floor({draw_sql('fold')} * 5) AS INTEGER) AS fold FROM applicants",
)
def fold_assignment(spark, folder):
    folded = splits.assign_folds(fixtures.applicants(spark, folder), APPLICANTS)
    return folded.select("applicant_id", "LoanApproved", "fold")


@query(
    "fold_assignment_exact",
    steps("applicants")
    + "SELECT applicant_id, LoanApproved, CAST("
    + " + ".join(f"CAST(r > ceil(n * {i / 5!r} - 1e-9) AS INTEGER)" for i in range(1, 5))
    + f""" AS INTEGER) AS fold
FROM (SELECT applicant_id, LoanApproved, row_number() OVER (PARTITION BY LoanApproved ORDER BY {draw_sql('fold')}) AS r,
             count(*) OVER (PARTITION BY LoanApproved) AS n FROM applicants) t""",
)
def fold_assignment_exact(spark, folder):
    folded = splits.assign_folds(fixtures.applicants(spark, folder), APPLICANTS, exact=True)
    return folded.select("applicant_id", "LoanApproved", "fold")


@query(
    "class_weights",
    steps("applicants")
    + "SELECT LoanApproved, n, round(sum(n) OVER () / (count(*) OVER () * CAST(n AS DOUBLE)), 6) AS weight "
    "FROM (SELECT LoanApproved, count(*) AS n FROM applicants GROUP BY LoanApproved) t",
)
def class_weights(spark, folder):
    return rounded(splits.class_weights(fixtures.applicants(spark, folder), TARGET))


# The same operators over a table of another shape.

DOCS = """labelled AS (SELECT d.doc_id, d.n_chars, CAST(len(string_split(d.text, ' ')) AS BIGINT) AS n_words, d.lang, d.source,
       CAST(l.quality AS BIGINT) AS quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


@query(
    "documents_numeric_summary",
    f"WITH {DOCS}\n"
    + per_column(
        fixtures.DOCUMENTS.numeric,
        """SELECT '{c}' AS feature, round((count(*) - count({c})) * 100.0 / count(*), 6) AS missing_pct,
       round(CAST(min({c}) AS DOUBLE), 6) AS min, round(CAST(quantile_cont(CAST({c} AS DOUBLE), 0.5) AS DOUBLE), 6) AS median,
       round(CAST(max({c}) AS DOUBLE), 6) AS max, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
       round(skewness({c}), 6) AS skew, round(kurtosis({c}), 6) AS kurtosis FROM labelled""",
    ),
)
def documents_numeric_summary(spark, folder):
    frame = fixtures.labelled_documents(spark, folder)
    return rounded(profile.numeric_summary(frame, fixtures.DOCUMENTS.numeric))


@query(
    "documents_association",
    f"WITH {DOCS}, assoc AS ("
    + association_sql(
        "labelled", fixtures.DOCUMENTS.numeric, fixtures.DOCUMENTS.categorical, "quality"
    )
    + ") SELECT feature, type, round(mutual_info, 6) AS mutual_info, auc_or_cramers_v, signal FROM assoc",
)
def documents_association(spark, folder):
    frame = fixtures.labelled_documents(spark, folder)
    return rounded(association.target_association(frame, fixtures.DOCUMENTS))


@query(
    "documents_rate_by_category",
    f"WITH {DOCS}\n"
    + per_column(
        fixtures.DOCUMENTS.categorical,
        """SELECT '{c}' AS feature, {c} AS value, round(avg(quality), 6) AS approval_rate, count(*) AS n,
       round((SELECT avg(quality) FROM labelled), 6) AS base_rate FROM labelled WHERE {c} IS NOT NULL GROUP BY {c}""",
    ),
)
def documents_rate_by_category(spark, folder):
    frame = fixtures.labelled_documents(spark, folder)
    return rounded(
        profile.rate_by_category(frame, fixtures.DOCUMENTS.categorical, fixtures.DOCUMENTS.target)
    )
