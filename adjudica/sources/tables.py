"""Typed reading and writing of decision tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adjudica.operators.quality import repair_impossible
from adjudica.spec import TableSpec


class MissingColumnsError(ValueError):
    """A table lacks columns an operator needs."""

    def __init__(self, source: object, missing: Sequence[str]) -> None:
        super().__init__(f"{source} lacks the columns {', '.join(missing)}")
        self.missing = list(missing)


def require_columns(frame: DataFrame, columns: Sequence[str], source: object) -> None:
    """Fail before any job runs if a column is absent, naming all absent ones."""
    missing = [c for c in columns if c not in frame.columns]
    if missing:
        raise MissingColumnsError(source, missing)


def cast_declared(frame: DataFrame, spec: TableSpec) -> DataFrame:
    """Cast the declared columns that are present; NaN becomes null; other columns stay."""
    declared = spec.types()
    present = {f.name: f.dataType for f in frame.schema}
    columns = []
    for name, have in present.items():
        want = declared.get(name)
        column = F.col(name)
        if want is not None and have != want:
            column = column.cast(want)
        if isinstance(want or have, (T.DoubleType, T.FloatType)):
            column = F.when(~F.isnan(column), column)
        columns.append(column.alias(name))
    return frame.select(*columns)


# The spellings of a missing value in CSV files.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _read_csv(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    """Every field as text first, so that each spelling of a missing value becomes null."""
    header = spark.read.option("header", True).csv(path)
    text = header.select(
        *[F.when(~F.col(c).isin(*MISSING), F.col(c)).alias(c) for c in header.columns]
    )
    declared = spec.types()
    return text.select(
        *[
            (_whole_number(F.col(c), c) if declared.get(c) == T.LongType() else F.col(c)).alias(c)
            for c in text.columns
        ]
    )


def _whole_number(text: Column, name: str) -> Column:
    """All digits of a long; only what is no long may be written with a decimal point."""
    wrong = F.raise_error(F.concat(F.lit(f"not a whole number in {name}: "), text)).cast("long")
    number = F.coalesce(text.try_cast("long"), text.try_cast("double").try_cast("long"), wrong)
    return F.when(text.isNotNull(), number)


def read_table(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    """A parquet table if the path ends in ``.parquet``, otherwise CSV with a header, typed."""
    if path.rstrip("/").endswith(".parquet"):
        raw = spark.read.parquet(path)
    else:
        raw = _read_csv(spark, path, spec)
    return cast_declared(raw, spec)


def check_whole_numbers(frame: DataFrame, spec: TableSpec) -> DataFrame:
    """Fail on a null in an integer column or the target while the rows stream through."""
    columns = []
    for c in frame.columns:
        if c in (*spec.integers, spec.target):
            message = F.lit(f"null in the whole-number column {c}")
            columns.append(F.coalesce(F.col(c), F.raise_error(message).cast("long")).alias(c))
        else:
            columns.append(F.col(c))
    return frame.select(*columns)


def write_parquet(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").parquet(path)


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", True).csv(path)


def _exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException:
        return False
    return True


def training_input(
    spark: SparkSession,
    spec: TableSpec,
    path: str | None = None,
    processed: str | None = None,
    raw: str | None = None,
) -> DataFrame:
    """Rows whose whole numbers are never null: a given path, else the processed table, else the raw file repaired on the fly."""
    if path is not None:
        frame, source = read_table(spark, path, spec), path
    elif processed is not None and _exists(spark, processed):
        frame, source = read_table(spark, processed, spec), processed
    elif raw is not None:
        frame, source = repair_impossible(read_table(spark, raw, spec), spec.nonnegative), raw
    else:
        raise FileNotFoundError("no training table was given")
    require_columns(frame, [*spec.features, spec.target], source)
    return check_whole_numbers(frame, spec)


def scoring_input(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    """New rows to score: the key, if there is one, and exactly the feature columns."""
    return project_features(read_table(spark, path, spec), spec, path)


def project_features(frame: DataFrame, spec: TableSpec, source: object = "table") -> DataFrame:
    require_columns(frame, spec.features, source)
    key = [spec.key] if spec.key in frame.columns else []
    return frame.select(*key, *spec.features)


def first_rows(frame: DataFrame, key: str, count: int) -> DataFrame:
    """The first ``count`` rows in key order."""
    return frame.orderBy(key).limit(count)


def run_sql(frame: DataFrame, query: str, view: str = "applicants") -> DataFrame:
    """Free SQL over one table; ``view`` is the name the query uses for it."""
    frame.createOrReplaceTempView(view)
    return frame.sparkSession.sql(query)
