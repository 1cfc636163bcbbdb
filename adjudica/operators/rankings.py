"""Three ways to rank features by a target, their consensus, and the choice of a subset."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adjudica.operators.association import binned_information
from adjudica.operators.batched_permutation import permuted_ranks
from adjudica.operators.classifiers import DEFAULT_MODEL, fit_model, score_rows
from adjudica.operators.metrics import ranking_metrics
from adjudica.operators.preprocess import encoded_names
from adjudica.operators.selection import one_standard_error, rank_consensus
from adjudica.operators.splits import mark_holdout
from adjudica.operators.validation import ModelPlan, cross_validate_all
from adjudica.session import materialize
from adjudica.spec import KNOBS, TableSpec

#: Rows up to which shuffled columns are scored as copies of the rows.
COPIED_ROWS = 200_000


def information_ranking(frame: DataFrame, spec: TableSpec, columns) -> DataFrame:
    numeric, categorical = spec.split_types(columns)
    return binned_information(frame, spec, numeric=numeric, categorical=categorical)


def gain_ranking(
    frame: DataFrame, spec: TableSpec, columns, name: str = DEFAULT_MODEL, params=None
) -> DataFrame:
    """Split gain of a boosted model per source column, one-hot slots added up."""
    numeric, categorical = spec.split_types(columns)
    model = fit_model(frame, spec.target, numeric, categorical, name, params)
    gains = model.stages[-1].featureImportances.toArray()
    totals = dict.fromkeys([*numeric, *categorical], 0.0)
    for (_, source), gain in zip(encoded_names(model), gains):
        totals[source] += float(gain)
    return frame.sparkSession.createDataFrame(
        list(totals.items()), "feature string, model_gain double"
    )


def shuffled_copies(
    frame: DataFrame, key: str, columns: list[str], repeats: int, seed: int, buckets: int
) -> DataFrame:
    """Each row once per (feature, repeat) with that feature's value taken from another row.

    All rows are ranked by one random draw, in buckets whose sizes are summed up; in repeat r each row
    takes the values of the row r + 1 ranks further, the last ones those of the first. Such a shift in
    random order is a permutation that leaves no row in its place, and serves all columns.
    """
    drawn = frame.withColumn("_u", F.xxhash64(F.col(key), F.lit(seed)))
    drawn = drawn.withColumn("_bucket", F.pmod("_u", F.lit(buckets)))
    sizes = drawn.groupBy("_bucket").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("_bucket").alias("_b"), "_size").select(
        "_b",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"),
        F.sum("_size").over(Window.partitionBy()).alias("_n"),
    )
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_u", key))
    ranked = drawn.withColumn("_place", place).join(F.broadcast(sizes), F.col("_bucket") == F.col("_b"))
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_place") - 1)
    donors = ranked.select(F.col("_rank").alias("_donor"), F.struct(*columns).alias("_from"))
    shift = 1 + F.pmod(F.col("repeat"), F.greatest(F.col("_n") - 1, F.lit(1)))
    copies = ranked.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    copies = copies.withColumn("_donor", F.pmod(F.col("_rank") + shift, F.col("_n")))
    copies = copies.join(donors, "_donor").select(*frame.columns, "repeat", "_from")
    copies = copies.withColumn("feature", F.explode(F.array(*[F.lit(c) for c in columns])))
    return copies.withColumns(
        {
            c: F.when(F.col("feature") == c, F.col(f"_from.{c}")).otherwise(F.col(c))
            for c in columns
        }
    ).drop("_from")


def permutation_ranking(
    frame: DataFrame,
    spec: TableSpec,
    columns,
    name: str = DEFAULT_MODEL,
    params=None,
    repeats: int = KNOBS.permutation_repeats,
    seed: int = KNOBS.seed,
) -> DataFrame:
    """Average precision lost when a column is shuffled, on rows the model has not seen.

    The shuffled columns of a regression on a large table are scored from sums of parts, without copies of rows.
    """
    numeric, categorical = spec.split_types(columns)
    used = [*numeric, *categorical]
    marked = mark_holdout(frame, spec, seed=seed)
    model = fit_model(marked.where("not is_holdout"), spec.target, numeric, categorical, name, params)
    held = marked.where("is_holdout").select(spec.key, spec.target, *used)
    buckets = 4 * int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    if isinstance(model.stages[-1], LogisticRegressionModel) and frame.count() > COPIED_ROWS:
        found = permuted_ranks(model, held, spec.key, spec.target, used, repeats, seed, buckets)
        # A row per column and repeat, and one for the table as it is.
        found = materialize(found.select("feature", "average_precision"), "permuted")
        first = found.where("feature is null").first()
        plain = F.lit(first["average_precision"] if first else None).cast("double")
        scores = found.where("feature is not null")
        return scores.groupBy("feature").agg((plain - F.avg("average_precision")).alias("permutation"))
    copies = shuffled_copies(held, spec.key, used, repeats, seed, buckets)
    plain = ranking_metrics(score_rows(model, held), spec.target).first()["average_precision"]
    scores = ranking_metrics(score_rows(model, copies), spec.target, keys=["feature", "repeat"])
    return scores.groupBy("feature").agg(
        (F.lit(plain) - F.avg("average_precision")).alias("permutation")
    )


def rank_features(
    frame: DataFrame, spec: TableSpec, columns, name: str = DEFAULT_MODEL, params=None
) -> DataFrame:
    """Consensus of the three rankings; each has one row per feature."""
    gain = DEFAULT_MODEL if name == "logistic_regression" else name
    gain_params = params if gain == name else None
    scores = (
        information_ranking(frame, spec, columns)
        .withColumnRenamed("mutual_info", "mutual_information")
        .join(F.broadcast(gain_ranking(frame, spec, columns, gain, gain_params)), "feature")
        .join(
            F.broadcast(permutation_ranking(frame, spec, columns, name, params)), "feature"
        )
    )
    return rank_consensus(scores)


def selection_curve(
    frame: DataFrame,
    spec: TableSpec,
    ordered: list[str],
    name: str = DEFAULT_MODEL,
    params=None,
    folds: int = KNOBS.folds,
) -> DataFrame:
    """Cross-validated score of the first k features for every k, to four places."""
    sizes = range(1, len(ordered) + 1)
    split = [spec.split_types(ordered[:k]) for k in sizes]
    plans = [ModelPlan(spec.target, tuple(num), tuple(cat), name, params) for num, cat in split]
    scores = cross_validate_all(frame, plans, folds)
    rows = [
        (k, ordered[k - 1], round(found["mean"], 4), round(found["std"], 4)) for k, found in zip(sizes, scores)
    ]
    return frame.sparkSession.createDataFrame(
        rows, "k int, added string, mean double, std double"
    )


def select_features(
    frame: DataFrame,
    spec: TableSpec,
    columns,
    name: str = DEFAULT_MODEL,
    params=None,
    folds: int = KNOBS.folds,
) -> tuple[list[str], DataFrame]:
    """The smallest leading set of ranked features that is as good as the best, and the curve."""
    ranking = rank_features(frame, spec, columns, name, params)
    ordered = [row["feature"] for row in ranking.collect()]
    curve = materialize(selection_curve(frame, spec, ordered, name, params, folds), "curve")
    chosen = one_standard_error(curve, folds).first()["selected_k"]
    return ordered[:chosen], curve


