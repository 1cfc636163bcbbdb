"""Ranking, threshold, cost and calibration measures of a scored table.

A scored table has a 0/1 column ``y`` and a probability column ``p``; other names can be given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adjudica.functions.attach import attach
from adjudica.functions.ordering import count_values, running_totals
from adjudica.operators.profile import band_index, quantile_edges
from adjudica.spec import KNOBS

GRID = 91  # thresholds 0.05, 0.06, … 0.95


def score_steps(scored: DataFrame, y: str = "y", p: str = "p", keys=()) -> DataFrame:
    """Each distinct score with the true and false positives at or above it."""
    counted = (
        count_values(scored.where(F.col(y).isNotNull()), keys, p, ones=F.col(y))
        .withColumn("zeros", F.col("n") - F.col("ones"))
        .withColumnRenamed(p, "score")
    )
    placed = running_totals(counted, keys, "score", ["ones", "zeros"], descending=True)
    return placed.select(
        *keys,
        "score",
        "ones",
        "zeros",
        (F.col("before_ones") + F.col("ones")).alias("tp"),
        (F.col("before_zeros") + F.col("zeros")).alias("fp"),
        "all_ones",
        "all_zeros",
    )


def ranking_metrics(scored: DataFrame, y: str = "y", p: str = "p", keys=()) -> DataFrame:
    """Average precision (sum of recall gain × precision) and tie-aware ROC AUC."""
    steps = score_steps(scored, y, p, keys)
    precision = F.col("tp") / (F.col("tp") + F.col("fp")).cast("double")
    gain = F.try_divide(F.col("ones").cast("double"), F.col("all_ones"))
    lost = F.col("zeros") * (F.col("tp") - F.col("ones") / 2.0)
    pairs = F.max("all_ones").cast("double") * F.max("all_zeros")
    return steps.groupBy(*keys).agg(
        F.sum(gain * precision).alias("average_precision"),
        F.try_divide(F.sum(lost), pairs).alias("roc_auc"),
    )


def threshold_metrics(
    scored: DataFrame, threshold: float = KNOBS.threshold, y: str = "y", p: str = "p"
) -> DataFrame:
    """One row: Brier score, rates and confusion counts when ``p ≥ threshold`` approves."""
    approve, good = F.col(p) >= threshold, F.col(y) == 1
    counts = scored.agg(
        F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier_score"),
        F.count_if(approve & good).alias("true_positives"),
        F.count_if(approve & ~good).alias("false_positives"),
        F.count_if(~approve & good).alias("false_negatives"),
        F.count_if(~approve & ~good).alias("true_negatives"),
    )
    tp, fp, fn, tn = (
        F.col(c).cast("double")
        for c in ("true_positives", "false_positives", "false_negatives", "true_negatives")
    )
    ratio = lambda top, bottom: F.coalesce(F.try_divide(top, bottom), F.lit(0.0))
    return counts.select(
        "brier_score",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        F.lit(float(threshold)).alias("threshold"),
        "true_negatives",
        "false_positives",
        "false_negatives",
        "true_positives",
    )


def score_report(
    scored: DataFrame, threshold: float = KNOBS.threshold, y: str = "y", p: str = "p"
) -> DataFrame:
    """One row with every headline measure."""
    ranking = ranking_metrics(scored, y, p)
    both = attach(threshold_metrics(scored, threshold, y, p), ranking)
    return both.select(
        F.col("_s.average_precision").alias("average_precision"),
        F.col("_s.roc_auc").alias("roc_auc"),
        *[c for c in both.columns if c != "_s"],
    )


def roc_points(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """False and true positive rate at each distinct score."""
    return score_steps(scored, y, p).select(
        "score",
        F.try_divide(F.col("fp").cast("double"), F.col("all_zeros")).alias("false_positive_rate"),
        F.try_divide(F.col("tp").cast("double"), F.col("all_ones")).alias("true_positive_rate"),
    )


def pr_points(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Precision and recall at each distinct score."""
    return score_steps(scored, y, p).select(
        "score",
        (F.col("tp") / (F.col("tp") + F.col("fp")).cast("double")).alias("precision"),
        F.try_divide(F.col("tp").cast("double"), F.col("all_ones")).alias("recall"),
    )


def _grid(index: Column) -> Column:
    return (index + 5) / F.lit(100.0)


def cost_curve(
    scored: DataFrame,
    approval_cost: float = KNOBS.false_approval_cost,
    rejection_cost: float = KNOBS.false_rejection_cost,
    y: str = "y",
    p: str = "p",
) -> DataFrame:
    """False approvals, false rejections and cost at each threshold of the grid.

    Rows are counted once by the highest threshold they reach; the sums over thresholds then run
    over at most 92 rows.
    """
    guess = F.greatest(F.least(F.floor(F.col(p) * 100) - 5, F.lit(GRID - 1)), F.lit(-1))
    # Float rounding can leave the guess one step off the comparison p >= (5 + i) / 100.
    reached = (
        F.when((guess < GRID - 1) & (F.col(p) >= _grid(guess + 1)), guess + 1)
        .when((guess >= 0) & (F.col(p) < _grid(guess)), guess - 1)
        .otherwise(guess)
    )
    counts = scored.groupBy(reached.alias("i")).agg(
        F.count_if(F.col(y) == 0).alias("zeros"), F.count_if(F.col(y) == 1).alias("ones")
    )
    thresholds = (
        scored.sparkSession.range(-1, GRID, 1, 1)
        .select(F.col("id").alias("i"))
        .join(F.broadcast(counts), "i", "left")
    )
    w = Window.orderBy("i")
    below = w.rowsBetween(Window.unboundedPreceding, -1)
    from_here = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return (
        thresholds.select(
            "i",
            F.coalesce(F.sum("zeros").over(from_here), F.lit(0)).alias("false_approvals"),
            F.coalesce(F.sum("ones").over(below), F.lit(0)).alias("false_rejections"),
        )
        .where("i >= 0")
        .select(
            _grid(F.col("i")).alias("threshold"),
            "false_approvals",
            "false_rejections",
            (
                F.col("false_approvals") * F.lit(float(approval_cost))
                + F.col("false_rejections") * F.lit(float(rejection_cost))
            ).alias("expected_cost"),
        )
    )


def best_threshold(curve: DataFrame) -> DataFrame:
    """The cheapest threshold; the lowest one on a tie."""
    cheapest = F.struct("expected_cost", "threshold")
    return curve.agg(
        F.min_by("threshold", cheapest).alias("threshold"),
        F.min("expected_cost").alias("expected_cost"),
    )


def marked_cost_curve(curve: DataFrame, chosen: float, default: float = KNOBS.threshold) -> DataFrame:
    """The cost curve with the threshold in use, the cheapest one and the default marked."""
    marked = attach(curve, best_threshold(curve).select(F.col("threshold").alias("best")))
    same = lambda value: F.abs(F.col("threshold") - value) < 1e-9
    return marked.select(
        *curve.columns,
        same(F.lit(float(chosen))).alias("is_chosen"),
        same(F.col("_s.best")).alias("is_optimal"),
        same(F.lit(float(default))).alias("is_default"),
    )


def calibration_bins(scored: DataFrame, bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """Mean probability against observed rate in equal-count bins of the probability."""
    rows = scored.select(y, p).where(F.col(p).isNotNull())
    table = attach(rows, quantile_edges(rows, p, bins), name="_e")
    return table.groupBy(band_index(F.col(p), F.col("_e.edges")).alias("bin")).agg(
        F.avg(p).alias("mean_predicted"), F.avg(y).alias("observed_rate"), F.count(F.lit(1)).alias("n")
    )


def confusion(
    scored: DataFrame, threshold: float = KNOBS.threshold, y: str = "y", p: str = "p"
) -> DataFrame:
    """Counts of the four actual × predicted cells, empty ones included."""
    counts = threshold_metrics(scored, threshold, y, p)
    cell = lambda actual, predicted, name: F.struct(
        F.lit(actual).alias("actual"), F.lit(predicted).alias("predicted"), F.col(name).alias("n")
    )
    return counts.select(
        F.inline(
            F.array(
                cell(0, 0, "true_negatives"),
                cell(0, 1, "false_positives"),
                cell(1, 0, "false_negatives"),
                cell(1, 1, "true_positives"),
            )
        )
    )
