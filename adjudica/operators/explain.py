"""Reports over additive contributions held as a long table.

The long table has one row per (key, encoded feature): ``feature``, ``value`` and ``contribution``.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adjudica.functions.attach import attach
from adjudica.spec import KNOBS, READABLE_NAMES


def linear_contributions(
    frame: DataFrame, key: str, coefficients: Mapping[str, float]
) -> DataFrame:
    """Contribution of each column of a linear score: coefficient × (value − mean value)."""
    columns = list(coefficients)
    means = frame.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns])
    table = attach(frame.select(key, *columns), means, name="_m")
    parts = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.col(c).cast("double").alias("value"),
                ((F.col(c).cast("double") - F.col(f"_m.{c}")) * F.lit(float(w))).alias(
                    "contribution"
                ),
            )
            for c, w in coefficients.items()
        ]
    )
    return table.select(key, F.inline(parts))


def global_importance(contributions: DataFrame) -> DataFrame:
    """Mean absolute contribution of each feature, largest first."""
    return (
        contributions.groupBy("feature")
        .agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"))
        .orderBy(F.desc("mean_abs_contribution"), "feature")
    )


def top_features(contributions: DataFrame, count: int = 2) -> DataFrame:
    return global_importance(contributions).limit(count)


def local_contributions(contributions: DataFrame, key: str, wanted: int) -> DataFrame:
    """The contributions of one row, largest first, and the direction of each."""
    direction = F.when(F.col("contribution") > 0, "raises").otherwise("lowers")
    return (
        contributions.where(F.col(key) == wanted)
        .withColumn("direction", direction)
        .orderBy(F.desc(F.abs("contribution")), "feature")
    )


def readable(feature: Column, names: Mapping[str, str] = READABLE_NAMES) -> Column:
    """A name a reader understands; a one-hot column reads as "label is value".

    One pattern cuts a one-hot name into its source column and its level.
    """
    labels = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    sources = "|".join(re.escape(s) for s in sorted(names, reverse=True))
    pattern = f"^({sources})_(.*)$"
    source = F.regexp_extract(feature, pattern, 1)
    level = F.replace(F.regexp_extract(feature, pattern, 2), F.lit("_"), F.lit(" "))
    return F.coalesce(
        F.try_element_at(labels, feature),
        F.concat(F.try_element_at(labels, source), F.lit(" is "), level),
        F.replace(feature, F.lit("_"), F.lit(" ")),
    )


def slot_label(name: str, source: str, names: Mapping[str, str] = READABLE_NAMES) -> str:
    """The wording of one slot of a feature vector, from its own and its source column's name."""
    own = names.get(source, source.replace("_", " "))
    level = name.removeprefix(f"{source}_") if name != source else ""
    return f"{own} is {level.replace('_', ' ')}" if level else own


def decision_reasons(
    contributions: DataFrame,
    scored: DataFrame,
    key: str,
    threshold: float = KNOBS.threshold,
    top: int = KNOBS.top_reasons,
    names: Mapping[str, str] = READABLE_NAMES,
    p: str = "p",
) -> DataFrame:
    """Decision, probability and the strongest signed reasons of each row.

    A row has as many contributions as the model has encoded features, so its array is short.
    """
    label = readable(F.col("feature"), names).alias("label")
    entries = F.collect_list(F.struct("feature", label, "contribution")).alias("_entries")
    grouped = contributions.groupBy(key).agg(entries)
    return scored.join(grouped, key).select(
        key, *reason_columns(F.col("_entries"), F.col(p), threshold, top)
    )


def reason_columns(
    entries: Column,
    probability: Column,
    threshold: float = KNOBS.threshold,
    top: int = KNOBS.top_reasons,
) -> list[Column]:
    """Decision, probability and reasons from a row's array of (feature, label, contribution)."""
    ordered = F.sort_array(
        F.transform(
            entries,
            lambda e: F.struct(
                (-F.abs(e["contribution"])).alias("size"),
                e["feature"].alias("feature"),
                e["label"].alias("label"),
                F.when(e["contribution"] > 0, "+").otherwise("-").alias("sign"),
            ),
        )
    )
    phrase = lambda r: F.concat(r["label"], F.lit(" ("), r["sign"], F.lit(")"))
    return [
        F.when(probability >= threshold, "approved").otherwise("declined").alias("decision"),
        F.round(probability, 3).alias("probability"),
        F.array_join(F.transform(F.slice(ordered, 1, top), phrase), "; ").alias("reasons"),
    ]


def beeswarm_rows(contributions: DataFrame, top: int = 15) -> DataFrame:
    """All rows of the most important features, with the rank of the feature.

    The ranking has ``top`` rows at most, so it is broadcast.
    """
    ranking = top_features(contributions, top)
    return contributions.join(F.broadcast(ranking), "feature")


def dependence_rows(contributions: DataFrame, key: str, feature: str, colour: str) -> DataFrame:
    """Value against contribution of one feature beside the value of a second one."""
    wanted = contributions.where(F.col("feature").isin(feature, colour))
    return wanted.groupBy(key).agg(
        F.max(F.when(F.col("feature") == feature, F.col("value"))).alias("value"),
        F.max(F.when(F.col("feature") == feature, F.col("contribution"))).alias("contribution"),
        F.max(F.when(F.col("feature") == colour, F.col("value"))).alias("colour_value"),
    )
