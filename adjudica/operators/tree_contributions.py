"""Exact additive contributions (Shapley values) of tree ensembles, and of linear models.

A leaf is reached by an interval test on each distinct feature of its path. For a path of d
features let o_j be 1 if the row passes the test of feature j and z_j the share of training weight
that does. The leaf with value v gives feature i

    v (o_i − z_i) ∫₀¹ Π_{j≠i} (z_j (1 − t) + o_j t) dt,

which is the Shapley value of the path-dependent expectation (Lundberg et al. 2018) written as an
integral of a polynomial of degree d − 1, so Gauss–Legendre quadrature with ⌈d/2⌉ nodes is exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import StandardScalerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adjudica.operators.explain import reason_columns, slot_label
from adjudica.operators.preprocess import FILLED, encoded_names
from adjudica.session import new_path, spread
from adjudica.spec import KNOBS, READABLE_NAMES

SMALL_PATH = 6  # paths this short tabulate all 2^d patterns once
BLOCK_LEAVES, BLOCK_ROWS = 256, 256  # worked on at a time, so that they stay in the cache


@dataclass(frozen=True)
class Leaf:
    features: np.ndarray
    low: np.ndarray  # passes if low < x <= high
    high: np.ndarray
    share: np.ndarray  # z, the share of training weight that passes
    value: float


def _split_bounds(split) -> tuple[tuple[float, float], tuple[float, float]]:
    """The intervals of the left and the right child."""
    bounds = split["leftCategoriesOrThreshold"]
    if split["numCategories"] < 0:
        return (-np.inf, bounds[0]), (bounds[0], np.inf)
    # A one-hot slot holds 0 or 1, and the left child takes exactly one of them.
    if list(bounds) == [0.0]:
        return (-np.inf, 0.5), (0.5, np.inf)
    return (0.5, np.inf), (-np.inf, 0.5)


def _leaves(nodes: dict[int, dict], weight: float, probability: bool) -> list[Leaf]:
    """All leaves of one tree with their path conditions merged per feature."""

    def cover(node) -> float:
        stats = node["impurityStats"]
        return float(sum(stats)) if probability else float(stats[0])

    def value(node) -> float:
        if not probability:
            return weight * node["prediction"]
        return weight * node["impurityStats"][1] / sum(node["impurityStats"])

    found = []
    pending = [(0, {})]
    while pending:
        at, path = pending.pop()
        node = nodes[at]
        if node["leftChild"] < 0:
            features = sorted(path)
            found.append(
                Leaf(
                    np.array(features, dtype=int),
                    np.array([path[f][0] for f in features]),
                    np.array([path[f][1] for f in features]),
                    np.array([path[f][2] for f in features]),
                    value(node),
                )
            )
            continue
        feature = node["split"]["featureIndex"]
        low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
        children = (node["leftChild"], node["rightChild"])
        for child, (left, right) in zip(children, _split_bounds(node["split"])):
            passed = cover(nodes[child]) / cover(node)
            step = {feature: (max(low, left), min(high, right), share * passed)}
            pending.append((child, {**path, **step}))
    return found


def _pattern_values(value: np.ndarray, share: np.ndarray, passed: np.ndarray) -> np.ndarray:
    """Contribution of each path feature (last axis) for leaf values, shares and 0/1 test results."""
    size = share.shape[-1]
    nodes, weights = np.polynomial.legendre.leggauss((size + 1) // 2)
    t, w = (nodes + 1) / 2, weights / 2
    factors = share[..., None] * (1 - t) + passed[..., None] * t
    others = factors.prod(axis=-2, keepdims=True) / factors
    return value[..., None] * (passed - share) * (others * w).sum(axis=-1)


@dataclass(frozen=True)
class PathTable:
    """Up to ``BLOCK_LEAVES`` leaves whose paths test equally many features, position by position.

    ``features``, ``share`` and ``tests`` have a row per position and a column per leaf; a test is a row of ``test_features``,
    ``low`` and ``high``, which leaves share. For short paths ``values`` holds each position's contribution for all 2^d
    patterns of passed tests of each leaf, together with those of its sibling, where that is reached by the opposite of one test.
    ``order`` sorts the leaves by a position's feature; a feature's run starts at ``starts``.
    """

    features: np.ndarray
    share: np.ndarray
    value: np.ndarray
    tests: np.ndarray
    test_features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    values: np.ndarray | None
    order: list[np.ndarray]
    starts: list[np.ndarray]

    @staticmethod
    def of(leaves: list[Leaf], siblings: list[tuple[Leaf, int] | None]) -> PathTable:
        features = np.stack([leaf.features for leaf in leaves], axis=1)
        share = np.stack([leaf.share for leaf in leaves], axis=1)
        value = np.array([leaf.value for leaf in leaves])
        bounds = [np.stack([getattr(leaf, name) for leaf in leaves], axis=1) for name in ("low", "high")]
        found, tests = np.unique(np.stack([features.ravel(), *(b.ravel() for b in bounds)]), axis=1, return_inverse=True)
        size, values = len(features), None
        if size <= SMALL_PATH:
            values = _all_patterns(value, share)
            both = [i for i, sibling in enumerate(siblings) if sibling]
            if both:
                pair = [siblings[i] for i in both]
                other = _all_patterns(np.array([r.value for r, _ in pair]), np.stack([r.share for r, _ in pair], axis=1))
                turned = np.arange(1 << size) ^ (1 << np.array([j for _, j in pair]))[:, None]
                values[:, both] += np.take_along_axis(other, turned[None], axis=2)
            values = np.ascontiguousarray(values.reshape(size, -1))
        order = [np.argsort(f, kind="stable") for f in features]
        starts = [np.flatnonzero(np.diff(f[o], prepend=-1)) for f, o in zip(features, order)]
        tests = tests.reshape(features.shape)
        return PathTable(features, share, value, tests, found[0].astype(int), found[1], found[2], values, order, starts)

    def add_to(self, result: np.ndarray, x: np.ndarray) -> None:
        """Add the leaves' contributions; both arrays have a row per feature and a column per table row."""
        size, leaves = self.features.shape
        part = x[self.test_features]
        passed = (part > self.low[:, None]) & (part <= self.high[:, None])
        values = self.values
        passed = passed.astype(np.uint8 if values is not None else np.int64)
        code = passed[self.tests[0]]
        for j in range(1, size):
            code |= passed[self.tests[j]] << j
        code = code.astype(np.int64) + (np.arange(leaves, dtype=np.int64)[:, None] << size)
        if values is None:
            # Too many patterns to list: only those that occur are worked out.
            found, place = np.unique(code, return_inverse=True)
            code = place.reshape(code.shape)
            bits = ((found[:, None] >> np.arange(size)) & 1).astype(float)
            leaf = found >> size
            values = _pattern_values(self.value[leaf], self.share.T[leaf], bits).T
        for j in range(size):
            parts = values[j].take(code.take(self.order[j], axis=0))
            sums = np.add.reduceat(parts, self.starts[j], axis=0)
            result[self.features[j][self.order[j]][self.starts[j]]] += sums


def _all_patterns(value: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Contributions by position, leaf and pattern of passed tests; ``share`` has a row per position."""
    size = len(share)
    patterns = ((np.arange(1 << size)[:, None] >> np.arange(size)) & 1).astype(float)
    return np.moveaxis(_pattern_values(value[:, None], share.T[:, None, :], patterns[None]), 2, 0).copy()


def _with_siblings(leaves: list[Leaf]) -> list[tuple[Leaf, tuple[Leaf, int] | None]]:
    """Each leaf, with the leaf reached by the same tests but for the opposite of one, and the place of that one."""
    waiting: dict[tuple, list[Leaf]] = {}
    found: dict[int, tuple[Leaf, int]] = {}
    taken: set[int] = set()
    sides = {}
    for leaf in leaves:
        for j in range(len(leaf.features)):
            left = leaf.low[j] == -np.inf and leaf.high[j] < np.inf
            if left == (leaf.high[j] == np.inf and leaf.low[j] > -np.inf):
                continue
            rest = np.arange(len(leaf.features)) != j
            bound = leaf.high[j] if left else leaf.low[j]
            key = (leaf.features.tobytes(), j, float(bound), leaf.low[rest].tobytes(), leaf.high[rest].tobytes())
            sides.setdefault(id(leaf), []).append((key, left))
            if not left:
                waiting.setdefault(key, []).append(leaf)
    for leaf in leaves:
        for key, left in sides.get(id(leaf), []):
            if left and id(leaf) not in found and id(leaf) not in taken:
                free = [r for r in waiting.get(key, []) if id(r) not in taken and id(r) not in found]
                if free:
                    found[id(leaf)] = free[0], key[1]
                    taken.add(id(free[0]))
    return [(leaf, found.get(id(leaf))) for leaf in leaves if id(leaf) not in taken]


def path_tables(leaves: list[Leaf]) -> list[PathTable]:
    """All leaves, those of one path length together."""
    by_length: dict[int, list[Leaf]] = {}
    for leaf in leaves:
        if len(leaf.features):
            by_length.setdefault(len(leaf.features), []).append(leaf)
    tables = []
    for size, group in sorted(by_length.items()):
        pairs = _with_siblings(group) if size <= SMALL_PATH else [(leaf, None) for leaf in group]
        for k in range(0, len(pairs), BLOCK_LEAVES):
            tables.append(PathTable.of(*map(list, zip(*pairs[k : k + BLOCK_LEAVES]))))
    return tables


def contributions_by_tables(tables: list[PathTable], x: np.ndarray) -> np.ndarray:
    """Contributions of all features for the rows of ``x``, ``BLOCK_ROWS`` rows at a time."""
    result = np.empty_like(x)
    for first in range(0, len(x), BLOCK_ROWS):
        part = np.ascontiguousarray(x[first : first + BLOCK_ROWS].T)
        sums = np.zeros_like(part)
        for table in tables:
            table.add_to(sums, part)
        result[first : first + BLOCK_ROWS] = sums.T
    return result


def contributions_of(leaves: list[Leaf], x: np.ndarray) -> np.ndarray:
    return contributions_by_tables(path_tables(leaves), x)


def _expected(leaves: list[Leaf]) -> float:
    return float(sum(leaf.value * leaf.share.prod() for leaf in leaves))


def model_leaves(model: PipelineModel, spark) -> list[Leaf]:
    """Leaves of the ensemble at the end of a pipeline, read from its saved form.

    The model's size depends on its parameters, not on the rows it was fitted on.
    """
    classifier = model.stages[-1]
    path = new_path(spark, "ensemble")
    classifier.save(path)
    probability = "RandomForest" in type(classifier).__name__
    weights = (
        [1.0 / classifier.getNumTrees] * classifier.getNumTrees
        if probability
        else list(classifier.treeWeights)
    )
    trees: dict[int, dict[int, dict]] = {}
    for row in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():
        node = row.asDict(recursive=True)
        trees.setdefault(row["treeID"], {})[row["id"]] = node
    return [
        leaf for i, nodes in sorted(trees.items()) for leaf in _leaves(nodes, weights[i], probability)
    ]


def _wide(model: PipelineModel, frame: DataFrame, key: str) -> tuple[DataFrame, float]:
    """Key, probability, displayed values and contributions as arrays, and the base value."""
    encoded = model.transform(frame)
    slots = encoded_names(model)
    x = vector_to_array("features")
    shown = [
        F.col(name + FILLED) if name + FILLED in encoded.columns else F.get(x, F.lit(i))
        for i, (name, _) in enumerate(slots)
    ]
    p = vector_to_array("probability").getItem(1).alias("p")
    rows = encoded.select(key, p, x.alias("x"), F.array(*shown).alias("shown"))
    classifier = model.stages[-1]
    if isinstance(classifier, LogisticRegressionModel):
        # The means of the training rows, so that a row's contributions do not depend on its batch.
        means = next(s for s in model.stages if isinstance(s, StandardScalerModel)).mean.toArray()
        weights = classifier.coefficients.toArray()
        base = float(classifier.intercept + means @ weights)
        part = [
            (F.get("x", F.lit(i)) - F.lit(float(m))) * F.lit(float(w))
            for i, (m, w) in enumerate(zip(means, weights))
        ]
        return rows.select(key, "p", "shown", F.array(*part).alias("parts")), base

    leaves = model_leaves(model, frame.sparkSession)
    shared = frame.sparkSession.sparkContext.broadcast(path_tables(leaves))
    kind = dict(rows.dtypes)[key]
    rows = spread(rows)

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                parts = contributions_by_tables(shared.value, x)
                ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(parts.ravel()))
                kept = [batch[c] for c in (key, "p", "shown")]
                yield pa.RecordBatch.from_arrays([*kept, lists], [key, "p", "shown", "parts"])

    schema = f"{key} {kind}, p double, shown array<double>, parts array<double>"
    return rows.mapInArrow(explain, schema), _expected(leaves)


def explain_model(model: PipelineModel, frame: DataFrame, key: str) -> tuple[DataFrame, float]:
    """Long table of contributions per row and encoded feature, and the base value.

    Base plus contributions equal the model's score: the sum of weighted leaves of a boosted model,
    the probability of a forest, the log-odds of a linear model. Numbers are shown unscaled.
    """
    wide, base = _wide(model, frame, key)
    names = F.array(*[F.lit(name) for name, _ in encoded_names(model)])
    long = wide.select(key, F.posexplode(F.arrays_zip("shown", "parts")).alias("slot", "pair"))
    table = long.select(
        key,
        F.get(names, F.col("slot")).alias("feature"),
        F.col("pair.shown").alias("value"),
        F.col("pair.parts").alias("contribution"),
    )
    return table, base


def explain_decisions(
    model: PipelineModel,
    frame: DataFrame,
    key: str,
    threshold: float = KNOBS.threshold,
    top: int = KNOBS.top_reasons,
    names: Mapping[str, str] = READABLE_NAMES,
) -> DataFrame:
    """Decision, probability and reasons of each row of a model's input.

    The contributions of a row stay in its own array, so nothing is shuffled.
    """
    wide, _ = _wide(model, frame, key)
    features = F.array(
        *[
            F.struct(F.lit(name).alias("feature"), F.lit(slot_label(name, source, names)).alias("label"))
            for name, source in encoded_names(model)
        ]
    )
    entries = F.zip_with(
        features,
        F.col("parts"),
        lambda f, c: F.struct(
            f["feature"].alias("feature"), f["label"].alias("label"), c.alias("contribution")
        ),
    )
    return wide.select(key, *reason_columns(entries, F.col("p"), threshold, top))
