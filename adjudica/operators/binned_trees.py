"""Trees grown from bytes of bins, stored once: those of a large table by one pass over its rows per level.

The method is that of ``GBTClassifier``: the first tree fits the labels −1 and 1, each later one the slope of the
logistic loss, on a share of the rows and, per node, of the features; splits lower the weighted variance most.
A pass counts a level's smaller children only, the larger ones are what is left of their parents, and the
one-hot slots of a category are counted as one column. The result is a ``GBTClassificationModel``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adjudica.functions.blocks import Block, over_blocks, read_bytes, store_blocks, write_bytes
from adjudica.session import new_path

#: Codes a byte holds, depth up to which a level's sums are small, and rows of a stored block: few enough for the cache.
CODES, DEEPEST, BLOCK_ROWS = 256, 7, 30_000
#: Impurity below which ``pyspark.ml`` makes a child a leaf.
PURE = 2.0**-52
#: Relative difference up to which two gains are equal.
EQUAL = 1e-10


@dataclass(frozen=True)
class Column:
    """Consecutive slots stored as one byte: a number by its thresholds, or the slots of a category."""

    first: int
    width: int = 1
    cuts: np.ndarray | None = None

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The bin of a number; the level of a category, ``width`` for none."""
        if self.cuts is not None:
            return np.searchsorted(self.cuts, x[:, self.first], side="left").astype(np.uint8)
        hot = x[:, self.first : self.first + self.width] != 0
        return np.where(hot.any(axis=1), hot.argmax(axis=1), self.width).astype(np.uint8)

    @property
    def size(self) -> int:
        return self.width + 1 if self.cuts is None else len(self.cuts) + 1


@dataclass
class Tree:
    """Nodes in order of their making; children stand beside each other, after their parent."""

    column: list[int] = field(default_factory=list)
    right: list[np.ndarray] = field(default_factory=list)  # whether a code goes to the right child
    child: list[int] = field(default_factory=list)  # the left child, or the node itself
    sums: list[np.ndarray] = field(default_factory=list)  # rows, weight, weighted label, and its square
    split: list[tuple | None] = field(default_factory=list)  # gain, slot, threshold or left level, levels

    def add(self, sums: np.ndarray) -> int:
        self.column.append(0)
        self.right.append(np.zeros(CODES, dtype=np.int64))
        self.child.append(len(self.child))
        self.sums.append(sums)
        self.split.append(None)
        return len(self.child) - 1

    def prediction(self) -> np.ndarray:
        return np.array([s[2] / s[1] for s in self.sums])

    def depth(self) -> int:
        levels = np.zeros(len(self.child), dtype=int)
        for node, left in enumerate(self.child):
            if left != node:
                levels[left : left + 2] = levels[node] + 1
        return int(levels.max())

    def router(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.column), np.concatenate(self.right), np.array(self.child)


def _impurity(sums: np.ndarray) -> float:
    return max(float((sums[3] - sums[2] ** 2 / sums[1]) / sums[1]), 0.0)


def _route(codes: np.ndarray, rows: np.ndarray, router, depth: int) -> np.ndarray:
    """The node each of the rows is in after ``depth`` tests."""
    column, right, child = router
    flat, node = codes.ravel(), np.zeros(len(rows), dtype=np.int64)
    for _ in range(depth):
        code = flat.take(column.take(node) * codes.shape[1] + rows)
        node = child.take(node) + right.take(node * CODES + code)
    return node


def thresholds(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """Midpoints between values: all if they are few, else those that cut the weight evenly."""
    found, place = np.unique(values, return_inverse=True)
    middle = (found[:-1] + found[1:]) / 2
    if len(middle) < bins:
        return middle
    amounts = np.bincount(place, weights)
    stride, total, target, chosen = amounts.sum() / bins, amounts[0], amounts.sum() / bins, []
    for i, amount in enumerate(amounts[1:]):
        if abs(total - target) < abs(total + amount - target):
            chosen.append(middle[i])
            target += stride
        total += amount
    return np.array(chosen[: bins - 1])


def subset_size(strategy: str, slots: int) -> int:
    """Features tried per node, as ``pyspark.ml`` reads the strategy of a single tree."""
    if strategy in ("auto", "all"):
        return slots
    named = {"sqrt": math.sqrt(slots), "log2": math.log2(slots), "onethird": slots / 3}
    if strategy in named:
        return max(1, math.ceil(named[strategy]))
    return min(int(strategy), slots) if strategy.isdigit() else math.ceil(float(strategy) * slots)


def can_fit(classifier, counts: Mapping) -> bool:
    """Whether the classifier's settings are those handled here."""
    return (
        isinstance(classifier, GBTClassifier)
        and set(counts) == {0, 1}
        and classifier.getMaxBins() <= CODES
        and 0 < classifier.getMaxDepth() <= DEEPEST
        and not classifier.isSet("validationIndicatorCol")
        and not classifier.isSet("thresholds")
    )


def _columns(rows: DataFrame, classifier, weights, groups: Sequence[tuple[int, int]], total: int) -> list[Column]:
    """Thresholds of the numeric slots from as large a sample as ``pyspark.ml`` takes, and the categories."""
    bins = classifier.getMaxBins()
    wanted = max(bins**2, 10_000)
    sample = rows if total <= wanted else rows.sample(False, wanted / total, classifier.getSeed())
    found = sample.toArrow()
    x = matrix_of(found["x"].combine_chunks())
    weight = np.asarray(weights)[found["y"].to_numpy()]
    columns, at = [], 0
    hot = dict(groups)
    while at < x.shape[1]:
        width = hot.get(at, 0)
        if not width:
            columns.append(Column(at, 1, thresholds(x[:, at], weight, bins)))
            at += 1
            continue
        # A category of more levels than a byte holds takes several columns.
        columns += [Column(k, min(CODES - 1, at + width - k)) for k in range(at, at + width, CODES - 1)]
        at += width
    return columns


def _pack(rows: DataFrame, columns: list[Column]) -> list[Block]:
    """Blocks of codes, a row per column, with the labels after them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch["x"])
                y = batch["y"].to_numpy(zero_copy_only=False).astype(np.uint8)
                waiting.append((np.stack([column.codes(x) for column in columns]), y))
            if sum(len(y) for _, y in waiting) >= BLOCK_ROWS:
                yield joined(0, waiting)
                waiting = []
        if waiting:
            yield joined(0, waiting)

    return store_blocks(rows, cut, "binned")


def joined(cell: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[int, int, bytes]:
    codes = np.concatenate([codes for codes, _ in parts], axis=1)
    return cell, codes.shape[1], codes.tobytes() + np.concatenate([y for _, y in parts]).tobytes()


def matrix_of(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def codes_and_labels(block: Block) -> tuple[np.ndarray, np.ndarray]:
    data = block.read()
    return data[: -block.rows].reshape(-1, block.rows), data[-block.rows :]


def _slope(y: np.ndarray, scores: np.ndarray | None) -> np.ndarray:
    """The label of a tree: −1 or 1 for the first, then the negative slope of the logistic loss."""
    sign = 2.0 * y - 1.0
    if scores is None:
        return sign
    with np.errstate(over="ignore"):
        return 4.0 * sign / (1.0 + np.exp(2.0 * sign * scores))


def _added(codes, y, label, rows, at, nodes: int, weights, count: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each class and weighted labels per column, node and code, and totals per node.

    ``rows`` are those at one of the nodes, ``label`` and ``at`` theirs; a row may be there several times.
    """
    # The rows of class 0 first, so that both classes are counted without weights.
    one = y.take(rows) == 1
    order = np.concatenate([np.flatnonzero(~one), np.flatnonzero(one)])
    rows, at, label = rows.take(order), at.take(order), label.take(order)
    zeros = len(one) - int(np.count_nonzero(one))
    weighted = label.copy()
    weighted[:zeros] *= weights[0]
    weighted[zeros:] *= weights[1]
    wide = nodes * bins
    found, totals = np.empty((count, 3, wide)), np.empty((4, nodes))
    totals[0] = np.bincount(at[:zeros], minlength=nodes)
    totals[1] = np.bincount(at[zeros:], minlength=nodes)
    totals[2] = np.bincount(at, weighted, nodes)
    totals[3] = np.bincount(at, weighted * label, nodes)
    base = at * bins
    for c in range(count):
        code = base + codes[c].take(rows)
        found[c, 0] = np.bincount(code[:zeros], minlength=wide)
        found[c, 1] = np.bincount(code[zeros:], minlength=wide)
        found[c, 2] = np.bincount(code, weighted, wide)
    return found, totals


def _places(tree: Tree, nodes: list[int]) -> np.ndarray:
    place = np.full(len(tree.child), -1, dtype=np.int64)
    place[nodes] = np.arange(len(nodes))
    return place


def _by_node(found: np.ndarray, totals: np.ndarray, nodes: int) -> tuple[list, list]:
    found = found.reshape(len(found), 3, nodes, found.shape[2] // nodes)
    return [found[:, :, i] for i in range(nodes)], [totals[:, i] for i in range(nodes)]


class ScannedRows:
    """Sums over stored blocks, a pass per level. The scores of a block lie in a file beside it.

    The pass over a tree's first level adds the tree before to the scores, which are written in turns to two files
    per block: a task that is run again finds what the first run found.
    """

    def __init__(self, spark, blocks: list[Block], weights: np.ndarray, rate: float, seed: int) -> None:
        self.spark, self.blocks, self.weights = spark, list(enumerate(blocks)), weights
        self.rate, self.seed, self.folder = rate, seed, new_path(spark, "scores")
        self.number, self.before, self.step = 0, None, 0.0

    def next_tree(self, tree: Tree, step: float) -> None:
        self.number, self.before, self.step = self.number + 1, tree, step

    def count(self, tree: Tree, nodes: list[int], depth: int, sizes: list[int]) -> tuple[list, list]:
        weights, rate, seed, folder, number = self.weights, self.rate, self.seed, self.folder, self.number
        router, place, n, count = tree.router(), _places(tree, nodes), len(nodes), len(sizes)
        bins = max(sizes, default=1)
        before = (self.before.router(), self.step * self.before.prediction(), self.before.depth()) if number and not depth else None

        def scores(at: int, block: Block, codes: np.ndarray) -> np.ndarray | None:
            if not number:
                return None
            if before is None:
                return read_bytes(f"{folder}/{number % 2}-{at}", 0, 8 * block.rows).view(np.float64)
            routes, parts, deep = before
            found = parts.take(_route(codes, np.arange(block.rows), routes, deep))
            if number > 1:
                found += read_bytes(f"{folder}/{(number - 1) % 2}-{at}", 0, 8 * block.rows).view(np.float64)
            write_bytes(f"{folder}/{number % 2}-{at}", found.tobytes())
            return found

        def work(mine: Iterator[tuple[int, Block]]) -> Iterator[bytes]:
            found, totals = np.zeros((count, 3, n * bins)), np.zeros((4, n))
            for at, block in mine:
                codes, y = codes_and_labels(block)
                f = scores(at, block, codes)
                rows = np.arange(block.rows)
                if rate < 1.0:
                    random = np.random.Generator(np.random.SFC64([seed, number, at]))
                    rows = np.flatnonzero(random.random(block.rows, dtype=np.float32) < rate)
                where = place.take(_route(codes, rows, router, depth)) if depth else np.zeros(len(rows), dtype=np.int64)
                if depth:
                    kept = np.flatnonzero(where >= 0)
                    rows, where = rows.take(kept), where.take(kept)
                label = _slope(y.take(rows), None if f is None else f.take(rows))
                part = _added(codes, y, label, rows, where, n, weights, count, bins)
                found += part[0]
                totals += part[1]
            yield found.tobytes() + totals.tobytes()

        flat = np.zeros(count * 3 * n * bins + 4 * n)
        for part in over_blocks(self.spark, self.blocks, work):
            flat += np.frombuffer(part)
        return _by_node(flat[: -4 * n].reshape(count, 3, n * bins), flat[-4 * n :].reshape(4, n), n)


@dataclass(frozen=True)
class Rules:
    columns: list[Column]
    weights: np.ndarray
    tried: int
    least_rows: int
    least_weight: float
    least_gain: float

    def sums(self, totals: np.ndarray) -> np.ndarray:
        return np.array([totals[0] + totals[1], totals[:2] @ self.weights, totals[2], totals[3]])

    def best(self, found: np.ndarray, totals: np.ndarray, random) -> tuple | None:
        """Gain, slot, threshold or left level, levels, column and codes to the right of the best split."""
        slots = self.columns[-1].first + self.columns[-1].width
        tried = np.zeros(slots, dtype=bool)
        tried[random.choice(slots, self.tried, replace=False)] = True
        whole, best = self.sums(totals), None
        for c, column in enumerate(self.columns):
            part = found[c][:, : column.size]
            number = column.cuts is not None
            if number and not tried[column.first]:
                continue
            # Below each threshold, or at each level of the category.
            inside = np.cumsum(part, axis=1)[:, :-1] if number else part[:, : column.width]
            outside = totals[:3, None] - inside
            w, v = (self.weights @ side[:2] for side in (inside, outside))
            enough = np.minimum(inside[:2].sum(0), outside[:2].sum(0)) >= max(self.least_rows, 1)
            enough &= np.minimum(w, v) >= self.least_weight
            if not number:
                enough &= tried[column.first : column.first + column.width]
            if not enough.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                score = inside[2] ** 2 / w + outside[2] ** 2 / v - whole[2] ** 2 / whole[1]
            score = np.where(enough, score, -np.inf)
            # Equal splits differ by rounding; the first of them is taken.
            at = int(np.argmax(score >= score.max() - EQUAL * abs(score.max())))
            gain = float(score[at] / whole[1])
            if gain <= 0 or gain < self.least_gain or (best and gain <= best[0] * (1 + EQUAL)):
                continue
            right = np.zeros(CODES, dtype=np.int64)
            if number:
                right[at + 1 :] = 1
                best = (gain, column.first, float(column.cuts[at]), -1, c, right)
            else:
                # The side of the lower mean is the left one, as for any category of two values.
                left = 1.0 if inside[2][at] / w[at] < outside[2][at] / v[at] else 0.0
                right[:] = int(left)
                right[at] = 1 - int(left)
                best = (gain, column.first + at, left, 2, c, right)
        return best


def grow(source: ScannedRows, depth: int, rules: Rules, random) -> Tree:
    tree = Tree()
    tree.add(np.array([0.0, 1.0, 0.0, 0.0]))
    sizes = [column.size for column in rules.columns]
    found, totals = source.count(tree, [0], 0, sizes)
    tree.sums[0] = rules.sums(totals[0])
    level = [(0, found[0], totals[0])] if tree.sums[0][0] else []
    for d in range(depth):
        pairs = []
        for node, sums, total in level:
            best = rules.best(sums, total, random)
            if best is None:
                continue
            gain, slot, bound, levels, c, right = best
            tree.column[node], tree.right[node], tree.split[node] = c, right, (gain, slot, bound, levels)
            side = (right[: sums.shape[2]] == 0)
            low = sums[c][:, side].sum(axis=1)
            rows = low[:2].sum(), total[:2].sum() - low[:2].sum()
            left = len(tree.child)
            tree.child[node] = left
            for _ in range(2):
                tree.add(np.array([0.0, 1.0, 0.0, 0.0]))
            pairs.append((node, left, int(rows[1] < rows[0]), sums, total))
        if not pairs:
            break
        nodes = [left + few for _, left, few, _, _ in pairs]
        if d + 1 == depth:  # the last children are leaves, of which only the totals are kept
            _, whole = source.count(tree, nodes, depth, [])
            for (_, left, few, _, total), some in zip(pairs, whole):
                tree.sums[left + few], tree.sums[left + 1 - few] = rules.sums(some), rules.sums(total - some)
            break
        counted, whole = source.count(tree, nodes, d + 1, sizes)
        level = []
        for (node, left, few, sums, total), part, some in zip(pairs, counted, whole):
            rest = sums - part
            rest[:, 2][rest[:, 0] + rest[:, 1] == 0] = 0.0
            sides = {few: (part, some), 1 - few: (rest, total - some)}
            for side in (0, 1):
                tree.sums[left + side] = rules.sums(sides[side][1])
                if _impurity(tree.sums[left + side]) >= PURE:
                    level.append((left + side, *sides[side]))
    return tree


def _saved_nodes(number: int, tree: Tree) -> list[tuple]:
    rows = []
    for i, (sums, split) in enumerate(zip(tree.sums, tree.split)):
        gain, slot, bound, levels = split or (-1.0, -1, None, -1)
        left = tree.child[i] if split else -1
        test = (slot, [] if bound is None else [bound], levels)
        stats = [float(v) for v in sums[1:]]
        node = (i, stats[1] / stats[0], _impurity(sums), stats, int(sums[0]), gain, left, left + 1 if split else -1, test)
        rows.append((number, node))
    return rows


def _as_model(spark, classifier: GBTClassifier, trees: list[Tree], tree_weights, slots: int) -> GBTClassificationModel:
    """The trees as a model of ``pyspark.ml``, through the form in which it saves one of two rows."""
    y, x, w = classifier.getLabelCol(), classifier.getFeaturesCol(), classifier.getWeightCol()
    two = spark.createDataFrame([(i, [float(i)] * slots, 1.0) for i in (0, 1)], f"{y} long, x array<double>, {w} double")
    two = two.select(y, array_to_vector("x").alias(x), w).coalesce(1)
    form, path = new_path(spark, "ensemble-form"), new_path(spark, "ensemble")
    plain = classifier.copy({classifier.maxIter: 1, classifier.subsamplingRate: 1.0, classifier.minInstancesPerNode: 1})
    plain.fit(two).save(form)
    about = json.loads(spark.read.text(f"{form}/metadata").first()[0])
    about["numTrees"] = len(trees)
    about["paramMap"] |= {p.name: classifier.getOrDefault(p) for p in (
        classifier.maxIter, classifier.subsamplingRate, classifier.minInstancesPerNode)}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    of_trees = spark.read.parquet(f"{form}/treesMetadata")
    first = of_trees.first().asDict()
    weight_of = next(c for c, kind in of_trees.dtypes if kind == "double")
    described = [{**first, "treeID": i, weight_of: weight} for i, weight in enumerate(tree_weights)]
    rows = [tuple(row[c] for c in of_trees.columns) for row in described]
    spark.createDataFrame(rows, of_trees.schema).coalesce(1).write.parquet(f"{path}/treesMetadata")
    schema = spark.read.parquet(f"{form}/data").schema
    nodes = [row for i, tree in enumerate(trees) for row in _saved_nodes(i, tree)]
    spark.createDataFrame(nodes, schema).coalesce(1).write.parquet(f"{path}/data")
    return GBTClassificationModel.load(path)


def fit_binned(
    prepared: DataFrame, classifier: GBTClassifier, counts: Mapping, weights: Mapping, groups: Sequence[tuple[int, int]]
) -> GBTClassificationModel:
    """``classifier`` fitted to the rows of a feature vector.

    ``counts`` and ``weights`` are the rows and the row weight of each class, ``groups`` the first slot and the
    number of slots of each one-hot category. Rows and features of a tree are drawn from the seed, the number
    of the tree and the stored block, not as ``pyspark.ml`` draws them by partition.
    """
    spark, target = prepared.sparkSession, F.col(classifier.getLabelCol())
    class_weights = np.array([float(weights[0]), float(weights[1])])
    rows = prepared.select(vector_to_array(classifier.getFeaturesCol()).alias("x"), target.cast("int").alias("y"))
    total = sum(counts.values())
    columns = _columns(rows, classifier, class_weights, groups, total)
    slots = columns[-1].first + columns[-1].width
    depth, seed = classifier.getMaxDepth(), classifier.getSeed()
    rate = classifier.getSubsamplingRate()
    whole = sum(counts[k] * class_weights[k] for k in (0, 1))
    rules = Rules(
        columns,
        class_weights,
        subset_size(classifier.getFeatureSubsetStrategy(), slots),
        classifier.getMinInstancesPerNode(),
        classifier.getMinWeightFractionPerNode() * whole,
        classifier.getMinInfoGain(),
    )
    random = np.random.default_rng(abs(seed))
    source = ScannedRows(spark, _pack(rows, columns), class_weights, rate, abs(seed))
    trees, tree_weights = [], []
    for number in range(classifier.getMaxIter()):
        tree = grow(source, depth, rules, random)
        trees.append(tree)
        tree_weights.append(classifier.getStepSize() if number else 1.0)
        source.next_tree(tree, tree_weights[-1])
    return _as_model(spark, classifier, trees, tree_weights, slots)
