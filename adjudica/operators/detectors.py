"""Model-based outlier detectors, and the vote of all five lenses."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adjudica.functions.attach import attach
from adjudica.functions.ordering import quantile_row
from adjudica.operators.autoencoder import ROW_GROUP
from adjudica.operators.outliers import RULES, consensus, remove_flagged, rule_flags
from adjudica.operators.preprocess import preprocessor
from adjudica.session import materialize
from adjudica.spec import KNOBS, TableSpec

TREES, TREE_ROWS = 100, 256
COMPONENTS = 128
#: The boundary of a table of more rows starts from a part of it of about so many rows.
WHOLE_ROWS, START_ROWS = 200_000, 50_000
#: Lengths of a step tried in one scan, scans at most, and the share of the loss a step must promise.
LINE_STEPS, MOST_SCANS, TOLERANCE = (1.0, 0.5, 0.1), 50, 1e-7
#: Rows worked on at a time, and rows of one matrix product: too few for the library to split it over threads.
BLOCK_ROWS, PIECE_ROWS = 1024, 15


class UnknownDetectorError(ValueError):
    def __init__(self, name: str) -> None:
        known = ", ".join(sorted(DETECTORS))
        super().__init__(f"no detector is named {name!r}; there are {known}")


def encode(frame: DataFrame, spec: TableSpec) -> DataFrame:
    """The frame with all its features, sensitive ones included, as the array of numbers ``x``."""
    model = preprocessor(spec.numeric, spec.categorical).fit(frame)
    return model.transform(frame).select(*frame.columns, vector_to_array("features").alias("x"))


def _uniform(*parts) -> Column:
    """A repeatable number in [0, 1) from the given columns and constants."""
    bits = F.shiftrightunsigned(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), 11)
    return bits / F.lit(float(2**53))


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n rows (Liu et al. 2008)."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def tree_samples(encoded: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """At most ``TREE_ROWS`` random rows for each tree: the sample the method is defined on.

    Every row draws once for every tree, whatever the size of the table.
    """
    share = min(1.0, 1.5 * TREE_ROWS / rows)
    trees = F.filter(
        F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: _uniform(F.col(key), seed, t) < share
    )
    taken = encoded.withColumn("tree", F.explode(trees))
    return taken.withColumn("order", F.xxhash64(key, F.col("tree"), F.lit(seed)))


def _grow(seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def grow(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values("order").head(TREE_ROWS)
        tree = int(sample["tree"].iloc[0])
        x = np.stack(sample["x"].to_numpy()).astype(float)
        random = np.random.default_rng([seed, tree])
        limit = math.ceil(math.log2(max(len(x), 2)))
        nodes: list[list[float]] = []

        def split(rows: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, -1, -1, depth + average_path(len(rows))])
            low, high = x[rows].min(axis=0), x[rows].max(axis=0)
            open_columns = np.flatnonzero(high > low)
            if depth >= limit or len(rows) < 2 or not len(open_columns):
                return at
            column = int(random.choice(open_columns))
            cut = float(random.uniform(low[column], high[column]))
            left = x[rows, column] <= cut
            nodes[at][0], nodes[at][1] = column, cut
            nodes[at][2] = split(rows[left], depth + 1)
            nodes[at][3] = split(rows[~left], depth + 1)
            return at

        split(np.arange(len(x)), 0)
        table = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "path"])
        table.insert(0, "node", range(len(table)))
        table.insert(0, "tree", tree)
        table["sample"] = len(x)
        return table.astype(
            {"tree": "int32", "node": "int32", "feature": "int32", "left": "int32", "right": "int32"}
        )

    return grow


FOREST = (
    "tree int, node int, feature int, cut double, left int, right int, path double, sample long"
)


def isolation_score(encoded: DataFrame, key: str, seed: int = KNOBS.seed) -> Column:
    """Fit an isolation forest; the column scores a row near 1 if a few random cuts isolate it.

    Trees grow on their own executors from at most 256 rows each and are broadcast to score all
    rows; the forest's size does not depend on the table.
    """
    samples = tree_samples(encoded.select(key, "x"), key, encoded.count(), seed)
    forest = samples.groupBy("tree").applyInPandas(_grow(seed), FOREST).toPandas()
    trees = [
        tuple(t[c].to_numpy() for c in ("feature", "cut", "left", "right", "path"))
        for _, t in forest.sort_values(["tree", "node"]).groupby("tree")
    ]
    scale = average_path(float(forest.groupby("tree")["sample"].first().mean()))
    shared = encoded.sparkSession.sparkContext.broadcast((trees, scale))

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trees, scale = shared.value
        for batch in batches:
            x = np.stack(batch.to_numpy()).astype(float) if len(batch) else np.zeros((0, 1))
            total, here = np.zeros(len(x)), np.arange(len(x))
            for feature, cut, left, right, path in trees:
                at = np.zeros(len(x), dtype=int)
                while (inner := feature[at] >= 0).any():
                    goes_left = x[here, np.maximum(feature[at], 0)] <= cut[at]
                    at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
                total += path[at]
            yield pd.Series(np.exp2(-total / (len(trees) * scale)))

    return F.pandas_udf(score, "double")("x")


def _lifted(x: np.ndarray, directions: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Random cosine features of the rows of ``x``."""
    found = np.empty((len(x), COMPONENTS))
    for rows in _pieces(len(x), 4 * PIECE_ROWS):  # small enough to stay in the cache
        angles = x[rows] @ directions
        angles += shifts
        np.multiply(np.cos(angles, out=angles), math.sqrt(2.0 / COMPONENTS), out=found[rows])
    return found


def _pieces(count: int, size: int) -> list[slice]:
    return [slice(first, first + size) for first in range(0, count, size)]


def _packed(encoded: DataFrame) -> DataFrame:
    """The rows' arrays as blocks of doubles, stored once; a scan then reads bytes, not rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                blocks = [np.ascontiguousarray(x[rows]).tobytes() for rows in _pieces(len(x), BLOCK_ROWS)]
                yield pa.RecordBatch.from_pydict({"block": pa.array(blocks, pa.binary())})

    options = {"parquet.block.size": ROW_GROUP}
    return materialize(encoded.select("x").mapInArrow(pack, "block binary"), "blocks", **options)


def _task_sums(blocks: DataFrame, columns: int, part_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``part_of`` over all blocks of rows; each row of it is added up by one task."""

    def work(batches):
        total = None
        for batch in batches:
            for block in batch["block"]:
                part = part_of(np.frombuffer(block.as_buffer()).reshape(-1, columns))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict(
                {"k": pa.array(range(len(total)), pa.int32()), "part": pa.array([t.tobytes() for t in total], pa.binary())}
            )

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch["k"].to_pylist(), batch["part"].to_pylist()):
                part = np.frombuffer(data)
                totals[k] = totals[k] + part if k in totals else part
        yield pa.RecordBatch.from_pydict(
            {"k": pa.array(list(totals), pa.int32()), "part": pa.array([t.tobytes() for t in totals.values()], pa.binary())}
        )

    schema = "k int, part binary"
    parts = blocks.mapInArrow(work, schema).repartition(len(LINE_STEPS), "k")
    return np.stack([np.frombuffer(r["part"]) for r in sorted(parts.mapInArrow(add, schema).collect())])


def _hinge_sums(blocks: DataFrame, points: list[np.ndarray], width: float, directions, shifts) -> np.ndarray:
    """For each point the sums over all rows of the hinge loss, its gradient, the margins and their squares,
    and of the curvature: the rows within ``width`` of the boundary stand for the kinks there."""
    at = np.stack(points, axis=1)

    def part_of(x: np.ndarray) -> np.ndarray:
        z = _lifted(x, directions, shifts)
        gaps = np.concatenate([1.0 - z[piece] @ at for piece in _pieces(len(z), 4 * PIECE_ROWS)])
        inside = (gaps > 0.0).astype(float)
        slopes = sum(z[piece].T @ inside[piece] for piece in _pieces(len(z), 8 * PIECE_ROWS))
        sums = np.zeros((len(points), 3 + COMPONENTS + COMPONENTS * COMPONENTS))
        for k, gap in enumerate(gaps.T):
            near = z[np.abs(gap) < width]
            sums[k, :3] = gap @ inside[:, k], (1.0 - gap).sum(), ((1.0 - gap) ** 2).sum()
            sums[k, 3 : 3 + COMPONENTS] = -slopes[:, k]
            curvature = sums[k, 3 + COMPONENTS :].reshape(COMPONENTS, COMPONENTS)
            for piece in _pieces(len(near), PIECE_ROWS):
                curvature += near[piece].T @ near[piece]
            curvature /= 2.0 * width
        return sums

    return _task_sums(blocks, len(directions), part_of)


def _boundary(
    blocks: DataFrame, rows: int, start: np.ndarray, spread: float, penalty: float, directions, shifts
) -> tuple[np.ndarray, int]:
    """The minimum of the mean hinge loss plus |weights|² · penalty / 2 over all rows, and the scans taken.

    Newton steps from ``start``, the optimum of a small part, whose margins have the deviation ``spread``. A scan
    tries a step at several lengths, and the lowest loss leads on. It ends when a step promises less than
    ``TOLERANCE`` of the loss.
    """

    width = max(spread * rows**-0.2, 1e-6)
    points, best, found = [start], None, math.inf
    for scan in range(1, MOST_SCANS + 1):
        sums = _hinge_sums(blocks, points, width, directions, shifts)
        losses = [s[0] / rows + penalty / 2.0 * float(p @ p) for s, p in zip(sums, points)]
        k = int(np.argmin(losses))
        if not losses[k] < found:
            break
        best, found, lowest = points[k], losses[k], sums[k]
        gradient = lowest[3 : 3 + COMPONENTS] / rows + penalty * best
        curvature = lowest[3 + COMPONENTS :].reshape(COMPONENTS, COMPONENTS) / rows + penalty * np.eye(COMPONENTS)
        step = -np.linalg.solve(curvature, gradient)
        if -float(gradient @ step) / 2.0 < TOLERANCE * found:
            break
        points = [best + length * step for length in LINE_STEPS]
    return best, scan


def one_class_score(
    encoded: DataFrame, nu: float = KNOBS.contamination, seed: int = KNOBS.seed
) -> Column:
    """Fit a one-class boundary; the column scores how far a row lies on its wrong side.

    The RBF kernel is approximated by random cosine features (Rahimi & Recht 2007). Separating the
    features from the origin is a linear support vector problem without intercept between the rows
    and their mirror images. Spark's ``LinearSVC`` solves it, over the whole of a table of up to ``WHOLE_ROWS``.
    It would keep 256 features of every row of a larger one; there it solves a small part, from whose boundary
    Newton steps over all rows, which make their features anew, go to the optimum of the same loss.
    """
    sizes = encoded.agg(
        F.first(F.size("x")).alias("width"),
        F.avg(F.aggregate("x", F.lit(0.0), lambda a, v: a + v)).alias("sum"),
        F.avg(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("squares"),
        F.count(F.lit(1)).alias("rows"),
    ).first()
    width, rows = sizes["width"], sizes["rows"]
    variance = sizes["squares"] / width - (sizes["sum"] / width) ** 2
    gamma = 1.0 / (width * variance) if variance > 0 else 1.0
    random = np.random.default_rng(seed)
    directions = random.normal(0.0, math.sqrt(2.0 * gamma), (width, COMPONENTS))
    shifts = random.uniform(0.0, 2.0 * math.pi, COMPONENTS)

    def cosines(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if not len(batch):
                yield pd.Series([], dtype=object)
                continue
            yield pd.Series(list(_lifted(np.stack(batch.to_numpy()).astype(float), directions, shifts)))

    whole = rows <= WHOLE_ROWS
    fitted = encoded.select("x") if whole else materialize(encoded.select("x").sample(START_ROWS / rows, seed=0), "start")
    lifted = fitted.select(F.pandas_udf(cosines, "array<double>")("x").alias("z"))
    # The squared norm of the mean feature vector estimates the margin that turns ν into a penalty.
    if whole:
        center = lifted.select(Summarizer.mean(array_to_vector("z"))).first()[0].toArray()
    else:
        blocks = _packed(encoded)
        center = _task_sums(blocks, width, lambda x: _lifted(x, directions, shifts).sum(axis=0)[None])[0] / rows
    penalty = max(nu * float(center @ center), 1e-6)
    mirror = F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("z").alias("z")),
        F.struct(F.lit(0.0).alias("label"), F.transform("z", lambda v: -v).alias("z")),
    )
    both = lifted.select(F.inline(mirror)).select("label", array_to_vector("z").alias("features"))
    svm = LinearSVC(fitIntercept=False, standardization=False, regParam=penalty, maxIter=50).fit(both)
    weights = svm.coefficients.toArray()
    if not whole:
        z = Summarizer.std(array_to_vector("z")).alias("std")
        spread = float(np.linalg.norm(lifted.select(z).first()[0].toArray() * weights))
        weights, _ = _boundary(blocks, rows, weights, spread, penalty, directions, shifts)

    def margin(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if not len(batch):
                yield pd.Series([], dtype=float)
                continue
            x = np.stack(batch.to_numpy()).astype(float)
            yield pd.Series(1.0 - _lifted(x, directions, shifts) @ weights)

    return F.pandas_udf(margin, "double")("x")


Detector = Callable[[DataFrame, str, float], Column]
DETECTORS: dict[str, Detector] = {
    "isolation_forest": lambda encoded, key, share: isolation_score(encoded, key),
    "one_class_svm": lambda encoded, key, share: one_class_score(encoded, share),
}


def get_detector(name: str) -> Detector:
    if name not in DETECTORS:
        raise UnknownDetectorError(name)
    return DETECTORS[name]


def model_flags(
    frame: DataFrame,
    spec: TableSpec,
    contamination: float = KNOBS.contamination,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """The frame with a score of each detector and a flag on the given share of highest scores.

    Scores are columns of the frame itself, so nothing is joined. They are stored once, because
    both the cut and the flag read them.
    """
    names = sorted(DETECTORS) if names is None else list(names)
    detectors = [get_detector(name) for name in names]
    encoded = materialize(encode(frame, spec), "encoded")
    scores = {f"{n}_score": d(encoded, spec.key, contamination) for n, d in zip(names, detectors)}
    scored = materialize(encoded.withColumns(scores).drop("x"), "scores")
    cuts = quantile_row(scored, list(scores), [1.0 - contamination])
    return (
        attach(scored, cuts, name="_c")
        .withColumns(
            {n: F.col(f"{n}_score") > F.get(f"_c.{n}_score", F.lit(0)) for n in names}
        )
        .drop("_c")
    )


def all_flags(
    frame: DataFrame, spec: TableSpec, contamination: float = KNOBS.contamination
) -> DataFrame:
    """The frame with a flag of each rule and each detector."""
    found = rule_flags(model_flags(frame, spec, contamination), spec)
    return found.select(*frame.columns, *LENSES)


LENSES = (*RULES, *sorted(DETECTORS))


def clean_training_rows(
    frame: DataFrame,
    spec: TableSpec,
    contamination: float = KNOBS.contamination,
    at_least: int = KNOBS.votes,
) -> tuple[DataFrame, DataFrame]:
    """Training rows without the consensus outliers, and all rows with their flags.

    Pass training rows alone; a holdout keeps its unusual applicants, so that it is scored whole.
    """
    voted = consensus(all_flags(frame, spec, contamination), LENSES, at_least)
    return remove_flagged(voted).select(*frame.columns), voted
