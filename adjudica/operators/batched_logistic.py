"""Many penalised logistic regressions over one table, fitted together by Newton's method.

A fit is a set of columns, a training subset and a penalty. Every scan of the table serves all fits that
have not converged: a task adds up loss, gradient and curvature of each, and only these small matrices
leave it. Each fit is standardised by the statistics of its own training rows; as filling and scaling
are linear in (value or 0, is missing, 1), all fits share one matrix per batch of rows, and the fits of
equal columns are evaluated by matrix products over all of them. A large table is scanned from the optimum
of a small part of it, which saves scans and changes no result: a fit ends by its sums over all its rows.

The scores of many fits are ranked as packed numbers: a row of the shuffle holds thousands of scores.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adjudica.functions.subsets import Subset, added_moments, cell_levels, cell_moments, subset_medians
from adjudica.operators.preprocess import MISSING_CATEGORY
from adjudica.session import materialize

#: Scans at most; a fit ends earlier, when a step would lower its mean loss by less than TOLERANCE.
MOST_SCANS = 40
TOLERANCE = 1e-13
#: Decimal places of a probability, so that equal rows keep equal scores in every batch.
PLACES = 12
ADDERS = 64
#: The part on which a larger table's fits start, as rows and at least as a share; rows that choose the cuts of ranks.
START_ROWS, START_SHARE, CUT_ROWS = 200_000, 0.02, 20_000
#: Rows whose products of columns are held at a time; scores held by a task; scores ranked at a time.
BLOCK_ROWS, HELD_SCORES, RANKED_SCORES = 1024, 4_000_000, 250_000


@dataclass(frozen=True)
class Fit:
    """One regression: its columns, the cells it is trained on, and the inverse strength of its penalty.

    Numeric columns that are ``plain`` enter as they are, without scaling.
    """

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    cells: Subset
    strength: float = 1.0
    plain: frozenset[str] = frozenset()


@dataclass
class _State:
    """A fit under way: map from its features to the shared columns, and its newest and best point."""

    spread: np.ndarray
    used: np.ndarray
    weights: tuple[float, float]
    penalty: float
    rows: float
    point: np.ndarray
    best: np.ndarray | None = None
    loss: float = np.inf
    step: np.ndarray = field(default_factory=lambda: np.zeros(0))
    done: bool = False
    constant: float | None = None

    def shared(self) -> np.ndarray:
        return self.spread @ self.point


@dataclass(frozen=True)
class _Design:
    """How a row becomes a row of the shared matrix: 1, scaled numbers, missing flags, levels."""

    target: str
    cell: str
    numeric: tuple[str, ...]
    centre: np.ndarray
    scale: np.ndarray
    categorical: tuple[str, ...]
    levels: tuple[tuple[str, ...], ...]

    @property
    def width(self) -> int:
        return 1 + 2 * len(self.numeric) + sum(map(len, self.levels))

    def first_level(self, k: int) -> int:
        return 1 + 2 * len(self.numeric) + sum(map(len, self.levels[:k]))

    def read(self, frame: DataFrame, *keep: str) -> DataFrame:
        return frame.select(
            *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)],
            F.col(self.target).cast("double").alias("y"),
            F.col(self.cell).cast("int").alias("cell"),
            *[F.col(c).cast("double").alias(f"n{i}") for i, c in enumerate(self.numeric)],
            *[F.coalesce(F.col(c).cast("string"), F.lit(MISSING_CATEGORY)).alias(f"c{i}") for i, c in enumerate(self.categorical)],
        )

    def matrix(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((batch.num_rows, self.width))
        out[:, 0] = 1.0
        count = len(self.numeric)
        for k in range(count):
            x = batch[f"n{k}"].to_numpy(zero_copy_only=False)
            gone = np.isnan(x)
            out[:, 1 + k] = np.where(gone, 0.0, (x - self.centre[k]) / self.scale[k])
            out[:, 1 + count + k] = gone
        for k, levels in enumerate(self.levels):
            code = pc.index_in(batch[f"c{k}"], value_set=pa.array(levels, pa.string()))
            known = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
            out[known, self.first_level(k) + code.drop_null().to_numpy()] = 1.0
        return out


@dataclass(frozen=True)
class FittedBatch:
    """All fits of a batch: coefficients over the shared columns, and scores of any rows."""

    design: _Design
    fits: tuple[Fit, ...]
    coefficients: np.ndarray
    constants: tuple[float | None, ...]
    gradients: np.ndarray
    scans: int
    rows: float = 0.0

    def probabilities(self, matrix: np.ndarray, numbers: Sequence[int]) -> np.ndarray:
        """Of class 1 by the fits of these numbers, a column each."""
        p = 1.0 / (1.0 + np.exp(-np.clip(matrix @ self.coefficients[list(numbers)].T, -700, 700)))
        for i, number in enumerate(numbers):
            if self.constants[number] is not None:
                p[:, i] = self.constants[number]
        return p

    def column(self, number: int) -> Column:
        """The probability of class 1 by one fit, as an expression over the table's own columns."""
        if self.constants[number] is not None:
            return F.lit(float(self.constants[number]))
        design, weights = self.design, [float(w) for w in self.coefficients[number]]
        eta, count = F.lit(weights[0]), len(design.numeric)
        for k, name in enumerate(design.numeric):
            if weights[1 + k] or weights[1 + count + k]:
                x = F.col(name).cast("double")
                part = (x - F.lit(float(design.centre[k]))) / F.lit(float(design.scale[k])) * F.lit(weights[1 + k])
                eta = eta + F.when(x.isNull() | F.isnan(x), F.lit(weights[1 + count + k])).otherwise(part)
        for k, name in enumerate(design.categorical):
            text, part, first = F.coalesce(F.col(name).cast("string"), F.lit(MISSING_CATEGORY)), F, design.first_level(k)
            for i, level in enumerate(design.levels[k]):
                part = part.when(text == level, F.lit(weights[first + i]))
            if part is not F:
                eta = eta + part.otherwise(0.0)
        return F.rint(F.lit(10.0**PLACES) / (F.lit(1.0) + F.exp(-eta))) / F.lit(10.0**PLACES)

    def ranked(self, frame: DataFrame, asked: Sequence[tuple[int, Subset, tuple]], labels: str) -> DataFrame:
        """(labels, rows, average_precision, roc_auc) of the rows that ``score`` gives for each entry of ``asked``.

        A task sorts its scores and cuts them at points that a small part of the table chooses; the points only
        balance the work. A score and its class are one whole number, and a row of the shuffle holds
        the numbers of a task between two points. What lies above a bucket is known from the buckets' counts.
        """
        design = self.design
        present = frame.where(F.col(design.target).isNotNull())
        together: dict[Subset, list[int]] = {}
        for entry, (_, scored, _) in enumerate(asked):
            together.setdefault(scored, []).append(entry)

        def packed(batch):
            """Entries with the sorted numbers of a batch's rows."""
            matrix, y, cells = design.matrix(batch), batch["y"].to_numpy(), batch["cell"].to_numpy()
            for scored, entries in together.items():
                at = np.flatnonzero(np.isin(cells, list(scored)))
                if len(at):
                    p = self.probabilities(matrix[at], [asked[e][0] for e in entries])
                    yield from zip(entries, np.ascontiguousarray(whole_numbers(p, y[at][:, None]).T))

        cuts: list[np.ndarray] = [np.zeros(0, np.int64)] * len(asked)
        if self.rows > RANKED_SCORES:
            share = min(1.0, CUT_ROWS / self.rows)
            few = design.read(present.sample(share, seed=0)).toArrow().to_batches()
            cuts = cuts_of((part for batch in few for part in packed(batch)), len(asked), share)
        return ranked_scores(pack(design.read(present), packed, cuts), [values for _, _, values in asked], labels)

    def score(self, frame: DataFrame, asked: Sequence[tuple[int, Subset, tuple]], keep: Sequence[str] = (), labels: str = "") -> DataFrame:
        """(kept columns, labels, y, p): each row of ``frame`` once per entry of ``asked`` whose cells hold it.

        An entry is a fit's number, the cells it scores, and the values of the columns named in the schema
        ``labels``. Rows without a target are not scored.
        """
        design, weights, constants = self.design, self.coefficients, self.constants
        kinds = [piece.strip().split() for piece in labels.split(",") if piece.strip()]
        rows = design.read(frame.where(F.col(design.target).isNotNull()), *keep)
        kept = [f"k{i}" for i in range(len(keep))]
        label_types = [{"int": pa.int32(), "string": pa.string(), "double": pa.float64()}[kind] for _, kind in kinds]

        def work(batches):
            for batch in batches:
                matrix, cells = design.matrix(batch), batch["cell"].to_numpy()
                for number, scored, values in asked:
                    at = np.flatnonzero(np.isin(cells, list(scored)))
                    if not len(at):
                        continue
                    if constants[number] is None:
                        p = 1.0 / (1.0 + np.exp(-np.clip(matrix[at] @ weights[number], -700, 700)))
                    else:
                        p = np.full(len(at), constants[number])
                    places = pa.array(at)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[batch[k].take(places) for k in kept],
                            *[pa.array([v] * len(at), t) for v, t in zip(values, label_types)],
                            batch["y"].take(places),
                            pa.array(np.round(p, PLACES)),
                        ],
                        [*kept, *[name for name, _ in kinds], "y", "p"],
                    )

        types = [f"{name} {rows.schema[name].dataType.simpleString()}" for name in kept]
        schema = ", ".join([*types, *[" ".join(kind) for kind in kinds], "y double", "p double"])
        out = rows.mapInArrow(work, schema)
        return out.select(*[F.col(k).alias(c) for k, c in zip(kept, keep)], *out.columns[len(kept) :])


PACKED = "entry int, bucket int, ones long, zeros long, numbers binary, counts binary"


def whole_numbers(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Scores and their classes as whole numbers in the order of the scores."""
    # A score that is no number comes first, as in the order of a column.
    return np.rint(np.where(np.isnan(p), 2.0, p) * 10.0**PLACES).astype(np.int64) * 2 + (y > 0)


def cuts_of(parts, entries: int, share: float) -> list[np.ndarray]:
    """Where each entry's numbers are cut, from those of about this share of the rows."""
    cuts, few = [np.zeros(0, np.int64)] * entries, {}
    for entry, whole in parts:
        few.setdefault(entry, []).append(whole)
    for entry, found in few.items():
        scores = np.sort(np.concatenate(found)) >> 1
        buckets = int(np.ceil(len(scores) / share / RANKED_SCORES))
        cuts[entry] = np.unique(scores[len(scores) * np.arange(1, buckets) // buckets]) << 1
    return cuts


def pack(rows: DataFrame, packed, cuts: Sequence[np.ndarray]) -> DataFrame:
    """The numbers that ``packed`` gives for the batches of ``rows``, sorted and cut in each task."""
    held = HELD_SCORES

    def work(batches):
        waiting: dict[int, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            for entry, whole in packed(batch):
                waiting.setdefault(entry, []).append(whole)
                size += len(whole)
                if size >= held:
                    yield from _cut(waiting, cuts)
                    waiting, size = {}, 0
        yield from _cut(waiting, cuts)

    return rows.mapInArrow(work, PACKED)


def ranked_scores(numbers: DataFrame, labelled: Sequence[tuple], labels: str) -> DataFrame:
    """(labels, rows, average_precision, roc_auc) of each entry of packed numbers."""
    spark, stored = numbers.sparkSession, materialize(numbers, "ranks")
    sums = stored.groupBy("entry", "bucket").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    ahead: dict[tuple[int, int], tuple[int, int]] = {}
    whole_of: dict[int, tuple[int, int]] = {}
    for r in sorted(sums.collect(), key=lambda r: (r["entry"], -r["bucket"])):
        ones, zeros = whole_of.get(r["entry"], (0, 0))
        ahead[r["entry"], r["bucket"]] = ones, zeros
        whole_of[r["entry"]] = ones + r["ones"], zeros + r["zeros"]

    def rank(key, table):
        entry, bucket = (k.as_py() for k in key)
        gained, lost = _rank(table, *ahead[entry, bucket])
        return pa.table({"entry": pa.array([entry], pa.int32()), "gained": [gained], "lost": [lost]})

    parts = stored.select("entry", "bucket", "numbers", "counts").groupBy("entry", "bucket")
    added = parts.applyInArrow(rank, "entry int, gained double, lost double").groupBy("entry").agg(
        F.sum("gained").alias("gained"), F.sum("lost").alias("lost")
    )
    names = [piece.strip().split()[0] for piece in labels.split(",")]
    of_entry = [(e, *labelled[e], *whole_of[e]) for e in whole_of]
    known = spark.createDataFrame(of_entry, f"entry int, {labels}, ones long, zeros long")
    pairs = F.col("ones").cast("double") * F.col("zeros")
    return added.join(F.broadcast(known), "entry").select(
        *names,
        (F.col("ones") + F.col("zeros")).alias("rows"),
        F.try_divide("gained", F.col("ones").cast("double")).alias("average_precision"),
        F.try_divide("lost", pairs).alias("roc_auc"),
    )


def _cut(waiting: dict[int, list[np.ndarray]], cuts: Sequence[np.ndarray]):
    """Each entry's numbers sorted and cut into buckets; numbers that repeat much are counted."""
    for entry, parts in waiting.items():
        numbers = np.sort(np.concatenate(parts))
        ends = [0, *np.searchsorted(numbers, cuts[entry]), len(numbers)]
        found = []
        for bucket, (first, last) in enumerate(zip(ends, ends[1:])):
            part = numbers[first:last]
            if not len(part):
                continue
            starts, ones, counts = np.flatnonzero(np.diff(part, prepend=-1)), int((part & 1).sum()), b""
            if 2 * len(starts) < len(part):
                counts = np.diff(starts, append=len(part)).astype(np.int64).tobytes()
                part = part[starts]
            found.append((entry, bucket, ones, int(last - first) - ones, part.tobytes(), counts))
        types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        columns = [pa.array(values, kind) for values, kind in zip(zip(*found), types)]
        yield pa.RecordBatch.from_arrays(columns, [piece.split()[0] for piece in PACKED.split(", ")])


def _rank(table: pa.Table, ones_ahead: int, zeros_ahead: int) -> tuple[float, float]:
    """Sums of ones × precision and of zeros × the ones above them over a bucket's distinct scores."""
    parts, counts = [], []
    for numbers, count in zip(table["numbers"].to_pylist(), table["counts"].to_pylist()):
        parts.append(np.frombuffer(numbers, np.int64))
        counts.append(np.frombuffer(count, np.int64) if count else np.ones(len(parts[-1]), np.int64))
    numbers, count = np.concatenate(parts), np.concatenate(counts)
    order = np.argsort(-numbers)
    numbers, count = numbers[order], count[order]
    starts = np.flatnonzero(np.diff(numbers >> 1, prepend=-1))
    ones = np.add.reduceat(count * (numbers & 1), starts)
    zeros = np.add.reduceat(count, starts) - ones
    tp, fp = ones_ahead + np.cumsum(ones), zeros_ahead + np.cumsum(zeros)
    return float((ones * (tp / (tp + fp))).sum()), float((zeros * (tp - ones / 2.0)).sum())


def fit_batch(frame: DataFrame, target: str, cell: str, fits: Sequence[Fit]) -> FittedBatch:
    """Fit all of ``fits`` on ``frame``, a stored table with a whole number ``cell`` in every row.

    Each minimises the mean over its training rows of the log loss, classes weighted to equal sums, plus
    |coefficients|² / (2 · strength · rows); numbers are filled with the median and scaled, a missing category is
    a level of its own, and a level that the training rows lack has no weight. A fit whose training rows hold
    one class gives its share as a constant. Rows without a target are left out; NaN counts as missing.
    """
    numeric = tuple(dict.fromkeys(c for f in fits for c in f.numeric))
    categorical = tuple(dict.fromkeys(c for f in fits for c in f.categorical))
    subsets = list(dict.fromkeys(f.cells for f in fits))
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c)
    rows = frame.where(F.col(target).isNotNull()).select(target, cell, *map(number, numeric), *categorical)
    moments = cell_moments(rows, cell, [target, *numeric])
    classes = {c: m[0] for c, m in moments.items()}
    numbers = {c: m[1:] for c, m in moments.items()}
    everything = added_moments(list(numbers.values())) if numbers else np.zeros((len(numeric), 3))
    medians = subset_medians(rows, cell, numeric, subsets, numbers)
    found = cell_levels(rows, cell, categorical, MISSING_CATEGORY)
    levels = tuple(tuple(sorted(set().union(*found[c].values()))) for c in categorical)
    design = _Design(target, cell, numeric, everything[:, 1], np.sqrt(everything[:, 2]), categorical, levels)
    design.scale[design.scale == 0.0] = 1.0
    total = float(sum(m[0] for m in classes.values()))
    blank = [k for k in range(len(numeric)) if everything[k, 0] < total]
    states = [
        _start(f, design, classes, numbers, medians[subsets.index(f.cells)], found, blank) for f in fits
    ]
    cells = [f.cells for f in fits]
    if total > 4 * START_ROWS and any(not s.done for s in states):
        share = max(START_ROWS / total, START_SHARE)
        small = [replace(s, rows=s.rows * share) for s in states]
        _descend(design, materialize(rows.sample(share, seed=0), "start"), cells, small)
        for state, near in zip(states, small):
            if near.best is not None and np.isfinite(near.best).all():
                state.point = near.best
    gradients, scans = _descend(design, rows, cells, states)
    coefficients = np.array([s.spread @ (s.point if s.best is None else s.best) for s in states])
    return FittedBatch(
        design, tuple(fits), coefficients, tuple(s.constant for s in states), gradients, scans, total
    )


def _descend(design: _Design, rows: DataFrame, cells: list[Subset], states: list[_State]) -> tuple[np.ndarray, int]:
    """Newton steps of all fits until the last ends: the sizes of their gradients, and the scans taken."""
    scans = 0
    gradients = np.zeros(len(states))
    while scans < MOST_SCANS and any(not s.done for s in states):
        active = [j for j, s in enumerate(states) if not s.done]
        sums = _evaluate(design, rows, [cells[j] for j in active], [states[j] for j in active])
        scans += 1
        for k, j in enumerate(active):
            gradients[j] = _advance(states[j], sums[k])
    return gradients, scans


def _start(fit: Fit, design: _Design, classes, numbers, medians, found, blank: list[int]) -> _State:
    """The zero model of a fit, with the map from its own features to the shared columns."""
    inside = [c for c in fit.cells if c in classes]
    total = sum(classes[c][0] for c in inside)
    ones = sum(classes[c][0] * classes[c][1] for c in inside)
    columns = [np.eye(design.width)[0]]
    if inside:
        own = added_moments([numbers[c] for c in inside])
        for name in fit.numeric:
            k = design.numeric.index(name)
            count, mean, variance = own[k]
            median = medians[k]
            if not count:
                median, mean, variance = 0.0, 0.0, 0.0
            share = count / total if total else 0.0
            middle = share * mean + (1 - share) * median
            spread = share * (variance + (mean - middle) ** 2) + (1 - share) * (median - middle) ** 2
            scale = spread**0.5 or 1.0
            if name in fit.plain:
                middle, scale = 0.0, 1.0
            column = np.zeros(design.width)
            column[0] = (design.centre[k] - middle) / scale
            column[1 + k] = design.scale[k] / scale
            column[1 + len(design.numeric) + k] = (median - design.centre[k]) / scale
            columns.append(column)
        for name in fit.categorical:
            k = design.categorical.index(name)
            present = set().union(*[found[name].get(c, set()) for c in inside])
            for i, level in enumerate(design.levels[k]):
                if level in present:
                    columns.append(np.eye(design.width)[design.first_level(k) + i])
    spread = np.stack(columns, axis=1)
    used = np.abs(spread).sum(axis=1)
    count = len(design.numeric)
    # The flag of a column without missing values is zero in every row.
    used[[1 + count + k for k in range(count) if k not in blank]] = 0.0
    state = _State(
        spread, np.flatnonzero(used), (1.0, 1.0), 0.0, max(total, 1.0), np.zeros(spread.shape[1])
    )
    if not total or ones in (0.0, total):
        state.done, state.constant = True, float(ones / total) if total else 0.0
        return state
    state.weights = (total / (2.0 * (total - round(ones))), total / (2.0 * round(ones)))
    state.penalty = 1.0 / (fit.strength * total)
    return state


def _evaluate(design: _Design, rows: DataFrame, cells: list[Subset], states: list[_State]) -> list[np.ndarray]:
    """Per fit the sums of loss, gradient and curvature over its training rows, in one scan."""
    groups: dict[bytes, list[int]] = {}
    for j, state in enumerate(states):
        groups.setdefault(state.used.tobytes(), []).append(j)
    known = np.array(sorted(set().union(*cells)), dtype=np.int64)
    # A row's weight in every fit, by its cell and class; a cell that no fit knows has none.
    weights = np.zeros((2 * len(known) + 2, len(states)))
    for j, state in enumerate(states):
        at = np.searchsorted(known, sorted(cells[j]))
        weights[2 * at, j], weights[2 * at + 1, j] = state.weights
    shared = []
    for members in groups.values():
        used = states[members[0]].used
        points = np.stack([states[j].shared()[used] for j in members], axis=1)
        shared.append((members, used, points, np.ascontiguousarray(weights[:, members]), np.triu_indices(len(used))))

    def work(batches):
        totals: list[np.ndarray | None] = [None] * len(shared)
        for batch in batches:
            matrix, target, cell = design.matrix(batch), batch["y"].to_numpy(), batch["cell"].to_numpy()
            place = np.minimum(np.searchsorted(known, cell), len(known) - 1)
            place = np.where(known[place] == cell, place, len(known)) * 2 + (target > 0)
            for first in range(0, len(matrix), BLOCK_ROWS):
                block = slice(first, first + BLOCK_ROWS)
                y = target[block][:, None]
                for g, (_, used, points, weight, (one, other)) in enumerate(shared):
                    r = matrix[block][:, used]
                    eta = r @ points
                    w = weight[place[block]]
                    small = np.exp(-np.abs(eta))
                    p = np.where(eta >= 0, 1.0, small) / (1.0 + small)
                    loss = (w * (np.log1p(small) + np.maximum(eta, 0.0) - y * eta)).sum(axis=0)
                    gradient = r.T @ (w * (p - y))
                    turned = np.ascontiguousarray(r.T)
                    curvature = (turned[one] * turned[other]) @ (w * p * (1.0 - p))
                    part = np.concatenate([loss[None], gradient, curvature])
                    totals[g] = part if totals[g] is None else totals[g] + part
        yield _parts(
            {j: t[:, k] for t, (members, *_) in zip(totals, shared) if t is not None for k, j in enumerate(members)}
        )

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for j, data in zip(batch["fit"].to_pylist(), batch["part"].to_pylist()):
                part = np.frombuffer(data)
                totals[j] = totals[j] + part if j in totals else part
        yield _parts(totals)

    schema = "fit int, part binary"
    parts = design.read(rows).mapInArrow(work, schema)
    added = parts.repartition(min(ADDERS, len(states)), "fit").mapInArrow(add, schema).collect()
    found = {r["fit"]: np.frombuffer(r["part"]) for r in added}
    return [_squared(found[j], len(s.used)) for j, s in enumerate(states)]


def _squared(sums: np.ndarray, d: int) -> np.ndarray:
    """Loss, gradient and the whole curvature from sums that hold its upper triangle."""
    curvature = np.zeros((d, d))
    curvature[np.triu_indices(d)] = sums[1 + d :]
    curvature = curvature + np.triu(curvature, 1).T
    return np.concatenate([sums[: 1 + d], curvature.ravel()])


def _parts(totals: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"fit": pa.array(list(totals), pa.int32()), "part": pa.array([t.tobytes() for t in totals.values()], pa.binary())}
    )


def _advance(state: _State, sums: np.ndarray) -> float:
    """One Newton step, or half the last one if it did not lower the loss; returns the gradient's size."""
    d = len(state.used)
    spread = state.spread[state.used]
    penalised = np.ones(len(state.point))
    penalised[0] = 0.0
    loss = sums[0] / state.rows + 0.5 * state.penalty * float((penalised * state.point**2).sum())
    if state.best is None and state.point.any() and not loss <= np.log(2.0):
        state.point = np.zeros(len(state.point))  # the start is worse than the zero model
        return np.nan
    if state.best is not None and not loss <= state.loss + 1e-15:
        state.step = state.step / 2.0
        state.point = state.best + state.step
        state.done = float(np.abs(state.step).max()) < 1e-12
        return np.nan
    gradient = spread.T @ sums[1 : 1 + d] / state.rows + state.penalty * penalised * state.point
    curvature = spread.T @ sums[1 + d :].reshape(d, d) @ spread / state.rows + state.penalty * np.diag(penalised)
    state.best, state.loss = state.point, loss
    state.step = -np.linalg.lstsq(curvature, gradient, rcond=1e-14)[0]
    state.done = -float(gradient @ state.step) / 2.0 < TOLERANCE
    if not state.done:
        state.point = state.best + state.step
    return float(np.abs(gradient).max())
