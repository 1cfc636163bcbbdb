"""Whitening of vectors: distributed centred covariance, eigenvectors on the driver, broadcast projection.

Three passes read the vectors: exact sums, the covariance centred by them, and the covariance of the
whitened vectors as the check. A task hands on one matrix as wide as a vector, and matrices are added
row by row in a shuffle; no number of rows reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adjudica.llm.symmetric_eigen import leading_eigen

#: x = floor(SCALE · entry) + SHIFT.
SCALE, SHIFT = 64.0, 1_000_000
#: Entries whose x stays inside a long.
MOST_ENTRY = 2.0**56
#: Numbers that a task holds of one slice of a batch.
SLICE_NUMBERS = 2_000_000
#: Eigenvalues below this share of the largest one are rounding, not variance.
LEAST_SHARE = 1e-10
#: Tasks that add up the rows of matrices.
ADDERS = 64


@dataclass(frozen=True)
class Whitening:
    """The fit: n vectors with sums S, and for each component its axis, variance and share."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float


def _vectors(frame: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    return frame.select(
        F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector")
    )


def _whole_rows(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, x) of the vectors that hold only finite numbers, those of one width together."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.asarray(column.offsets).astype(np.int64)
    values = column.values
    numbers = values.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = ~np.isfinite(numbers)
    bad[~bad] |= np.abs(numbers[~bad]) >= MOST_ENTRY
    if values.null_count:
        bad |= np.asarray(values.is_null().to_numpy(zero_copy_only=False))
    bad_before = np.concatenate([[0], np.cumsum(bad)])
    starts, ends = offsets[:-1], offsets[1:]
    good = bad_before[ends] == bad_before[starts]
    if column.null_count:
        good &= ~column.is_null().to_numpy(zero_copy_only=False)
    widths = ends - starts
    for width in np.unique(widths[good]):
        at = np.flatnonzero(good & (widths == width))
        step = max(1, SLICE_NUMBERS // max(int(width), 1))
        for first in range(0, len(at), step):
            part = at[first : first + step]
            entries = numbers[starts[part][:, None] + np.arange(width)]
            yield part, np.floor(entries * SCALE).astype(np.int64) + SHIFT


def _totals(vectors: DataFrame) -> tuple[int, tuple[int, ...]]:
    """Number of vectors of the most frequent width (the larger on a tie) and their exact sums."""

    def work(batches):
        found: dict[int, list] = {}
        for batch in batches:
            for _, x in _whole_rows(batch.column("vector")):
                n, sums = found.get(x.shape[1], (0, [0] * x.shape[1]))
                high = (x >> 32).sum(axis=0).tolist()
                low = (x & 0xFFFFFFFF).sum(axis=0).tolist()
                sums = [s + (h << 32) + v for s, h, v in zip(sums, high, low)]
                found[x.shape[1]] = n + len(x), sums
        for width, (n, sums) in found.items():
            yield pa.RecordBatch.from_pydict(
                {
                    "width": pa.array([width] * (width + 1), pa.int64()),
                    "at": pa.array(range(-1, width), pa.int64()),
                    "total": pa.array([Decimal(v) for v in (n, *sums)], pa.decimal128(38, 0)),
                }
            )

    parts = vectors.mapInArrow(work, "width long, at long, total decimal(38,0)")
    totals = parts.groupBy("width", "at").agg(F.sum("total").alias("total"))
    of_width = totals.groupBy("width").agg(F.sort_array(F.collect_list(F.struct("at", "total"))).alias("t"))
    row = of_width.orderBy(F.get("t", F.lit(0))["total"].desc(), F.desc("width")).first()
    if row is None:
        return 0, ()
    return int(row["t"][0]["total"]), tuple(int(entry["total"]) for entry in row["t"][1:])


def _centre(n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Whole and broken part of S/n; x less the whole part is exact."""
    return (
        np.array([s // n for s in sums], dtype=np.int64),
        np.array([(s % n) / n for s in sums], dtype=np.float64),
    )


def _added(vectors: DataFrame, rows: int, width: int, product: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all vectors x of this width of the ``rows`` × … matrix ``product(x)``."""

    def work(batches):
        total = None
        for batch in batches:
            for _, x in _whole_rows(batch.column("vector")):
                if x.shape[1] == width:
                    part = product(x)
                    total = part if total is None else total + part
        if total is not None:
            yield _matrix_rows(range(rows), total)

    def add(batches):
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, part in zip(batch["slot"].to_pylist(), batch["part"].to_pylist()):
                part = np.frombuffer(part)
                kept[slot] = kept[slot] + part if slot in kept else part
        if kept:
            yield _matrix_rows(kept, list(kept.values()))

    schema = "slot int, part binary"
    parts = vectors.mapInArrow(work, schema)
    added = parts.repartition(min(ADDERS, rows), "slot").mapInArrow(add, schema).collect()
    return np.stack([np.frombuffer(r["part"]) for r in sorted(added, key=lambda r: r["slot"])])


def _matrix_rows(slots, rows) -> pa.RecordBatch:
    parts = [np.ascontiguousarray(r, dtype=np.float64).tobytes() for r in rows]
    return pa.RecordBatch.from_pydict(
        {"slot": pa.array(list(slots), pa.int32()), "part": pa.array(parts, pa.binary())}
    )


def fit_whitening(
    frame: DataFrame, components: int = 32, vec_id: str = "vec_id", embedding: str = "embedding"
) -> Whitening | None:
    """Fit on all vectors of ``frame`` that hold only finite numbers; None where there is none.

    A null vector and one with a null, NaN or infinite entry is left out, and so is one with an entry
    beyond 2^56 (its x fits no long) or of another width than most have. Components are unit
    eigenvectors of the covariance of x, by falling variance; those with less than 1e-10 of the largest
    variance are rounding and left out, so a constant table gives no component. Repeated rows count each.
    """
    vectors = _vectors(frame, vec_id, embedding)
    n, sums = _totals(vectors)
    if not n:
        return None
    width = len(sums)
    empty = Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), np.zeros(0), 0.0)
    if not width:
        return empty
    whole, broken = _centre(n, sums)

    def squares(x):
        y = (x - whole).astype(np.float64) - broken
        return y.T @ y

    covariance = _added(vectors, width, width, squares) / n
    covariance = (covariance + covariance.T) / 2.0
    variances, axes = leading_eigen(covariance, min(components, width))
    kept = variances > LEAST_SHARE * max(variances.max(initial=0.0), 0.0)
    variances, axes = variances[kept], axes[:, kept]
    if not len(variances):
        return empty
    scaled = axes / np.sqrt(variances)

    def whitened_squares(x):
        w = ((x - whole).astype(np.float64) - broken) @ scaled
        return np.vstack([w.T @ w, w.sum(axis=0)])

    moments = _added(vectors, len(variances) + 1, width, whitened_squares) / n
    found = moments[:-1] - np.outer(moments[-1], moments[-1])
    error = float(np.abs(found - np.eye(len(variances))).max())
    return Whitening(n, sums, axes, variances, variances / np.trace(covariance), error)


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """Sum over dimensions of (n·x − S)², exactly."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = [s % n for s in sums]
    y = x - whole
    most = (int(np.abs(y).max(initial=0)) + 1) * n
    if most**2 * len(sums) < 2**63:
        return ((y * n - np.array(rest, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    exact = y.astype(object) * n - np.array(rest, dtype=object)
    return (exact**2).sum(axis=1).tolist()


def whiten(
    frame: DataFrame, fit: Whitening | None, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """(vec_id, deviation, whitened) of each vector that a fit would use; other rows give none.

    ``deviation`` is the exact sum of (n·x − S)², null beyond 38 digits; ``whitened`` holds one number per
    component. Null ids stay null, repeated rows come out each, an empty table or no fit gives no row.
    """
    schema = "vec_id long, deviation decimal(38,0), whitened array<double>"
    vectors = _vectors(frame, vec_id, embedding)
    if fit is None:
        return vectors.where(F.lit(False)).select(
            F.col("vec_id").cast("long"), F.lit(None).cast("decimal(38,0)").alias("deviation"), F.col("vector").alias("whitened")
        )
    width, count = len(fit.sums), len(fit.variances)
    whole, broken = _centre(fit.n, fit.sums)
    scaled = fit.axes / np.sqrt(fit.variances)
    n, sums = fit.n, fit.sums

    def work(batches):
        for batch in batches:
            ids = batch.column("vec_id")
            for at, x in _whole_rows(batch.column("vector")):
                if x.shape[1] != width:
                    continue
                w = ((x - whole).astype(np.float64) - broken) @ scaled
                exact = [Decimal(v) if v < 10**38 else None for v in _deviations(x, n, sums)]
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * count)
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": ids.take(pa.array(at)).cast(pa.int64()),
                        "deviation": pa.array(exact, pa.decimal128(38, 0)),
                        "whitened": pa.ListArray.from_arrays(ends, pa.array(w.ravel())),
                    }
                )

    return vectors.mapInArrow(work, schema)
