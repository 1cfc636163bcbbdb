"""A narrow network trained to repeat its own input; its middle layer is the embedding."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adjudica.session import materialize
from adjudica.spec import KNOBS

#: Training ends when the loss has not fallen by this much below its best for so many steps.
FALL, PATIENCE = 1e-4, 10
#: Bytes of stored blocks that one task reads at least, and rows that the network takes at a time.
ROW_GROUP, PART_ROWS = 8 << 20, 2048


def _shapes(width: int, hidden: int, bottleneck: int) -> list[tuple[int, int]]:
    return [(width, hidden), (hidden, bottleneck), (bottleneck, hidden), (hidden, width)]


def _unpack(flat: np.ndarray, shapes) -> list[tuple[np.ndarray, np.ndarray]]:
    layers, at = [], 0
    for rows, columns in shapes:
        weights = flat[at : at + rows * columns].reshape(rows, columns)
        at += rows * columns
        layers.append((weights, flat[at : at + columns]))
        at += columns
    return layers


def _loss_and_gradient(flat: np.ndarray, shapes, x: np.ndarray) -> tuple[float, np.ndarray]:
    """Sums over the rows of the squared error per column, and its gradient.

    ``x`` has a row per input and a column per table row: few long rows are fast, many short ones are not.
    """
    layers = _unpack(flat, shapes)
    outputs = [x]
    for i, (weights, bias) in enumerate(layers):
        z = weights.T @ outputs[-1]
        z += bias[:, None]
        outputs.append(z if i == len(layers) - 1 else np.maximum(z, 0.0, out=z))
    error = outputs[-1] - x
    loss = float(np.vdot(error, error)) / len(x)
    gradient, slope = [], error * (2.0 / len(x))
    for i in range(len(layers) - 1, -1, -1):
        gradient = [(outputs[i] @ slope.T).ravel(), slope.sum(axis=1), *gradient]
        if i:
            slope = (layers[i][0] @ slope) * (outputs[i] > 0)
    return loss, np.concatenate(gradient)


def _packed(inputs: DataFrame) -> DataFrame:
    """The rows of all batches as blocks of doubles, stored once; a step then reads bytes, not rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                yield pa.RecordBatch.from_pydict({"block": pa.array([x.tobytes()], pa.binary())})

    # Small row groups, so that a small table is read by many tasks; doubles do not compress.
    options = {"compression": "none", "parquet.block.size": ROW_GROUP}
    return materialize(inputs.mapInArrow(pack, "block binary"), "network-inputs", **options)


def _summed(blocks: DataFrame, flat: np.ndarray, shapes) -> np.ndarray:
    """Loss, row count and gradient summed over all rows.

    A task returns one number per weight for some hundred megabytes of blocks, so what reaches the driver is
    as large as the network times the tasks.
    """
    width = shapes[0][0]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(flat.size + 2)
        for batch in batches:
            for block in batch["block"]:
                x = np.frombuffer(block.as_buffer()).reshape(width, -1)
                for first in range(0, x.shape[1], PART_ROWS):
                    part = x[:, first : first + PART_ROWS]
                    loss, gradient = _loss_and_gradient(flat, shapes, part)
                    total += np.concatenate([[loss, part.shape[1]], gradient])
        yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary())})

    parts = blocks.mapInArrow(partial, "part binary").collect()
    return np.sum([np.frombuffer(r["part"]) for r in parts], axis=0)


class Descent:
    """Steps of one network from its random start, fed with sums over all of its rows."""

    def __init__(self, shapes: Sequence[tuple[int, int]], steps: int, rate: float, seed: int) -> None:
        random = np.random.default_rng(seed)
        self.point = np.concatenate(
            [
                np.concatenate(
                    [random.normal(0.0, np.sqrt(2.0 / rows), rows * columns), np.zeros(columns)]
                )
                for rows, columns in shapes
            ]
        )
        self.steps, self.rate = steps, rate
        self.first, self.second = np.zeros_like(self.point), np.zeros_like(self.point)
        self.best, self.idle, self.steps_taken = np.inf, 0, 0
        self.done = steps < 1

    def advance(self, sums: np.ndarray) -> None:
        """The next step, from loss, row count and gradient at ``point``."""
        loss = sums[0] / sums[1]
        self.idle = self.idle + 1 if loss > self.best - FALL else 0
        self.best = min(self.best, loss)
        if self.idle >= PATIENCE:
            self.done = True
            return
        self.steps_taken = step = self.steps_taken + 1
        gradient = sums[2:] / sums[1]
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient**2
        corrected = self.first / (1 - 0.9**step)
        self.point = self.point - self.rate * corrected / (np.sqrt(self.second / (1 - 0.999**step)) + 1e-8)
        self.done = step >= self.steps


class Autoencoder(Estimator):
    """Full-batch gradient descent with momentum and scaling of the steps (Adam).

    At most ``steps`` steps; it ends earlier when the loss no longer falls. ``steps_taken`` has their number.
    Fitting gives a ``SQLTransformer``: the embedding is plain arithmetic over the inputs.
    """

    def __init__(
        self,
        inputs: Sequence[str],
        bottleneck: int = KNOBS.bottleneck,
        hidden: int = 8,
        steps: int = KNOBS.network_steps,
        rate: float = 0.03,
        seed: int = KNOBS.seed,
    ) -> None:
        super().__init__()
        self.inputs, self.bottleneck, self.hidden = list(inputs), bottleneck, hidden
        self.steps, self.rate, self.seed = steps, rate, seed
        self.reconstruction_error: float | None = None
        self.steps_taken = 0

    @property
    def names(self) -> list[str]:
        return [f"autoencoder_{i}" for i in range(self.bottleneck)]

    def train(self, dataset: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
        # Every step reads the inputs, so they are stored once.
        frame = _packed(dataset.select(*[F.col(c).cast("double").alias(c) for c in self.inputs]))
        shapes = _shapes(len(self.inputs), self.hidden, self.bottleneck)
        run = Descent(shapes, self.steps, self.rate, self.seed)
        while not run.done:
            run.advance(_summed(frame, run.point, shapes))
        self.steps_taken = run.steps_taken
        last = _summed(frame, run.point, shapes)
        self.reconstruction_error = float(last[0] / last[1])
        return _unpack(run.point, shapes)

    def _fit(self, dataset: DataFrame) -> SQLTransformer:
        from adjudica.operators.preprocess import number, quoted

        (w1, b1), (w2, b2) = self.train(dataset)[:2]

        def layer(inputs: list[str], weights, bias, names: list[str]) -> str:
            units = []
            for j, name in enumerate(names):
                terms = [f"{quoted(c)} * {number(weights[i, j])}" for i, c in enumerate(inputs)]
                units.append(f"greatest({number(bias[j])} + {' + '.join(terms)}, 0D) AS {quoted(name)}")
            return ", ".join(units)

        hidden = [f"autoencoder_hidden_{i}" for i in range(self.hidden)]
        inner = layer(self.inputs, w1, b1, hidden)
        outer = layer(hidden, w2, b2, self.names)
        return SQLTransformer(
            statement=f"SELECT *, {outer} FROM (SELECT *, {inner} FROM __THIS__)"
        )
