"""Shuffled columns of a logistic regression, scored without a copy of any row.

A score is a sum of one part per source column, so a row with another row's value of a column needs only
that row's part. Rows lie in one random order; in repeat r a row takes the values of the row r + 1 places
further, the last ones those of the first, as ``rankings.shuffled_copies`` deals them. A bucket of the order is
one row of numbers, and the rows that its last ones need are the heads of the buckets behind it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adjudica.operators.batched_logistic import (
    CUT_ROWS,
    RANKED_SCORES,
    cuts_of,
    pack,
    ranked_scores,
    whole_numbers,
)
from adjudica.operators.preprocess import encoded_names
from adjudica.session import materialize

#: Rows of a bucket on average at most, and rows whose scores are held at a time.
BUCKET_ROWS, BLOCK_ROWS = 50_000, 8192


def permuted_ranks(
    model: PipelineModel, frame: DataFrame, key: str, target: str, columns: Sequence[str], repeats: int, seed: int, buckets: int
) -> DataFrame:
    """(feature, repeat, rows, average_precision, roc_auc) of a fitted regression for every shuffled column.

    Feature null is the table as it is. Rows without a target are taken from, but not scored.
    """
    columns = list(columns)
    order = F.xxhash64(F.col(key), F.lit(seed))
    buckets = max(buckets, math.ceil(frame.count() / BUCKET_ROWS))
    wanted = model.transform(frame).select(
        F.pmod(order, F.lit(buckets)).alias("bucket"),
        order.alias("u"),
        F.col(key).alias("key"),
        F.col(target).cast("double").alias("y"),
        vector_to_array("features").alias("x"),
    )
    # The weight of each slot, in the column of its source.
    weights = np.zeros((model.stages[-1].coefficients.size, len(columns)))
    for i, ((_, source), weight) in enumerate(zip(encoded_names(model), model.stages[-1].coefficients.toArray())):
        weights[i, columns.index(source)] = weight
    constant = float(model.stages[-1].intercept)

    def parts(batches):
        for rows in batches:
            if rows.num_rows:
                x = rows["x"].flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
                values = pa.array([row.tobytes() for row in x @ weights], pa.binary())
                kept = [rows[c] for c in ("bucket", "u", "key", "y")]
                yield pa.RecordBatch.from_arrays([*kept, values], ["bucket", "u", "key", "y", "parts"])

    kind = dict(frame.dtypes)[key]
    summed = wanted.mapInArrow(parts, f"bucket long, u long, key {kind}, y double, parts binary")

    def in_order(bucket, table):
        table = table.sort_by([("u", "ascending"), ("key", "ascending")])
        each = table["parts"].to_pylist()
        return pa.table(
            {
                "bucket": pa.array([bucket[0].as_py()], pa.int64()),
                "y": pa.array([table["y"].to_numpy().astype(float).tobytes()], pa.binary()),
                "parts": pa.array([b"".join(each)], pa.large_binary()).cast(pa.binary()),
                "head": pa.array([b"".join(each[:repeats])], pa.binary()),
            }
        )

    ordered = summed.groupBy("bucket").applyInArrow(in_order, "bucket long, y binary, parts binary, head binary")
    stored = materialize(ordered, "order")
    width = len(columns)
    heads = {r["bucket"]: np.frombuffer(r["head"]).reshape(-1, width) for r in stored.select("bucket", "head").collect()}
    behind = _behind(heads, repeats)

    def packed(rows):
        for bucket, y, data in zip(*(rows[c].to_pylist() for c in ("bucket", "y", "parts"))):
            own = np.frombuffer(data).reshape(-1, width)
            target, whole = np.frombuffer(y), np.concatenate([own, behind[bucket]])
            for first in range(0, len(own), BLOCK_ROWS):
                at = first + np.flatnonzero(~np.isnan(target[first : first + BLOCK_ROWS]))
                if not len(at):
                    continue
                mine = own[at]
                below = np.concatenate([np.full((len(at), 1), constant), constant + np.cumsum(mine, axis=1)], axis=1)
                above = np.concatenate([np.cumsum(mine[:, ::-1], axis=1)[:, ::-1], np.zeros((len(at), 1))], axis=1)
                yield 0, _numbers(below[:, -1], target[at])
                for c in range(width):
                    for r in range(repeats):
                        eta = below[:, c] + whole[at + r + 1, c] + above[:, c + 1]
                        yield 1 + c * repeats + r, _numbers(eta, target[at])

    labelled = [(None, 0), *((c, r) for c in columns for r in range(repeats))]
    cuts = [np.zeros(0, np.int64)] * len(labelled)
    size = stored.agg(F.sum(F.length("y") / 8)).first()[0] or 0
    if size > RANKED_SCORES:
        # A bucket is a random part of the table; its first rows serve, as equal keys may fill one.
        few = stored.withColumns({c: F.substring(c, 1, w * 8 * CUT_ROWS) for c, w in (("y", 1), ("parts", width))})
        few = few.orderBy(F.length("y").desc(), "bucket").limit(1)
        for table in few.select("bucket", "y", "parts").toArrow().to_batches():
            share = len(table["y"][0].as_py()) / 8 / size
            cuts = cuts_of(packed(table), len(labelled), share)
    return ranked_scores(pack(stored.select("bucket", "y", "parts"), packed, cuts), labelled, "feature string, repeat int")


def _numbers(eta: np.ndarray, y: np.ndarray) -> np.ndarray:
    return whole_numbers(1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700))), y)


def _behind(heads: dict[int, np.ndarray], repeats: int) -> dict[int, np.ndarray]:
    """The ``repeats`` rows that follow each bucket, around the end of the order."""
    places = sorted(heads)
    found = {}
    for i, bucket in enumerate(places):
        rows: list[np.ndarray] = []
        k = i + 1
        while sum(map(len, rows)) < repeats:
            rows.append(heads[places[k % len(places)]])
            k += 1
        found[bucket] = np.concatenate(rows)[:repeats]
    return found
