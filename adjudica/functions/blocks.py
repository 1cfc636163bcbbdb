"""Arrays of table rows in plain files, for methods that pass over the same rows hundreds of times.

A pass then maps the files into the workers' memory, and neither decodes rows nor sends them from the JVM to Python. The
files lie in the shared folder, which ``pyarrow.fs`` must be able to name; only those that a finished task has listed are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from adjudica.session import new_path

INDEX = "path string, start long, length long, rows int, cell int"
#: Blocks that one task takes at most, where there are many.
TASK_BLOCKS = 128


class Block(NamedTuple):
    """Bytes of some rows of one cell, at ``start`` of a file."""

    path: str
    start: int
    length: int
    rows: int
    cell: int

    def read(self) -> np.ndarray:
        return read_bytes(self.path, self.start, self.length)


def read_bytes(uri: str, start: int, length: int) -> np.ndarray:
    system, path = pyarrow.fs.FileSystem.from_uri(uri)
    if isinstance(system, pyarrow.fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r", start, (length,))
    with system.open_input_file(path) as file:
        return np.frombuffer(file.read_at(length, start), np.uint8)


def write_bytes(uri: str, data: bytes) -> None:
    system, path = pyarrow.fs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path, compression=None) as file:
        file.write(data)


def store_blocks(rows: DataFrame, cut: Callable[[Iterator[pa.RecordBatch]], Iterable[tuple[int, int, bytes]]], label: str) -> list[Block]:
    """What ``cut`` makes of each task's batches, (cell, rows, bytes), written to a file per task; the list of all."""
    folder = new_path(rows.sparkSession, label)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pyarrow.fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        # By partition, so that the order of the blocks is that of the rows.
        name, found, start = f"{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}", [], 0
        with system.open_output_stream(f"{base}/{name}", compression=None) as file:
            for cell, count, data in cut(batches):
                file.write(data)
                found.append((f"{folder}/{name}", start, len(data), count, cell))
                start += len(data)
        if found:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            columns = [pa.array(values, kind) for values, kind in zip(zip(*found), kinds)]
            yield pa.RecordBatch.from_arrays(columns, [piece.split()[0] for piece in INDEX.split(", ")])

    return sorted(Block(*row) for row in rows.mapInArrow(work, INDEX).collect())


def over_blocks(spark: SparkSession, blocks: list, work: Callable[[Iterator], Iterable]) -> list:
    """What ``work`` gives for the blocks of each task: one per core, as a task costs more than to read a block, or a few."""
    context = spark.sparkContext
    cores = context.defaultParallelism
    rounds = max(1, round(len(blocks) / (TASK_BLOCKS * cores)))
    tasks = max(1, min(len(blocks), rounds * cores))
    return context.parallelize(blocks, tasks).mapPartitions(work).collect()
