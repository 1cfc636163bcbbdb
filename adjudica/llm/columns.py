"""What several operators of this folder share: reading a text column and running Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that end at white space of ASCII, and at every ASCII character but digits and letters.
SPACES = r"[\x20\x09-\x0D]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows, and bytes of text or binary values, that a task turns into Python values at a time (one row
#: at least); they bound memory and change no result.
SLICE_ROWS, SLICE_BYTES = 500, 2_000_000
#: bytes.translate() with this lower-cases A-Z and turns each byte outside a word into a space.
ALNUM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def id_and_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so that no other column can clash with its own."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))


def words(text: Column, separators: str) -> Column:
    """The non-empty pieces of ``text`` between separators; null has none."""
    pieces = F.split(F.coalesce(text, F.lit("")), separators, -1)
    return F.filter(pieces, lambda piece: piece != "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and every other character as it is."""
    return F.translate(text, _UPPER, _LOWER)


def row_key(doc_id: Column, text: Column) -> Column:
    """One value for equal (id, text); null ids count as equal, repeated rows share it."""
    return F.md5(
        F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    )


def _cuts(batch: pa.RecordBatch) -> list[int]:
    """Where to cut a batch into slices, ends included."""
    sizes = np.zeros(batch.num_rows, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    cuts = [0]
    while cuts[-1] < batch.num_rows:
        first = cuts[-1]
        before = ends[first - 1] if first else 0
        last = int(np.searchsorted(ends, before + SLICE_BYTES, side="right"))
        cuts.append(min(batch.num_rows, first + SLICE_ROWS, max(last, first + 1)))
    return cuts


def map_batches(
    frame: DataFrame,
    work: Callable[[Iterable[dict[str, list]]], Iterator[dict[str, list]]],
    schema: str,
) -> DataFrame:
    """Run ``work`` once per task over slices of its batches, as dicts of Python lists in and out."""
    fields = [piece.split() for piece in schema.split(",")]
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
        "boolean": pa.bool_(), "double": pa.float64(), "array<bigint>": pa.list_(pa.int64()),
    }
    layout = pa.schema([(name, kinds[kind]) for name, kind in fields])

    def slices(batches):
        for batch in batches:
            cuts = _cuts(batch)
            for first, last in zip(cuts, cuts[1:]):
                yield batch.slice(first, last - first).to_pydict()

    def run(batches):
        for rows in work(slices(batches)):
            yield pa.RecordBatch.from_pydict(rows, layout)

    return frame.mapInArrow(run, schema)
