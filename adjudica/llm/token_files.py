"""Token ids in files: frequency-ranked, byte-aligned, control bytes apart from data bytes.

A folder holds ``ranks`` (rank, id; most frequent id first) and ``documents`` (doc_id, tie, n_tokens,
control, data), both Parquet, so that Spark's commit keeps or drops a task's file whole. A value
takes 1 to 4 data bytes, little-endian; its length minus one is two bits of a control byte, four
values to a byte, the first in the lowest bits. File names and rows inside a file follow doc_id.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adjudica.llm.bpe import encode_column, largest_id
from adjudica.llm.columns import id_and_text, map_batches
from adjudica.session import materialize, new_path

#: What a file holds, and the size of its row groups.
STORED = "doc_id long, tie long, n_tokens long, control binary, data binary"
ROW_GROUP_BYTES = 1 << 24
#: For each control byte the lengths of its four values.
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)
#: For each length the bits of a 32-bit word that belong to the value.
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def pack_values(values: np.ndarray, counts: np.ndarray) -> list[tuple[bytes, bytes]]:
    """(control bytes, data bytes) of each run of ``counts`` unsigned 32-bit values."""
    values = values.astype("<u4", copy=False)
    lengths = np.ones(len(values), dtype=np.uint8)
    most = int(values.max(initial=0))
    for bound in (0xFF, 0xFFFF, 0xFFFFFF):
        if most > bound:
            lengths += values > bound
    padded = -(-counts // 4) * 4
    ends, places = np.cumsum(counts), np.cumsum(padded)
    shift = np.repeat(places - padded - (ends - counts), counts)
    codes = np.zeros(int(places[-1]) if len(places) else 0, dtype=np.uint8)
    codes[np.arange(len(values)) + shift] = lengths - 1
    codes = codes.reshape(-1, 4)
    control = (codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6).tobytes()
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]].tobytes()
    bytes_before = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    data_at = bytes_before[np.concatenate([[0], ends])].tolist()
    control_at = [0, *(places // 4).tolist()]
    return [
        (control[control_at[k] : control_at[k + 1]], data[data_at[k] : data_at[k + 1]])
        for k in range(len(counts))
    ]


def unpack_values(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ``count`` values of one pair of control and data bytes, by table lookup."""
    lengths = LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:count]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    padded = np.zeros(len(data) + 3, dtype=np.uint32)
    padded[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    words = padded[starts]
    for k in range(1, int(lengths.max(initial=1))):
        words |= padded[starts + k] << np.uint32(8 * k)
    return words & MASKS[lengths]


def _added(counts: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The sum of two arrays of counts per id, of which either may be longer."""
    short, long = sorted((counts, more), key=len)
    long[: len(short)] += short
    return long


def _ranked_counts(counted: DataFrame) -> list[tuple[int, int]]:
    """(id, n) of all ids that occur, most frequent first, ties by id: at most the vocabulary.

    ``counted`` (counts) holds one row per encoding task, ids and their counts as pairs of longs.
    """

    def work(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for counts in batch["counts"]:
                pairs = np.frombuffer(counts, dtype="<i8").reshape(-1, 2)
                if len(pairs):
                    more = np.zeros(int(pairs[-1, 0]) + 1, dtype=np.int64)
                    more[pairs[:, 0]] = pairs[:, 1]
                    total = _added(total, more)
        used = np.flatnonzero(total)
        yield {"id": used.tolist(), "n": total[used].tolist()}

    summed = map_batches(counted, work, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return sorted(((r["id"], r["n"]) for r in summed.collect()), key=lambda r: (-r[1], r[0]))


def _write(frame: DataFrame, path: str, **options) -> None:
    """Parquet in row groups small enough that several writers fit into one executor."""
    frame.write.options(**{"parquet.block.size": str(ROW_GROUP_BYTES)}, **options).parquet(path)


def write_token_files(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, file_tokens: int = 16_000_000
) -> None:
    """Encode every row of ``docs`` (doc_id, text) and write the files to the new ``folder``.

    Each document is the ids of its whole text by the tokenizers library, then ``end_id``; null text
    counts as empty. ``file_tokens`` is the wanted size of a file and changes nothing else. Rows with
    one doc_id follow each other by the checksum of their ids; null ids come first. An empty table
    gives an empty folder of both tables.

    Texts are encoded once, into a table in the shared folder: ids of two bytes where the vocabulary
    allows, and in a task's last row how often it met each id. Ranks and the number of files come from
    those rows; the ids then move once, into the files' ranges, and are written with their ranks.
    """
    spark = docs.sparkSession

    def encode(batches):
        end = end_id.to_bytes(4, "little")
        width = 2 if max(largest_id(vocabulary), end_id) < 1 << 16 else 4
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            texts = [ids + end for ids in encode_column(batch["text"], vocabulary)]
            ids = np.frombuffer(b"".join(texts), dtype="<u4")
            total = _added(total, np.bincount(ids))
            small, at = ids.astype(f"<u{width}").tobytes(), 0
            stored = []
            for text in texts:
                size = len(text) // 4 * width
                stored.append(small[at : at + size])
                at += size
            yield {
                "doc_id": batch["doc_id"],
                "tie": [zlib.crc32(text) for text in texts],
                "width": [width] * len(texts),
                "ids": stored,
                "counts": [None] * len(texts),
            }
        used = np.flatnonzero(total)
        pairs = np.stack([used, total[used]], axis=1).astype("<i8").tobytes()
        yield {name: [None] for name in ("doc_id", "tie", "width", "ids")} | {"counts": [pairs]}

    schema = "doc_id long, tie long, width int, ids binary, counts binary"
    path = new_path(spark, "token-ids")
    _write(map_batches(id_and_text(docs), encode, schema), path, compression="zstd")
    encoded = spark.read.schema(schema).parquet(path)
    by_rank = _ranked_counts(encoded.where("counts is not null").select("counts"))
    spark.createDataFrame(
        [(rank, k) for rank, (k, _) in enumerate(by_rank)], "rank int, id int"
    ).coalesce(1).write.parquet(f"{folder}/ranks")
    rank_of = np.zeros(max((k for k, _ in by_rank), default=0) + 1, dtype=np.uint32)
    rank_of[[k for k, _ in by_rank]] = np.arange(len(by_rank))
    files = max(1, math.ceil(sum(n for _, n in by_rank) / file_tokens))

    def compress(batches):
        for batch in batches:
            # One width for all rows: it follows from the vocabulary.
            width = batch["width"][0]
            counts = np.array([len(ids) // width for ids in batch["ids"]], dtype=np.int64)
            ids = np.frombuffer(b"".join(batch["ids"]), dtype=f"<u{width}")
            packed = pack_values(rank_of[ids], counts)
            yield {
                "doc_id": batch["doc_id"],
                "tie": batch["tie"],
                "n_tokens": counts.tolist(),
                "control": [control for control, _ in packed],
                "data": [data for _, data in packed],
            }

    rows = encoded.where("ids is not null").drop("counts")
    ordered = rows.repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    # Mapping keeps the order of the rows.
    _write(map_batches(ordered, compress, STORED), f"{folder}/documents", compression="uncompressed")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, ids, file, tie) of every document in ``folder``; ids are little-endian 32-bit."""
    ranks = spark.read.schema("rank int, id int").parquet(f"{folder}/ranks").collect()
    id_of = np.array([r["id"] for r in sorted(ranks, key=lambda r: r["rank"])] or [0], dtype="<u4")

    def expand(batches):
        for batch in batches:
            yield {
                "doc_id": batch["doc_id"],
                "ids": [
                    id_of[unpack_values(control, data, count)].tobytes()
                    for control, data, count in zip(
                        batch["control"], batch["data"], batch["n_tokens"]
                    )
                ],
                "file": batch["file"],
                "tie": batch["tie"],
            }

    stored = spark.read.schema(STORED).parquet(f"{folder}/documents")
    stored = stored.withColumn("file", F.col("_metadata.file_name"))
    return map_batches(stored, expand, "doc_id long, ids binary, file string, tie long")


def document_offsets(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of documents read back, in the order of the files.

    Only narrow rows are kept, in a table of the shared folder, so that ids are decoded once. Totals
    per file are summed up over files, in the order of their first documents, then rows inside a file.
    """
    narrow = materialize(
        tokens.select(
            "doc_id", "tie", "file",
            (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"),
        ),
        "token-counts",
    )
    totals = narrow.groupBy("file").agg(
        F.sum("n_tokens").alias("total"), F.min(F.struct("doc_id", "tie")).alias("first")
    )
    earlier = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        F.col("file").alias("of_file"), F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base")
    )
    inside = Window.partitionBy("file").orderBy("doc_id", "tie")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = narrow.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(bases, placed["file"] == bases["of_file"]).select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )
