"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames with several records each; its last frame is a
skippable one that holds the sizes of all others (the seek table). An index maps each record's id to
its bundle, frame, and offset inside the frame, so that one record costs the reading of one frame.

Spark writes the index, and a bundle counts only if the index names it: a task that is lost or run
twice leaves a file of its own name that nothing refers to, which ``write_bundles`` removes at its end.
"""

from __future__ import annotations

import base64
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote_from_bytes

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.session import materialize

# Numbers of the seekable format.
SKIPPABLE_MAGIC, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
FOOTER = struct.Struct("<IBI")
ENTRY = struct.Struct("<II")
#: Bytes of URIs that need no escape.
PLAIN = "!#$%&'()*+,/:;=?@[]-._~"
#: Groups of equal payloads that hold more than one row in so many are joined by broadcast; there are no more.
HOT_GROUPS = 1000
#: Repeats of one row that a task numbers at a time.
BLOCK_ROWS = 100_000
#: Rows of the record index handed to Spark in one batch.
BATCH_ROWS = 2000

INDEX = "record_id string, page_id long, bundle string, frame int, at long, length long"


class BundleWriter:
    """One bundle in the making: records in, frames out, the seek table last."""

    def __init__(self, sink, frame_bytes: int, level: int = 3):
        self.sink, self.frame_bytes = sink, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.parts: list[bytes] = []
        self.filled = self.written = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset in the frame) of the record."""
        if self.filled and self.filled + len(record) > self.frame_bytes:
            self._end_frame()
        place = len(self.frames), self.filled
        self.parts.append(record)
        self.filled += len(record)
        return place

    def _end_frame(self) -> None:
        packed = self.compressor.compress(b"".join(self.parts))
        self.sink.write(packed)
        self.frames.append((len(packed), self.filled))
        self.written += len(packed)
        self.parts, self.filled = [], 0

    def close(self) -> None:
        if self.filled:
            self._end_frame()
        entries = b"".join(ENTRY.pack(*sizes) for sizes in self.frames)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + FOOTER.size))
        self.sink.write(entries + FOOTER.pack(len(self.frames), 0, SEEK_MAGIC))
        self.sink.close()


def seek_table(source) -> list[tuple[int, int, int]]:
    """(offset, packed size, size) of each frame, from the end of an open bundle."""
    end = source.size()
    source.seek(end - FOOTER.size)
    count, flags, magic = FOOTER.unpack(source.read(FOOTER.size))
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    width = ENTRY.size + (4 if flags & 0x80 else 0)
    source.seek(end - FOOTER.size - width * count)
    table = source.read(width * count)
    frames, offset = [], 0
    for k in range(count):
        packed, size = ENTRY.unpack_from(table, width * k)
        frames.append((offset, packed, size))
        offset += packed
    return frames


def read_frame(source, offset: int, packed: int, size: int) -> bytes:
    source.seek(offset)
    return zstandard.ZstdDecompressor().decompress(source.read(packed), max_output_size=size)


def split_records(frame: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record of a frame."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        version, *lines = frame[at:end].decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"no record at offset {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        block = end + 4
        length = int(headers["Content-Length"])
        yield at, headers, frame[block : block + length]
        at = block + length + 4


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _record_id(page_id, digest: str, url: bytes | None, copy: int) -> str:
    name = f"{page_id}|{digest}|{'-' if url is None else url.hex()}|{copy}"
    return uuid.uuid5(uuid.NAMESPACE_URL, name).urn


def record_bytes(row: dict, date: str) -> tuple[str, bytes]:
    """(record id, record) of a planned row."""
    url, digest = row["url"], row["digest"]
    own = _record_id(row["page_id"], digest, url, row["copy"])
    payload = row.get("payload")
    headers = [("WARC-Type", "revisit" if payload is None else "response"), ("WARC-Record-ID", f"<{own}>"), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", quote_from_bytes(url, PLAIN)))
    if row["page_id"] is not None:
        headers.append(("Page-ID", str(row["page_id"])))
    headers.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    if payload is None:
        headers.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        first = _record_id(row["first_id"], digest, row["first_url"], 0)
        headers.append(("WARC-Refers-To", f"<{first}>"))
        if row["first_id"] is not None:
            headers.append(("Refers-To-Page-ID", str(row["first_id"])))
    headers.append(("Content-Type", "application/http;msgtype=response"))
    return own, _record(headers, head + (payload or b""))


def plan_records(pages: DataFrame, least_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """Responses (with payload) and revisits (without) of all rows of ``pages`` (page_id, url, html).

    Of rows with equal payloads of at least ``least_bytes`` the smallest (page_id, url) is the response; null
    ids count as largest. Only one row of each payload moves with its payload, and a payload's copies
    are reduced before the shuffle; revisits move as ids and digests.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("binary").alias("url"), payload.alias("payload")
    ).withColumn("size", F.length("payload").cast("long"))
    order = F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", F.coalesce("url", F.lit(b"")).alias("u"), "url")
    big = own.where(F.col("size") >= least_bytes).withColumn("sha", F.sha1("payload")).withColumn("place", order)
    narrow = big.select("sha", "size", "place")
    response = big.groupBy("sha", "size").agg(F.min("place").alias("place"), F.first("payload").alias("payload")).select(
        F.col("place.page_id").alias("page_id"), F.col("place.url").alias("url"), "size", "sha", F.lit(0).cast("long").alias("copy"), "payload"
    )
    if least_bytes > 0:
        small = own.where(F.col("size") < least_bytes)
        response = response.unionByName(
            small.withColumn("sha", F.sha1("payload")).withColumn("copy", F.monotonically_increasing_id())
        )

    # Rows of one payload and place are one row with a number; only payloads with several rows go on.
    counted = narrow.groupBy("sha", "size", "place").agg(F.count(F.lit(1)).alias("n"))
    counted = materialize(counted, "warc-places")
    groups = counted.groupBy("sha", "size").agg(F.min("place").alias("first"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("places"))
    groups = materialize(groups.where("rows > 1"), "warc-groups")
    many = (groups.agg(F.sum("places")).first()[0] or 0) // HOT_GROUPS
    hot = groups.where(F.col("places") > many).select("sha", "size", "first")  # at most HOT_GROUPS rows
    cold = groups.where(F.col("places") <= many).select("sha", "size", "first")
    with_hot = counted.join(F.broadcast(hot), ["sha", "size"])
    with_cold = counted.join(F.broadcast(hot), ["sha", "size"], "left_anti").join(cold, ["sha", "size"])
    joined = with_hot.unionByName(with_cold)
    left = F.col("n") - F.col("place").eqNullSafe(F.col("first")).cast("long")
    copies = joined.withColumn("left", left).where("left > 0")
    # Repeats of one row are numbered in blocks, which other tasks may take.
    block = F.explode(F.expr(f"sequence(0L, (left - 1) div {BLOCK_ROWS})")).alias("block")
    blocks = copies.select("place", "first", "size", "sha", "left", block).repartition("sha", "place", "block")
    number = F.explode(F.expr(f"sequence(block * {BLOCK_ROWS} + 1, least(left, (block + 1) * {BLOCK_ROWS}))"))
    revisit = blocks.select(
        F.col("place.page_id").alias("page_id"), F.col("place.url").alias("url"), "size", "sha", number.alias("copy"),
        F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"),
    )
    return response, revisit


def write_bundles(
    pages: DataFrame,
    folder: str,
    least_bytes: int = 0,
    frame_bytes: int = 1 << 20,
    bundle_bytes: int = 1 << 28,
    date: str = "2000-01-01T00:00:00Z",
) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) to the new ``folder``; return the index.

    ``folder`` must be one that all executors reach and that ``pyarrow.fs`` can name (a local or mounted
    path, file, hdfs, s3 or gs). Null html counts as empty, a null url has no target header and characters
    that cannot stand in a URI are escaped; rows repeated whole are one response and revisits of it;
    an empty table gives no bundle. A frame is ended before it would pass ``frame_bytes`` and a bundle
    once it passes ``bundle_bytes``; a larger record has a frame of its own. Memory: one frame and the
    seek table of a bundle.
    """
    folder = folder.rstrip("/")
    response, revisit = plan_records(pages, least_bytes)

    def work(batches):
        system, path = pyarrow.fs.FileSystem.from_uri(folder)
        system.create_dir(f"{path}/bundles", recursive=True)
        task = TaskContext.get()
        stem = f"{task.partitionId():06d}-{uuid.uuid4().hex}"
        writer, number = None, 0
        rows: list[tuple] = []
        for batch in batches:
            for record in _rows_of(batch):
                if writer is None:
                    name = f"{stem}-{number:05d}.warc.zst"
                    writer, number = BundleWriter(system.open_output_stream(f"{path}/bundles/{name}", compression=None), frame_bytes), number + 1
                record_id, data = record_bytes(record, date)
                frame, at = writer.add(data)
                rows.append((record_id, record["page_id"], name, frame, at, len(data)))
                if writer.written >= bundle_bytes:
                    writer.close()
                    writer = None
                if len(rows) >= BATCH_ROWS:
                    yield _index_batch(rows)
                    rows = []
        if writer is not None:
            writer.close()
        if rows:
            yield _index_batch(rows)

    for kind, planned in (("responses", response), ("revisits", revisit)):
        planned.mapInArrow(work, INDEX).write.parquet(f"{folder}/index/kind={kind}")
    index = read_index(pages.sparkSession, folder)
    _remove_unnamed(index, folder)
    return index


def _rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    for first in range(0, batch.num_rows, 64):
        for row in batch.slice(first, 64).to_pylist():
            row["digest"] = base64.b32encode(bytes.fromhex(row["sha"])).decode()
            yield row


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
    names = [piece.split()[0] for piece in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _remove_unnamed(index: DataFrame, folder: str) -> None:
    """Delete bundles of attempts that were not committed; there are about as many bundles as tasks."""
    system, path = pyarrow.fs.FileSystem.from_uri(folder)
    found = system.get_file_info(pyarrow.fs.FileSelector(f"{path}/bundles", allow_not_found=True))
    named = {r["bundle"] for r in index.select("bundle").distinct().collect()}
    for info in found:
        if info.base_name not in named:
            system.delete_file(info.path)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """(record_id, page_id, bundle, frame, at, length) of every record in ``folder``."""
    paths = [f"{folder}/index/kind={kind}" for kind in ("responses", "revisits")]
    return spark.read.schema(INDEX).parquet(*paths)


def _frames(index: DataFrame, folder: str) -> DataFrame:
    """(bundle, frame, offset, packed, size) of every frame, from the seek tables of the bundles."""

    def work(batches):
        system, path = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for bundle in batch["bundle"].to_pylist():
                with system.open_input_file(f"{path}/bundles/{bundle}") as source:
                    table = seek_table(source)
                offsets, packed, sizes = (pa.array(c, pa.int64()) for c in (zip(*table) if table else ((), (), ())))
                names, numbers = pa.array([bundle] * len(table)), pa.array(range(len(table)), pa.int32())
                yield pa.RecordBatch.from_arrays([names, numbers, offsets, packed, sizes], ["bundle", "frame", "offset", "packed", "size"])

    return index.select("bundle").distinct().mapInArrow(work, "bundle string, frame int, offset long, packed long, size long")


RECORDS = "page_id long, url string, record_id string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def _parsed(headers: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: int(headers[name]) if name in headers else None
    told = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    response = headers["WARC-Type"] == "response"
    return (
        number("Page-ID"), headers.get("WARC-Target-URI"), headers["WARC-Record-ID"].strip("<>"), headers["WARC-Type"],
        headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(told["Content-Length"]), number("Refers-To-Page-ID"), payload if response else None,
    )


def _records_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    names = [piece.split()[0] for piece in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the bundles that the index names, read frame by frame; revisits have no payload."""
    folder = folder.rstrip("/")

    def work(batches):
        system, path = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("bundle", "offset", "packed", "size")]
            for bundle, offset, packed, size in zip(*columns):
                with system.open_input_file(f"{path}/bundles/{bundle}") as source:
                    frame = read_frame(source, offset, packed, size)
                rows = [_parsed(headers, block) for _, headers, block in split_records(frame)]
                yield _records_batch(rows)

    frames = materialize(_frames(read_index(spark, folder), folder), "warc-frames")
    spread = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return frames.repartition(spread, "bundle", "frame").mapInArrow(work, RECORDS)


def fetch_records(wanted: DataFrame, folder: str) -> DataFrame:
    """The records whose ``record_id`` is in ``wanted``: a frame is read for each and cut at its offset."""
    spark, folder = wanted.sparkSession, folder.rstrip("/")
    index = read_index(spark, folder).join(wanted.select("record_id").distinct(), "record_id")
    places = index.join(_frames(index, folder), ["bundle", "frame"]).select("bundle", "offset", "packed", "size", "at", "length")

    def work(batches):
        system, path = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{path}/bundles/{row['bundle']}") as source:
                    frame = read_frame(source, row["offset"], row["packed"], row["size"])
                record = frame[row["at"] : row["at"] + row["length"]]
                yield _records_batch([_parsed(headers, block) for _, headers, block in split_records(record)])

    return places.mapInArrow(work, RECORDS)
