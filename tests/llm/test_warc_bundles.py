"""Records, bundles and look-ups against direct computation, and odd rows."""

import base64
import hashlib
import io

import pyarrow.fs
import pytest
import zstandard
from pyspark.sql import functions as F

from adjudica.llm import warc_bundles
from adjudica.llm.queries import ORACLES, QUERIES
from adjudica.session import new_path
from tests.check_oracle import compare, connect

SCHEMA = "page_id long, url string, html string, bundle string, frame string, sha string"
ODD = [
    (3, "http://a/", "same", "b", "f", "s"), (1, "http://b/", "same", "b", "f", "s"), (1, "http://b/", "same", "b", "f", "s"),
    (1, "http://c/", "same", "b", "f", "s"), (4, "http://d/\r\nX: y ü", "other é\r\n\r\nWARC/1.1", "b", "f", "s"),
    (5, None, None, "b", "f", "s"), (6, "", "", "b", "f", "s"), (None, "u", "same", "b", "f", "s"),
    (None, None, "alone", "b", "f", "s"), (None, None, "alone", "b", "f", "s"), (7, "u", "x" * 300_000, "b", "f", "s"),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(rows, least=0):
    """(page_id, url, bytes, digest, type, refers_to) by direct definition."""
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[1] is not None)
    out, first = [], {}
    for page_id, _, html, *_ in sorted(rows, key=order):
        html = html or ""
        size = len(html.encode())
        copy = size >= least and html in first
        first.setdefault(html, page_id)
        out.append((page_id, size, digest(html), "revisit" if copy else "response", first[html] if copy else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 5])
def test_odd_rows(spark, least):
    folder = new_path(spark, "warc")
    index = warc_bundles.write_bundles(spark.createDataFrame(ODD, SCHEMA), folder, least, frame_bytes=1500)
    records = warc_bundles.read_bundles(spark, folder)
    found = records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, found), key=repr) == expected(ODD, least)
    ids = [r[0] for r in index.select("record_id").collect()]
    assert len(set(ids)) == len(ids) == len(ODD)
    for r in records.where("record_type = 'response'").collect():
        assert digest(bytes(r["payload"]).decode()) == r["payload_digest"]
    assert records.where("page_id = 4").first()["url"] == "http://d/%0D%0AX:%20y%20%C3%BC"


def test_a_record_is_cut_from_its_frame(spark, small):
    folder = new_path(spark, "warc")
    index = warc_bundles.write_bundles(spark.read.parquet(f"{small}/pages.parquet"), folder, frame_bytes=8000)
    wanted = index.where("page_id in (0, 7, 33)").select("record_id")
    fetched = {r["page_id"]: bytes(r["payload"]).decode() for r in warc_bundles.fetch_records(wanted, folder).collect()}
    own = spark.read.parquet(f"{small}/pages.parquet").where("page_id in (0, 7, 33)")
    assert fetched == {r["page_id"]: r["html"] for r in own.collect()}


def test_bundles_are_ordinary_zstandard_files_of_bounded_frames(spark, small):
    folder = new_path(spark, "warc")
    pages = spark.read.parquet(f"{small}/pages.parquet").coalesce(1)
    index = warc_bundles.write_bundles(pages, folder, frame_bytes=20_000, bundle_bytes=15_000)
    system, path = pyarrow.fs.FileSystem.from_uri(folder)
    names = {r[0] for r in index.select("bundle").distinct().collect()}
    assert {i.base_name for i in system.get_file_info(pyarrow.fs.FileSelector(f"{path}/bundles"))} == names
    assert len(names) > 1
    for name in names:
        with system.open_input_file(f"{path}/bundles/{name}") as source:
            table = warc_bundles.seek_table(source)
            frames = [warc_bundles.read_frame(source, *entry) for entry in table]
            source.seek(0)
            whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(source.read()), read_across_frames=True).read()
        assert whole == b"".join(frames)
        assert all(len(f) <= 20_000 or len(list(warc_bundles.split_records(f))) == 1 for f in frames)
        at = {(r["frame"], r["at"]): r["record_id"] for r in index.where(F.col("bundle") == name).collect()}
        told = {(k, a): h["WARC-Record-ID"].strip("<>") for k, f in enumerate(frames) for a, h, _ in warc_bundles.split_records(f)}
        assert at == told


def test_files_of_lost_attempts_are_removed(spark, small):
    folder = new_path(spark, "warc")
    system, path = pyarrow.fs.FileSystem.from_uri(folder)
    system.create_dir(f"{path}/bundles", recursive=True)
    with system.open_output_stream(f"{path}/bundles/000000-lost-00000.warc.zst") as lost:
        lost.write(b"half a frame")
    warc_bundles.write_bundles(spark.read.parquet(f"{small}/pages.parquet").limit(3), folder)
    assert not [i for i in system.get_file_info(pyarrow.fs.FileSelector(f"{path}/bundles")) if "lost" in i.base_name]


def test_empty_table(spark):
    folder = new_path(spark, "warc")
    warc_bundles.write_bundles(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc_bundles.read_bundles(spark, folder).count() == 0


def test_query_agrees_with_sql(spark, small):
    found = QUERIES["op12_warc_bundles"](spark, small)
    assert compare(found, connect(small), ORACLES["op12_warc_bundles"]) is None
