"""WARC archives compressed with a shared dictionary.

A writer task fills archives of bounded size. For each it builds a Zstandard dictionary from records of that
archive, puts it in a leading skippable frame and compresses each record on its own, so that one record can be read without
the others. Archives go to the folder which driver and executors share, under a temporary name first; a manifest of
the finished ones is cut to that folder as well, so a retried or speculative task leaves no doubt about which count.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cluster import cut, join_groups, shared_dir

#: Fixed values of the format: the skippable frame that holds the dictionary, and a dictionary's own magic number.
SKIPPABLE, DICTIONARY = 0x184D2A5D, 0xEC30A437
DATE = "1970-01-01T00:00:00Z"
VERSION = b"WARC/1.1"


def record(kind: str, key: str, payload: bytes, headers: dict[str, str]) -> bytes:
    """One WARC record; the same input gives the same bytes."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, key)
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{name}>", "WARC-Date": DATE, **headers, "Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(payload))}
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields.items())
    return VERSION + b"\r\n" + head + b"\r\n" + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if first != VERSION or not gap:
        raise ValueError("not a WARC record")
    headers = dict(x.decode().split(": ", 1) for x in lines)
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, rest[:size]


def train(samples: list[bytes], size: int = 1 << 16) -> zstandard.ZstdCompressionDict:
    """A dictionary from records; where they are too few or too short to train on, their own bytes."""
    try:
        return zstandard.train_dictionary(size, samples, k=1024, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict((b"".join(samples)[-size:] or VERSION).ljust(8, b"\n"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], level: int = 3, samples: int = 256) -> bytes:
    """The dictionary in a skippable frame, then a frame for each record."""
    step = max(1, len(records) // samples)
    book = train([r[: 1 << 16] for r in records[::step]])
    body = book.as_bytes()
    press = zstandard.ZstdCompressor(level=level, dict_data=book, write_content_size=True)
    return struct.pack("<II", SKIPPABLE, len(body)) + body + b"".join(press.compress(r) for r in records)


def unpack(data: bytes) -> Iterator[bytes]:
    """The records of an archive."""
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("the archive does not start with a dictionary frame")
    body = data[8 : 8 + size]
    trained = body[:4] == struct.pack("<I", DICTIONARY)
    book = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    press, at, view = zstandard.ZstdDecompressor(dict_data=book), 8 + size, memoryview(data)
    while at < len(data):
        one, parts = press.decompressobj(), []
        while not one.eof:
            if at >= len(data):
                raise ValueError("the archive ends inside a record")
            some = view[at : at + 4096]  # what is left over of it is copied
            parts.append(one.decompress(some))
            at += len(some)
        at -= len(one.unused_data)
        yield b"".join(parts)


def _place(where: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(where) if urlsplit(where).scheme else (fs.LocalFileSystem(), os.path.abspath(where))


def _write(where: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _place(where)
        store.create_dir(path, recursive=True)
        held, size = [], 0

        def close() -> pa.RecordBatch:
            nonlocal size
            name = f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{path}/{name}.part", compression=None) as out:
                out.write(archive(held))
            store.move(f"{path}/{name}.part", f"{path}/{name}")
            row = pa.record_batch([[f"{where}/{name}"], pa.array([len(held)], pa.int64())], ["path", "records"])
            held.clear()
            size = 0
            return row

        for batch in batches:
            for page, url, html, digest, kind, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                headers = {"WARC-Target-URI": quote(url or "", safe=":/?&=#%+,;@~!$'()*[]"), "WARC-Payload-Digest": f"sha256:{digest}", "X-Page-Id": "" if page is None else str(page), "X-Payload-Length": str(len(payload))}
                if kind == "revisit":
                    headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers}')}>", "X-Refers-To-Page": str(refers)}
                    payload = b""
                held.append(record(kind, f"page:{page}", payload, headers))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
        if held:
            yield close()

    return run


def write_archives(pages: DataFrame, where: str, id: str = "page_id", url: str = "url", html: str = "html", least: int = 100, archive_bytes: int = 1 << 25) -> DataFrame:
    """Write a record for each row of pages to `where`; the manifest (path, records) of the archives written.

    Of rows with equal payloads of at least `least` bytes, those with the smallest id are responses and the others
    revisits of that id, without payload; shorter ones are responses. A null html is an empty payload, a null url an empty
    address; a null id counts as the largest. Rows that repeat an id are written each; of equal payloads all rows with the smallest id are
    responses. A very long payload is a record like any other. An empty table gives no archives. Columns other than these, whatever their
    names, are not read.
    """
    base = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    base = base.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    keys = cut(base.select("page_id", "digest", size.alias("size")))
    again = keys.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # short rows are never in `again`; repeated digests join by id of their first row
    marked = join_groups(keys.where(F.col("size") >= least), again, "digest", "n").where("not (page_id <=> first)")
    marked = marked.select("page_id", F.col("digest").alias("seen"), "first").distinct()
    same = base["page_id"].eqNullSafe(marked["page_id"]) & (base["digest"] == marked["seen"])
    rows = base.join(marked, same, "left").select(base["page_id"], "url", "html", "digest", F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("kind"), "first")
    return cut(rows.mapInArrow(_write(where, archive_bytes), "path string, records long"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    number = lambda x: int(x) if x else None
    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, place = _place(path)
            with store.open_input_stream(place, compression=None) as f:
                data = f.read()
            rows: list[tuple] = []
            held = 0
            for raw in unpack(data):
                h, payload = parse(raw)
                digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                if h["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(h["X-Payload-Length"])):
                    raise ValueError(f"{path}: the payload of page {h['X-Page-Id']} is damaged")
                rows.append((number(h["X-Page-Id"]), h["WARC-Target-URI"], h["WARC-Type"], number(h.get("X-Refers-To-Page")), int(h["X-Payload-Length"]), digest, payload))
                held += len(payload)
                if held > 1 << 23:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of all archives in a manifest's column `path`; payloads of responses are held against their digests.

    page_id, url, record_type, refers_to, payload_bytes, payload_digest (both of the full payload), payload (empty for a
    revisit). An archive's paths are dealt out before reading, a path a task at the least.
    """
    n = manifest.sparkSession.sparkContext.defaultParallelism * 4
    return manifest.select("path").repartition(n, "path").mapInArrow(_read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def new_folder(spark) -> str:
    """A new folder for archives below the shared one."""
    return re.sub(r"/+$", "", shared_dir(spark)) + f"/warc-{uuid.uuid4().hex}"
