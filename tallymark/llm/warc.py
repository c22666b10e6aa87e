"""WARC archives, compressed record by record with a Zstandard dictionary of their own.

A file starts with a skippable frame that holds the dictionary; every record after it is one
Zstandard frame. The dictionary is trained on archived records. Files are written by the tasks into
the shared folder under names of their own, and only those that a successful task lists in the
manifest count, so a task that runs twice leaves nothing twice in the archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import shared_folder, stored

SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 64 << 20
LEVEL = 3
#: Records, and characters of each, that the dictionary is trained on, and its size.
SAMPLE_RECORDS, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 32_768, 32_768
_READ = 1 << 20


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def marked_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html (never NULL), __digest and refers_to of every page.

    Of equal payloads of at least ``min_bytes`` bytes the one of the largest page_id is the response
    and the others refer to it. Groups are folded on the map side and only those of two and more are
    kept, so the payloads are joined to a narrow table that is stored first: its size decides between
    a broadcast and a shuffle, and adaptive execution splits a hot digest.
    """
    payloads = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    hashed = payloads.withColumn("__digest", F.sha1(F.col("html").cast("binary")))
    groups = stored(hashed.where((F.octet_length("html") >= min_bytes) & F.col("page_id").isNotNull())
                    .groupBy("__digest").agg(F.max("page_id").alias("__keeper"), F.count("*").alias("__n"))
                    .where("__n > 1").select("__digest", "__keeper"))
    refers = F.when((F.octet_length("html") >= min_bytes) & (F.col("page_id") != F.col("__keeper")),
                    F.col("__keeper"))
    return hashed.join(groups, "__digest", "left").select("page_id", "url", "html", refers.alias("refers_to"))


def trained_dictionary(pages: DataFrame, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from a bounded sample of records, chosen by id hash; it only affects file sizes.

    Where the records are too few to train on, they themselves are the (raw) dictionary.
    """
    some = pages.where("html is not null and page_id is not null")
    chosen = some.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_RECORDS)
    sample = (some.join(F.broadcast(chosen), "page_id").dropDuplicates(["page_id"])  # at most SAMPLE_RECORDS ids
              .select("page_id", "url", F.substring("html", 1, SAMPLE_CHARS).alias("html")).collect())
    records = [_record(r.page_id, r.url, r.html.encode(), None, "") for r in sample]
    records.sort()  # the same dictionary whatever the order of the rows
    try:
        return zstandard.train_dictionary(size, records).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(records)[:size] or _record(0, "", b"", None, "")


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    trained = data[:4] == b"\x37\xa4\x30\xec"
    return zstandard.ZstdCompressionDict(
        data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


def _named(page_id) -> str:
    return f"<urn:x-page:{page_id}>" if page_id is not None else "<urn:x-page:none>"


def _record(page_id, url, payload: bytes, refers_to, date: str) -> bytes:
    """One record: the HTTP head, and the payload unless it revisits another."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "") or "urn:x-page:no-url"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {_named(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}",
            f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
            "Content-Type: application/http;msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_named(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(folder: str, dictionary, date: str, file_bytes: int):
    schema = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def write(batches):
        data = dictionary.value
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(data))
        store, root = pafs.FileSystem.from_uri(folder)
        out, name, records = None, None, 0

        def close():
            size = out.tell()
            out.close()
            return pa.RecordBatch.from_pydict({"file": [name], "records": [records], "bytes": [size]}, schema)

        for batch in batches:
            ids, refers = batch.column("page_id").to_pylist(), batch.column("refers_to").to_pylist()
            for i, page_id in enumerate(ids):
                if out is None:
                    store.create_dir(root, recursive=True)
                    name, records = f"{uuid.uuid4().hex}.warc.zst", 0
                    out = store.open_output_stream(f"{root}/{name}")
                    out.write(struct.pack("<II", SKIPPABLE, len(data)) + data)
                payload = batch.column("html")[i].as_py().encode()
                out.write(compressor.compress(
                    _record(page_id, batch.column("url")[i].as_py(), payload, refers[i], date)))
                records += 1
                if out.tell() >= file_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return write


def write_warc(pages: DataFrame, folder: str | None = None, min_bytes: int = 0,
               date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record per row and return the stored manifest: folder, file, records, bytes.

    A NULL html is an empty payload. A row without page_id is always a response of its own. Rows that
    repeat a page_id with equal payload are responses if it is the largest of its group. A URL's
    control characters and spaces are percent-encoded. An empty table writes no file.
    """
    folder = folder or shared_folder(pages.sparkSession)
    dictionary = pages.sparkSession.sparkContext.broadcast(trained_dictionary(pages))
    manifest = marked_revisits(pages, min_bytes).mapInArrow(
        _writer(folder, dictionary, date, file_bytes), "file string, records long, bytes long")
    return stored(manifest.select(F.lit(folder).alias("folder"), "file", "records", "bytes"))


def records_of(stream):
    """The records of an archive, each as bytes; one frame at a time is held."""
    head = stream.read(8)
    magic, size = struct.unpack("<II", head)
    if magic != SKIPPABLE:
        raise ValueError("the archive does not start with a dictionary frame")
    decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(stream.read(size)))
    rest = b""
    while True:
        rest = rest or stream.read(_READ)
        if not rest:
            return
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            if not rest and not (rest := stream.read(_READ)):
                raise ValueError("the archive ends within a record")
            parts.append(frame.decompress(rest))
            rest = b""
        rest = frame.unused_data
        yield b"".join(parts)


def parsed(record: bytes) -> dict:
    """Header fields and payload facts of a record; the digest of a response is computed anew."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    declared = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != length or payload_digest(payload) != declared):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")

    def page(name):
        number = fields.get(name, "<urn:x-page:none>")[len("<urn:x-page:"):-1]
        return None if number == "none" else int(number)

    return {"page_id": page("WARC-Record-ID"), "payload_bytes": length, "payload_digest": declared,
            "record_type": fields["WARC-Type"], "refers_to": page("WARC-Refers-To"),
            "target_uri": fields["WARC-Target-URI"], "payload": payload if response else None}


_INDEX = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                    ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()),
                    ("file", pa.string())])


def _reader(batches):
    for batch in batches:
        for folder, file in zip(batch.column("folder").to_pylist(), batch.column("file").to_pylist()):
            store, root = pafs.FileSystem.from_uri(folder)
            rows = []
            with store.open_input_stream(f"{root}/{file}") as stream:
                for record in records_of(stream):
                    rows.append({k: v for k, v in parsed(record).items() if k != "payload"} | {"file": file})
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_pylist(rows, _INDEX)
                        rows = []
            yield pa.RecordBatch.from_pylist(rows, _INDEX)


def read_warc(manifest: DataFrame) -> DataFrame:
    """One row per record of the listed archives, payload digests verified; a file is one task's work."""
    files = max(1, manifest.count())
    return manifest.select("folder", "file").repartition(files).mapInArrow(
        _reader, "page_id long, payload_bytes long, payload_digest string, record_type string, "
                 "refers_to long, target_uri string, file string")
