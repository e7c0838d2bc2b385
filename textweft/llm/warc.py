"""WARC archives compressed with a dictionary of their own records, and their reader.

A record is compressed as a Zstandard frame of its own, so it can be read alone. All frames of an archive use one dictionary, trained
from records of that archive and stored in a skippable frame at its beginning (magic number 0x184D2A5D). Payloads that occur
again are revisit records, which refer to the response record of the smallest page_id.

An archive goes to a file whose name has the task attempt's id, and only archives that a finished attempt has reported are read, so lost
executors and repeated attempts leave nothing behind that counts. A task holds one archive's records at most. Archives are written with
Arrow's file systems: local and shared folders, HDFS, S3, GCS and Azure, by Hadoop's names, too; another scheme is an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from io import BufferedReader
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweft.llm import textkernel as tk
from textweft.plans.tables import new_path, written

MAGIC = 0x184D2A5D
#: Bytes of records after which an archive is closed, of its dictionary, and of records that train it.
ARCHIVE_BYTES, DICTIONARY_BYTES, TRAINING_BYTES = 32 << 20, 32 << 10, 2 << 20
LEVEL = 3
#: Tasks that read archives at most; each reads its archives one after another.
READ_TASKS = 20_000
#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 0
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Hadoop's names of stores that Arrow calls otherwise.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


class Record(NamedTuple):
    """What a record says of a page. ``payload`` is empty in a revisit; size and digest are always those of the full payload."""

    page_id: int | None
    url: str | None
    kind: str
    refers_to: int | None
    size: int
    digest: str
    payload: bytes


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, sha: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{sha}')}>"


def encode(r: Record) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r.size}\r\n\r\n".encode()
    block = http + r.payload
    head = ["WARC/1.1", f"WARC-Type: {r.kind}", f"WARC-Record-ID: {_record_id(r.page_id, r.digest)}", f"WARC-Date: {DATE}"]
    if r.url is not None:
        # line breaks and other control characters would end the header
        head += [f"WARC-Target-URI: {quote(r.url)}", "X-Target-URI-Quoted: yes"] if _CONTROL.search(r.url) else [f"WARC-Target-URI: {r.url}"]
    head.append(f"WARC-Payload-Digest: sha1:{r.digest}")
    if r.kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(r.refers_to, r.digest)}", f"X-Refers-To-Page-ID: {r.refers_to}"]
    if r.page_id is not None:
        head.append(f"X-Page-ID: {r.page_id}")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


_CONTROL = re.compile(r"[\x00-\x1f\x7f]")


def train(records: list[bytes]) -> bytes:
    """A dictionary of some whole records, spread evenly over all; their raw content where there are too few to train."""
    total = sum(map(len, records))
    step = max(1, -(-total // TRAINING_BYTES))
    some = records[::step]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, some, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(some)[:DICTIONARY_BYTES]


def archive(records: list[bytes]) -> bytes:
    """An archive of encoded records."""
    content = train(records)
    dictionary = zstandard.ZstdCompressionDict(content)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary)
    return b"".join([struct.pack("<II", MAGIC, len(content)), content, *(compressor.compress(r) for r in records)])


def read(stream: BufferedReader) -> Iterator[Record]:
    """The records of an archive, one at a time. Raises if a response's payload doesn't have its digest."""
    magic, n = struct.unpack("<II", stream.read(8))
    if magic != MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stream.read(n)))
    plain = BufferedReader(decompressor.stream_reader(stream, read_across_frames=True), 1 << 17)
    while version := plain.readline():
        if version != b"WARC/1.1\r\n":
            raise ValueError("a record doesn't begin where it should")
        head: dict[str, str] = {}
        while (line := plain.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[name] = value
        block = plain.read(int(head["Content-Length"]))
        if len(block) != int(head["Content-Length"]) or plain.read(4) != b"\r\n\r\n":
            raise ValueError("the archive is cut short")
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(http.rpartition(b"Content-Length: ")[2])
        sha = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if head["WARC-Type"] == "response" and (len(payload) != size or digest(payload) != sha):
            raise ValueError(f"the payload of {head['WARC-Record-ID']} isn't what was archived")
        number = lambda key: int(head[key]) if key in head else None
        url = head.get("WARC-Target-URI")
        if "X-Target-URI-Quoted" in head:
            url = unquote(url)
        yield Record(number("X-Page-ID"), url, head["WARC-Type"], number("X-Refers-To-Page-ID"), size, sha, payload)


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, and its path there. Names that Hadoop gives to object stores are known."""
    scheme, mark, rest = folder.partition("://")
    return pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}{mark}{rest}")


def _writer(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        task = TaskContext.get()
        name = f"{path}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        held: list[bytes] = []
        size = nth = 0

        def close() -> pa.RecordBatch:
            nonlocal size, nth
            at = f"{name}-{nth:04d}.warc.zst"
            # by the name's ending all would be compressed once more, as one frame
            with store.open_output_stream(at, compression=None) as out:
                out.write(archive(held))
            row = pa.RecordBatch.from_arrays([pa.array([at.removeprefix(path).lstrip("/")]), pa.array([len(held)], pa.int64())], ["file", "records"])
            held.clear()
            size, nth = 0, nth + 1
            return row

        for batch in batches:
            for page_id, url, text, first in zip(*(batch[c] for c in ("page_id", "url", "html", "first")), strict=True):
                payload = (text.as_py() or "").encode("utf-8", "surrogatepass")
                page, refers = page_id.as_py(), first.as_py()
                again = refers is not None and page != refers
                record = encode(Record(page, url.as_py(), "revisit" if again else "response", refers if again else None, len(payload), digest(payload), b"" if again else payload))
                held.append(record)
                size += len(record)
                if size >= archive_bytes:
                    yield close()
        if held:
            yield close()

    return run


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Writes a record per row of ``pages(page_id, url, html, ...)`` below ``folder``; ``(file, records)`` of each archive.

    A null html is an empty payload. Rows of the smallest page_id among equal payloads are responses, repeated rows too; rows without a
    page_id revisit it, and are responses if no row of their payload has one. An empty table makes no archive.
    """
    tk.small_batches(pages.sparkSession)
    own = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit(""))).alias("sha"))
    sized = pages.select("page_id", F.sha1(F.coalesce("html", F.lit(""))).alias("sha"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n"))
    groups = sized.filter(F.col("n") >= least_revisit).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha", "first")
    rows = own.join(written(groups, "payloads"), "sha", "left").select("page_id", "url", "html", "first")
    return written(rows.mapInArrow(_writer(folder, archive_bytes), "file string, records long"), "archives")


def read_archives(archives: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to, url)`` of every record, and ``payload`` if wanted."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        for batch in batches:
            for file in batch["file"].to_pylist():
                with store.open_input_stream(f"{path}/{file}", compression=None) as stream:
                    held: list[Record] = []
                    bytes_held = 0
                    for r in read(stream):
                        held.append(r if with_payload else r._replace(payload=b""))
                        bytes_held += len(held[-1].payload)
                        if len(held) >= 1000 or bytes_held > 8 << 20:
                            yield _batch(held, with_payload)
                            held, bytes_held = [], 0
                    if held:
                        yield _batch(held, with_payload)

    files = archives.select("file").distinct()
    # by size the few names would end in one task
    return files.repartition(max(1, min(files.count(), READ_TASKS))).mapInArrow(run, schema)


def _batch(records: list[Record], with_payload: bool) -> pa.RecordBatch:
    page, url, kind, refers, size, sha, payload = zip(*records, strict=True)
    arrays = [pa.array(page, pa.int64()), pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(kind, pa.string()), pa.array(refers, pa.int64()), pa.array(url, pa.string())]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    if with_payload:
        arrays.append(pa.array(payload, pa.binary()))
        names.append("payload")
    return pa.RecordBatch.from_arrays(arrays, names)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Archives ``pages`` in the session's shared folder and reads the archives back."""
    folder = new_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, **options), folder)


def oracle_sql() -> str:
    """The rows of ``round_trip`` in SQL for another engine, for tables of distinct page_ids."""
    char = lambda shift: f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v // {1 << shift}) % 32 + 1)::INT, 1)"
    number = "list_transform(range(0, 8), lambda i: ('0x' || substr(sha1(h), (5 * i + 1)::INT, 5))::BIGINT)"
    text = " || ".join(char(s) for s in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, url, strlen(h)::BIGINT AS payload_bytes, array_to_string(list_transform({number}, lambda v: {text}), '') AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, url, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""
