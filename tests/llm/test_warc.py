import hashlib
import io
import random

import pyarrow.fs as pafs
import pytest
import zstandard

from textweft.llm import warc
from textweft.plans.tables import new_path

SCHEMA = "page_id bigint, url string, html string, sha string, first string"


def test_archive_round_trip_and_single_records():
    rng = random.Random(1)
    records = []
    for i in range(300):
        payload = ("<html>" + " ".join(rng.choices(["alpha", "beta", "gamma", "é"], k=rng.randrange(200)))).encode()
        records.append(warc.Record(i if i % 7 else None, f"http://x/{i}?a=%20é" if i % 5 else None, "response", None, len(payload), warc.digest(payload), payload))
    records.append(warc.Record(1000, "http://x/\r\nInjected: yes", "revisit", 0, 5, warc.digest(b"hello"), b""))
    data = warc.archive([warc.encode(r) for r in records])
    assert list(warc.read(io.BytesIO(data))) == records
    assert int.from_bytes(data[:4], "little") == warc.MAGIC
    size = int.from_bytes(data[4:8], "little")
    alone = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompressobj().decompress(data[8 + size :])
    assert alone == warc.encode(records[0])


def test_damage_is_noticed():
    good = warc.encode(warc.Record(1, "u", "response", None, 3, warc.digest(b"abd"), b"abc"))
    with pytest.raises(ValueError, match="payload"):
        list(warc.read(io.BytesIO(warc.archive([good]))))
    with pytest.raises(ValueError, match="cut short"):
        list(warc.read(io.BytesIO(warc.archive([good[:-3]]))))


def brute(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, u, h in rows:
        b = (h or "").encode()
        f = first.get(h or "")
        again = f is not None and i != f
        out.append((i, u, len(b), warc.base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=repr)


def test_rows(spark):
    rng = random.Random(3)
    rows = [(i, f"http://h/{i}", rng.choice(["same", "other é", f"own {i}", "", None]) ) for i in range(200)]
    rows += [(5, "again", rows[5][2]), (None, "no id", "same"), (None, None, "nobody else"), (None, None, "nobody else"), (900, "long", "x y " * 400_000)]
    pages = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA).repartition(5)
    assert sorted(map(tuple, warc.round_trip(pages, archive_bytes=4096).select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == brute(rows)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_payloads_come_back(spark):
    pages = spark.createDataFrame([(1, "a", "é", None, None), (2, "b", "é", None, None)], SCHEMA)
    folder = new_path(spark, "test-warc")
    got = sorted(warc.read_archives(warc.write_archives(pages, folder), folder, with_payload=True).collect())
    assert [(r.page_id, bytes(r.payload), r.record_type) for r in got] == [(1, "é".encode(), "response"), (2, b"", "revisit")]
    assert {r.record_type for r in warc.round_trip(pages, least_revisit=3).collect()} == {"response"}


def test_a_record_of_a_written_file_can_be_read_alone(spark):
    folder = new_path(spark, "test-warc")
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>page {i} " + "of words " * 50, None, None) for i in range(20)], SCHEMA).coalesce(1)
    (file,) = [r.file for r in warc.write_archives(pages, folder).collect()]
    store, path = pafs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{path}/{file}") as stream:
        data = stream.read()
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little")
    size = int.from_bytes(data[4:8], "little")
    dictionary, rest, records = zstandard.ZstdCompressionDict(data[8 : 8 + size]), data[8 + size :], []
    while rest:
        one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        records.append(one.decompress(rest))
        rest = one.unused_data
    assert len(records) == 20 and all(r.startswith(b"WARC/1.1\r\n") and r.count(b"WARC/1.1") == 1 for r in records)
