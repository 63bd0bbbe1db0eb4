import gzip
import hashlib

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from clonelens.llm import warc

LONG = "<p>" + "é" * 600 + "</p>"
PAGES = [
    (1, "http://a", LONG), (2, "http://b", LONG), (9, "http://c", LONG), (3, "http://d", "short"), (4, "http://e", "short"),
    (5, None, None), (6, "http://f\r\nWARC-Type: forged", ""), (None, "http://g", LONG), (None, None, "only without an id"),
    (7, "http://h", "\r\n\r\nWARC-Refers-To: <urn:x-page:1>\r\n" + "x" * 2000), (10, "http://i", "a b"), (10, "http://i", "a b"),
] + [(100 + i, "http://hot", "z" * 1500) for i in range(50)]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "archive")
    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id bigint, url string, html string, address string, n int")
    warc.write_archive(pages, path)
    return path


def _wanted():
    last = {}
    for i, _, html in PAGES:
        data = (html or "").encode()
        last[data] = max((x for x in (last.get(data), i) if x is not None), default=None)
    out = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        revisit = len(data) >= 1000 and i != last[data]
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last[data] if revisit else None))
    return sorted(out, key=repr)


def test_read_back_equals_the_rule(spark, archive):
    got = warc.read_archive(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=repr) == _wanted()


def test_payloads_are_stored_once(spark, archive):
    stored = spark.read.parquet(f"{archive}/payloads").collect()
    assert len(stored) == len({(p[2] or "").encode() for p in PAGES})
    assert all(hashlib.sha256(r["payload"]).hexdigest() == r["address"] for r in stored)


def test_records_are_whole(spark, archive):
    by_id = {p[0]: p for p in PAGES}
    for r in warc.whole_records(spark, archive).collect():
        record = bytes(r["record"])
        head, _, rest = record.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode())
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        block = rest[: int(fields[b"Content-Length"])]
        assert rest == block + b"\r\n\r\n"
        if r["record_type"] == "response" and r["page_id"] in by_id:
            assert block.partition(b"\r\n\r\n")[2] == (by_id[r["page_id"]][2] or "").encode()


def test_exported_files_hold_the_records(spark, archive, tmp_path):
    warc.export_warc(spark, archive, str(tmp_path / "out"))
    found = []
    for file in (tmp_path / "out").glob("part-*.gz"):
        data = gzip.decompress(file.read_bytes())
        while data:  # read the file by the lengths in its headers
            head, _, rest = data.partition(b"\r\n\r\n")
            length = int(dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])[b"Content-Length"])
            assert rest[length : length + 4] == b"\r\n\r\n"
            found.append(head + b"\r\n\r\n" + rest[: length + 4])
            data = rest[length + 4 :]
    assert sorted(found) == sorted(bytes(r["record"]) for r in warc.whole_records(spark, archive).collect())


def test_changed_payload_is_noticed(spark, archive, tmp_path):
    changed = F.when(F.octet_length("payload") > 1000, F.encode(F.lit("other"), "UTF-8")).otherwise(F.col("payload"))
    spark.read.parquet(f"{archive}/headers").write.parquet(str(tmp_path / "bad/headers"))
    spark.read.parquet(f"{archive}/payloads").withColumn("payload", changed).write.parquet(str(tmp_path / "bad/payloads"))
    with pytest.raises(Exception, match="differs"):
        warc.whole_records(spark, str(tmp_path / "bad")).collect()


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    warc.write_archive(empty, str(tmp_path / "none"))
    assert warc.read_archive(spark, str(tmp_path / "none")).count() == 0
    assert warc.whole_records(spark, str(tmp_path / "none")).count() == 0


def test_query_equals_sql(spark):
    assert differences(warc.op10_warc(spark, "/root/testdata/sf0.001"), connect("0.001"), warc.OP10_SQL) == []
