"""The query against SQL, and the files byte by byte."""

import gzip
import zlib

import pytest

from tests.conftest import SF_SMALL
from tests.llm.test_line_exact import same_as_sql
from tiermill.llm import warc as W


def test_query_matches_sql(spark):
    same_as_sql(spark, "op7_warc", SF_SMALL)


def test_files(spark):
    rows = [(1, "http://a/ b\r\n", "x\r\n\r\ny"), (2, None, "é" * 70000), (3, "u", None), (4, "u", ""), (5, "u", "é" * 70000), (6, "u", "WARC/1.1\r\n\r\n")]
    d = spark.createDataFrame([(i, u, h, "k", 1) for i, u, h in rows], "page_id long, url string, html string, key string, page int").coalesce(1)
    folder = W.write_monolithic(d)
    name, = [r.file for r in spark.read.parquet(folder + "/manifest").collect()]
    raw = open(f"{folder}/{name}".removeprefix("file:"), "rb").read()
    z = zlib.decompressobj(31)
    z.decompress(raw)
    assert z.eof and not z.unused_data  # one member
    target = W.normalise(spark, folder)
    new, = spark.read.parquet(target + "/manifest").collect()
    packed = open(f"{target}/{new.file}".removeprefix("file:"), "rb").read()
    assert gzip.decompress(packed) == gzip.decompress(raw) and new.records == 6
    at = 0
    for line in open(f"{target}/{new.file}.idx".removeprefix("file:")):
        a, n, rid, kind = line.split()
        z = zlib.decompressobj(31)
        record = z.decompress(packed[int(a):int(a) + int(n)])
        assert int(a) == at and z.eof and not z.unused_data and record.startswith(b"WARC/1.1\r\n") and rid.encode() in record
        at += int(n)
    got = {r.page_id: r for r in W.read_indexed(spark, target, with_payload=True).collect()}
    assert got[1].payload == b"x\r\n\r\ny" and got[1].url == "http://a/%20b%0D%0A"
    assert got[5].record_type == "revisit" and got[5].refers_to == 2 and got[5].payload is None
    assert got[2].payload == ("é" * 70000).encode() and got[4].refers_to == 3 and got[3].payload == b""


def test_small_payloads_ties_nulls_and_empty_table(spark):
    rows = [(3, "u", "aa"), (3, "u", "aa"), (None, "u", "aa"), (1, "u", "b"), (2, "u", "b"), (None, "u", "c"), (None, "u", "c")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in W.archived(d, min_bytes=2).collect())
    assert got == sorted([("3", 2, "response", "None")] * 2 + [("None", 2, "revisit", "3"), ("1", 1, "response", "None"), ("2", 1, "response", "None")]
                         + [("None", 1, "response", "None")] * 2)
    assert W.archived(d.where("false")).collect() == []


def test_cut_streams_raise():
    record = W.build_record(1, "u", b"payload", None)
    with pytest.raises(ValueError):
        list(W.split_records(iter([record[:-9]])))

    class F:
        def __init__(self, raw):
            self.raw = raw

        def read(self, n):
            x, self.raw = self.raw[:n], self.raw[n:]
            return x

    packed = gzip.compress(record * 3)
    assert len(list(W.split_records(W.inflate(F(packed + packed))))) == 6
    with pytest.raises(ValueError):
        list(W.inflate(F(packed[:-12])))
