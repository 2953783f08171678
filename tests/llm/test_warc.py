import os

import pyarrow.fs as pafs

from minuteworks.llm import warc as X
from minuteworks.llm.common import scratch_path

PAGES = [(5, "http://a/ b", "same"), (3, None, "same"), (9, "u", None), (8, "u", ""), (1, "u\r\nX: y", "é" * 70_000), (2, "u", "same"), (2, "u", "same"), (None, "u", "same"), (None, "u", "alone"), (11, "u", "WARC/1.1\r\n\r\nnot a record")]
SCHEMA = "page_id long, url string, html string"


def brute(rows):
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = min(same) if same else None
        refers = first if first is not None and page_id != first else None
        out.append((page_id, len(payload), X.payload_digest(payload), "revisit" if refers is not None else "response", refers))
    return out


def in_order(rows):
    return sorted(rows, key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, 1) for r in PAGES], SCHEMA + ", payload int")
    for range_bytes in (1, 97, 8 << 20):
        got = X.warc_round_trip(pages, range_bytes=range_bytes).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert in_order(map(tuple, got)) == in_order(brute(PAGES))


def test_payloads_come_back(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    out = scratch_path(spark, "warc-test")
    rows = X.read_warc(X.write_warc(X.with_responses(pages), out), out, 50).where("record_type = 'response'").collect()
    assert sorted(bytes(r.payload) for r in rows) == sorted([b"same", b"same", b"", ("é" * 70_000).encode(), b"alone", b"WARC/1.1\r\n\r\nnot a record"])


def test_magic_inside_a_record_is_no_record(tmp_path):
    inner = X.gzip_member(b"no record at all", 0)
    parts = [X.gzip_member(X.page_record(k, "u", b"", None, "d") + inner + X.MAGIC + os.urandom(200), 0) for k in range(6)]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(parts))
    size = path.stat().st_size
    with pafs.LocalFileSystem().open_input_file(str(path)) as file:
        for step in (1, 13, 500, size):
            found = [at for s in range(0, size, step) for at, _ in X.records_in(file, size, s, min(size, s + step))]
            assert found == [sum(map(len, parts[:k])) for k in range(6)]


def test_least_bytes_and_empty(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], SCHEMA)
    got = {r.page_id: r.refers_to for r in X.warc_round_trip(pages, least_bytes=3).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}
    assert X.warc_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    got = X.warc_round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert in_order(map(tuple, got)) == in_order(brute(rows))
