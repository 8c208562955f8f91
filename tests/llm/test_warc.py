"""WARC archives against a plain account of the pages, and their files against a plain reader."""

import gzip
import hashlib
import random
from collections import Counter
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from rosterloom.llm import warc
from rosterloom.workspace import work_folder

SCHEMA = "page_id bigint, url string, html string"


def plain(pages, least=1000):
    """What the archive should say of each page whose page_id is given once."""
    payloads = [(i, (html or "").encode()) for i, _, html in pages]
    largest = {}
    for i, p in payloads:
        largest[p] = max(largest.get(p, i), i)
    return Counter((i, len(p), hashlib.sha1(p).hexdigest(), *(
        ("revisit", largest[p]) if len(p) >= least and largest[p] != i else ("response", None))) for i, p in payloads)


def read_back(spark, pages, schema=SCHEMA, **how):
    manifest = warc.write_warc(spark.createDataFrame(pages, schema), work_folder(spark, "test-warc"), **how)
    rows = warc.read_records(spark, manifest)
    return manifest, rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()


def some_pages():
    rng = random.Random(4)
    texts = ["é" * n for n in (499, 500, 501, 5000)] + ["", None, "x" * 999, "x" * 1000, "line\r\n\r\n" * 300, "WARC/1.1\r\n" * 200]
    return [(i, f"http://h{i}/p", rng.choice(texts) if i % 3 else f"page {i} " * rng.randint(1, 400)) for i in range(300)]


@pytest.mark.parametrize("size", [1 << 20, 700, 64])
def test_records(spark, size):
    pages = some_pages()
    manifest, rows = read_back(spark, pages, size=size)
    assert Counter(map(tuple, rows)) == plain(pages)
    assert manifest.agg(F.sum("n_records")).first()[0] == len(pages)


def test_payloads_come_back_in_pieces(spark):
    pages = some_pages()
    manifest, rows = read_back(spark, pages, size=700)
    pieces = {}
    for r in sorted(warc.read_chunks(spark, manifest).collect(), key=lambda r: r.chunk):
        pieces[r.page_id] = pieces.get(r.page_id, b"") + r.data
    html = {i: (text or "").encode() for i, _, text in pages}
    assert {r.page_id: pieces.get(r.page_id, b"") for r in rows if r.record_type == "response"} == {
        r.page_id: html[r.page_id] for r in rows if r.record_type == "response"}


def test_files_are_what_the_standard_says(spark):
    pages = some_pages()
    manifest, _ = read_back(spark, pages, size=700, date="2024-05-06T07:08:09Z")
    seen, ids = 0, set()
    for path in (r.path for r in manifest.collect()):
        with gzip.open(urlparse(path).path) as file:
            data = file.read()
        while data:
            head, _, data = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            fields = dict(line.split(": ", 1) for line in lines[1:])
            n = int(fields["Content-Length"])
            assert lines[0] == "WARC/1.1" and data[n:n + 4] == b"\r\n\r\n"
            assert {"WARC-Type", "WARC-Record-ID", "WARC-Date"} <= set(fields)
            assert fields["WARC-Date"] == "2024-05-06T07:08:09Z"
            if fields["WARC-Type"] != "warcinfo":
                block = data[:n]
                assert block.startswith(b"HTTP/1.1 200 OK\r\n") and "WARC-Target-URI" in fields
                seen += 1
            if fields["WARC-Type"] == "revisit":
                assert fields["WARC-Profile"] == warc.PROFILE and block.endswith(b"\r\n\r\n")
            ids.add(fields["WARC-Record-ID"])
            data = data[n + 4:]
    assert seen == len(pages) and len(ids) >= seen


def test_a_frequent_payload(spark):
    pages = [(i, "http://a/", "same " * 250) for i in range(1200)] + [(5000 + i, None, "pair " * 300) for i in range(2)]
    assert Counter(map(tuple, read_back(spark, pages)[1])) == plain(pages)


def test_a_list_of_revisits_too_long_to_send(spark, monkeypatch):
    monkeypatch.setattr(warc, "LISTED_BYTES", 0)
    pages = some_pages()
    assert Counter(map(tuple, read_back(spark, pages, size=700)[1])) == plain(pages)


def test_nulls_repeated_rows_and_odd_urls(spark):
    big = "z" * 2000
    pages = [(None, None, big), (None, "http://a b\r\nWARC-Type: x", big), (7, "u", big), (7, "u", big), (8, "v", None)]
    manifest, rows = read_back(spark, pages)
    kinds = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in rows)
    assert kinds == Counter({(None, 2000, "revisit", 7): 2, (7, 2000, "revisit", 7): 1, (7, 2000, "response", None): 1,
                             (8, 0, "response", None): 1})
    urls = {r.url for r in warc.read_records(spark, manifest).collect()}
    assert urls == {None, "u", "v", "http://a%20b%0D%0AWARC-Type:%20x"}


def test_a_long_page_empty_tables_and_other_columns(spark):
    long = "0123456789abcdef" * 400_000
    odd = spark.createDataFrame([(1, "u", long, {"a": 1}, 3, 4)], SCHEMA + ", `a.b` map<string,int>, record int, data int")
    manifest = warc.write_warc(odd, work_folder(spark, "test-warc"))
    (row,) = warc.read_records(spark, manifest).collect()
    assert (row.payload_bytes, row.payload_digest) == (len(long), hashlib.sha1(long.encode()).hexdigest())
    manifest, rows = read_back(spark, [])
    assert rows == [] and manifest.count() == 0 and warc.read_chunks(spark, manifest).count() == 0


def test_damage_is_seen(spark):
    manifest, _ = read_back(spark, [(1, "u", "abc " * 500)])
    path = urlparse(manifest.first().path).path
    data = gzip.open(path).read()
    with open(path, "wb") as file:
        members = data.partition(b"\r\n\r\n\r\n\r\n")
        for part in (members[0] + members[1], members[2].replace(b"abc", b"abd", 1)):
            file.write(gzip.compress(part))
    with pytest.raises(Exception):
        warc.read_records(spark, manifest).collect()
