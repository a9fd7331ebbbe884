import glob
import gzip
import hashlib

import pytest

from cairnspark.llm import common, queries, warc
from cairnspark.llm.common import new_path

PAGES = "page_id long, url string, html string"


def law(pages):
    """page_id to (bytes, digest, type, refers_to), from the pages alone."""
    groups = {}
    for p in pages:
        groups.setdefault(p.html or "", []).append(p.page_id)
    out = []
    for p in pages:
        data = (p.html or "").encode()
        ids = [i for i in groups[p.html or ""] if i is not None]
        again = len(data) >= 1000 and bool(ids) and p.page_id != max(ids)
        out.append((p.page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", max(ids) if again else None))
    return out


def rows(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


def test_query(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert rows(queries.op5_warc(spark, sf)) == sorted(law(pages), key=repr)


def made(spark):
    big = "ü" * 600
    return spark.createDataFrame([(1, "http://a/1", big), (2, "http://a/2", big), (9, None, big), (None, "http://a/n", big), (3, "http://a/\r\n \x00é", "x" * 999), (4, "http://a/4", "x" * 999), (5, None, None), (6, "", ""), (7, "u", "y" * 1000), (7, "u", "y" * 1000), (None, None, "z" * 2000), (None, None, "z" * 2000), (8, "v", "WARC/1.1\r\n\r\n" * 200), (10, "w", "q" * 3_000_000)], PAGES)


def test_revisits_nulls_and_ties(spark):
    pages = made(spark)
    assert rows(warc.round_trip(pages)) == sorted(law(pages.collect()), key=repr)


@pytest.mark.parametrize("hot", [1024, 2])
def test_shuffled_joins_give_the_same(spark, monkeypatch, hot):
    """No broadcast, and one payload in most rows."""
    for name, value in (("BROADCAST_ROWS", 0), ("WIDE_ROWS", 0), ("HOT", hot)):
        monkeypatch.setattr(common, name, value)
    pages = made(spark).unionByName(spark.range(100, 160).selectExpr("id as page_id", "'u' as url", "repeat('p', 1500) as html"))
    assert rows(warc.round_trip(pages)) == sorted(law(pages.collect()), key=repr)


def test_archives_are_plain_warc(spark):
    """Read with nothing but gzip: members one after the other, as the index says."""
    folder = new_path(spark, "test-warc")
    pages = made(spark).repartition(3)
    index = warc.write(pages, folder).collect()
    held, n = {}, 0
    for f in glob.glob(folder.removeprefix("file://").replace("file:", "") + "/*.warc.gz"):
        data = open(f, "rb").read()
        whole = gzip.decompress(data)
        assert whole.startswith(b"WARC/1.1\r\nWARC-Type: ")
        n += sum(1 for r in index if r.archive.endswith(f.rsplit("/", 1)[1]))
        held[f.rsplit("/", 1)[1]] = data
    assert n == len(index) == pages.count()
    html = {(p.page_id, len((p.html or "").encode())): (p.html or "").encode() for p in pages.collect()}
    for r in index:
        head, block = warc.parse(gzip.decompress(held[r.archive.rsplit("/", 1)[1]][r.offset : r.offset + r.length]))
        assert head["warc-type"] == r.record_type and head["content-length"] == str(len(block))
        assert block == (html[r.page_id, r.payload_bytes] if r.record_type == "response" else b"")
        assert "\r" not in head["warc-target-uri"] and "\n" not in head["warc-target-uri"]


def test_selected_records_only(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    index = warc.write(pages, new_path(spark, "test-warc"))
    some = warc.read(index.where("page_id % 7 = 3 and record_type = 'response'")).collect()
    html = {p.page_id: p.html for p in pages.collect()}
    assert {r.page_id for r in some} == {r.page_id for r in index.where("page_id % 7 = 3 and record_type = 'response'").collect()}
    assert all(r.payload.decode() == html[r.page_id] for r in some)


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0
