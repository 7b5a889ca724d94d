"""Exact round trips."""

import random

import zstandard

from larkspur.llm import warc as W
from tests.llm.helpers import SF, rows

SCHEMA = "page_id long, url string, html string"


def test_round_trip_of_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for frame, size in ((1 << 12, 1 << 16), (1 << 20, 1 << 24)):
        bundles = W.bundle(pages, frame, size)
        assert rows(W.restore(bundles)) == rows(pages.select("page_id", "url", "html"))


def test_one_record_from_one_frame(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    bundles = W.bundle(pages, 1 << 13, 1 << 17).collect()
    html = {r.page_id: r.html for r in pages.collect()}
    assert sum(b.n_frames for b in bundles) > len(bundles) > 0
    for b in bundles:
        content = bytes(b.content)
        frames = W.read_seek_table(content)
        assert len(frames) == b.n_frames and b.n_records == len(b.entries)
        for start, length in frames:  # each stands by itself
            zstandard.ZstdDecompressor().decompress(content[start : start + length])
        for e in random.Random(1).sample(b.entries, min(5, len(b.entries))):
            head, body = W.read_record(content, e.frame, e.offset, e.length)
            assert head["WARC-Record-ID"] == e.record_id and body.decode() == html[e.page_id]


def test_bundle_is_plain_zstandard(spark):
    """A reader that knows nothing of the footer skips it."""
    b = W.bundle(spark.read.parquet(f"{SF}/pages.parquet"), 1 << 13, 1 << 30).coalesce(1).first()
    whole = zstandard.ZstdDecompressor().stream_reader(bytes(b.content), read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == b.n_records and len(whole) == sum(e.length for e in b.entries)


def test_index(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert W.index(W.bundle(pages)).count() == pages.count()


def test_odd_rows(spark):
    long = "<p>x</p>" * 300_000
    data = [(1, "http://a", "<p>hi"), (1, "http://a", "<p>hi"), (None, None, None), (2, None, ""), (3, "http://b", None), (4, "u", long), (5, "ü", "WARC/1.1\r\n\r\n\r\n"), (6, "http://a\nb\r\nc", "x")]
    bundles = W.bundle(spark.createDataFrame(data, SCHEMA), 1 << 16, 1 << 20)
    assert rows(W.restore(bundles)) == sorted(data, key=repr)
    ids = [r.record_id for r in W.index(bundles).collect()]
    assert len(ids) == 8 and len(set(ids)) == 7
    assert rows(W.bundle(spark.createDataFrame([], SCHEMA))) == []
    clash = spark.createDataFrame([(1, "u", "h", b"x", "y")], SCHEMA + ", content binary, entries string")
    assert rows(W.restore(W.bundle(clash))) == [(1, "u", "h")]
