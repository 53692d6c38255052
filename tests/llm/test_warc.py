import hashlib

import pytest

from tidemark.llm import common, warc


def written(spark, df, tmp_path, name):
    folder = "file://" + str(tmp_path / name)
    return common.keep(warc.write_bundles(warc.mark_revisits(df), folder), name), folder


@pytest.fixture
def pages(spark):
    big = "<p>" + "é" * 700 + "</p>"
    rows = [(1, "http://a/ü b", big, 0), (2, None, big, 0), (5, "http://c\r\nX: y", big, 0), (3, "u", "small", 0), (4, "u", "small", 0)]
    rows += [(6, "u", None, 0), (7, "u", "", 0), (8, "u", "x" * 600_000, 0), (None, "u", big, 0), (9, "u", "\r\n\r\nWARC/1.1\r\n" * 100, 0)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload int").repartition(3)


def test_records_come_back(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 2000)
    index, folder = written(spark, pages, tmp_path, "w1")
    found = {r["page_id"]: r for r in warc.read_records(index, folder).collect()}
    assert len(found) == 10
    html = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    for page, r in found.items():
        assert r["payload_bytes"] == len(html[page]) and r["payload_digest"] == hashlib.sha1(html[page]).hexdigest()
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == html[page] and r["refers_to"] is None
        else:
            assert r["payload"] is None and r["refers_to"] == "5"
    assert {p for p, r in found.items() if r["record_type"] == "revisit"} == {1, 2, None}


def test_single_records_are_found_by_the_index(spark, pages, tmp_path):
    index, folder = written(spark, pages, tmp_path, "w2")
    (row,) = warc.read_records(index.filter("page_id = 9"), folder).collect()
    assert bytes(row["payload"]) == b"\r\n\r\nWARC/1.1\r\n" * 100


def test_frames_can_be_read_apart(tmp_path):
    import zstandard
    from pyarrow import fs

    path = str(tmp_path / "b.zst")
    writer = warc.BundleWriter(fs.LocalFileSystem().open_output_stream(path, compression=None))
    data = [warc.record(i, "u", bytes([65 + i]) * 100_000, "d", "response", None) for i in range(7)]
    places = [writer.add(x) for x in data]
    writer.close()
    reader = warc.BundleReader(fs.LocalFileSystem().open_input_file(path))
    for (frame, offset), wanted in zip(places[::-1], data[::-1]):
        assert reader.frame(frame)[offset : offset + len(wanted)] == wanted
    with open(path, "rb") as whole:  # any reader of the format skips the seek table
        assert zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True).read() == b"".join(data)


def test_repeated_pages_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "y" * 2000), (1, "u", "y" * 2000)], "page_id long, url string, html string")
    index, folder = written(spark, df, tmp_path, "w3")
    assert [r["record_type"] for r in warc.read_records(index, folder).collect()] == ["response"] * 2
    index, folder = written(spark, df.limit(0), tmp_path, "w4")
    assert warc.read_records(index, folder).collect() == []
