"""Archives written and read back."""

import base64
import hashlib

import pytest

from riskloom.llm import warc

MARKS = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
ROWS = [
    (7, "http://a/7", "same"), (3, "http://a/3", "same"), (9, None, "same"), (1, "http://a b\r\n", None), (2, "u", ""), (4, "u", MARKS),
    (5, "u", "é" * 50 + "\r\n\r\n"), (6, "u", "WARC/1.1\r\n"), (8, "u", "\r\n"), (10, "u: v", "long " * 400), (11, "u", "long " * 400),
    (12, "u", MARKS * 30), (None, "u", "no id"), (13, "u", "twice"), (13, "u", "twice"),
]


def expected(rows, least):
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        again = len(data) >= least and first.get(html or "", page) != page
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "revisit" if again else "response", first[html or ""] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk_bytes,least", [(1 << 20, 0), (64, 0), (7, 5)])
def test_round_trip(spark, tmp_path, chunk_bytes, least):
    pages = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "page_id long, url string, html string, kind int, digest string")
    archive = warc.write_archives(pages, path=str(tmp_path / "a"), chunk_bytes=chunk_bytes, revisit_bytes=least)
    got = warc.read_archives(spark, archive)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(ROWS, least)
    text = b"".join(p.read_bytes() for p in (tmp_path / "a").glob("part-*"))
    assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")


def test_files_follow_their_lengths(spark, tmp_path):
    """A reader that knows nothing but Content-Length finds the same records."""
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    warc.write_archives(pages, path=str(tmp_path / "a"), chunk_bytes=64)
    kinds = []
    for path in (tmp_path / "a").glob("part-*"):
        data = path.read_bytes()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            n = int(fields["Content-Length"])
            assert rest[n : n + 4] == b"\r\n\r\n"
            kinds.append(fields["WARC-Type"])
            data = rest[n + 4 :]
    assert kinds.count("response") + kinds.count("revisit") == len(ROWS)
    assert kinds.count("continuation") > 30


def test_small_splits(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1)
    archive = warc.write_archives(pages, path=str(tmp_path / "a"), chunk_bytes=64)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = sorted((tuple(r) for r in warc.read_archives(spark, archive).collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == expected(ROWS, 0)


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(spark, warc.write_archives(pages, path=str(tmp_path / "a"))).count() == 0


def test_damage_is_found(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "some text")], "page_id long, url string, html string")
    archive = warc.write_archives(pages, path=str(tmp_path / "a"))
    for path in (tmp_path / "a").glob("part-*"):
        path.write_bytes(path.read_bytes().replace(b"some text", b"some tent"))
    for path in (tmp_path / "a").glob(".part-*.crc"):
        path.unlink()
    with pytest.raises(Exception, match="payload differs"):
        warc.read_archives(spark, archive).collect()
