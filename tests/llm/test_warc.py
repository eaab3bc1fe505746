"""WARC archives: records read back whole, revisits against a plain grouping, archives that lie."""

import gzip
import hashlib
from collections import defaultdict

import pytest
from pyspark.errors import PySparkException

from trialgrid.llm import warc as W
from trialgrid.session import scratch_path, written

HARD = "x" * 990 + "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"
ROWS = [(1, "http://a/ b\n", HARD), (2, None, HARD), (3, "u", None), (4, "u", ""), (5, "u", "é" * 499), (6, "u", "é" * 499),
        (7, "u", "é" * 500), (8, "u", "é" * 500), (8, "u", "é" * 500), (None, "u", "é" * 500), (9, "u", "WARC/1.1\r\n"),
        (10, "u", "WARC/1.1\r"), (11, "u", "\r\n\r\n"), (12, "u", "WARC/1.1\r\n" * 20000), (13, "u", "y" * 3_000_000)]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id bigint, url string, html string, HTML string").repartition(3)


def plain(rows, least=1000):
    groups = defaultdict(list)
    for key, _, text in rows:
        groups[(text or "").encode()].append(key)
    out = []
    for payload, keys in groups.items():
        keys.sort(key=lambda k: (k is not None, k or 0))
        facts = (len(payload), hashlib.sha1(payload).hexdigest())
        last = keys.pop()
        out.append((last, *facts, "response", None))
        out += [(k, *facts, "revisit", last) if len(payload) >= least else (k, *facts, "response", None) for k in keys]
    return sorted(out, key=str)


def result(records):
    return sorted(((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to_key) for r in records.collect()), key=str)


def test_archived(spark):
    assert result(W.archived(pages(spark, ROWS))) == plain(ROWS)
    many = [(k, "u", f"{k % 3}" * 1500) for k in range(600)]
    assert result(W.archived(pages(spark, many))) == plain(many)
    assert result(W.archived(pages(spark, ROWS), min_bytes=0)) == plain(ROWS, 0)
    assert W.archived(pages(spark, ROWS).limit(0)).collect() == []


def test_payloads_come_back_whole(spark):
    path = W.write_archives(W.responses(pages(spark, ROWS)), scratch_path(spark, "t"))
    got = sorted(((r.key, r.uri, bytes(r.payload).decode()) for r in W.read_archives(spark, path).collect()), key=str)
    assert got == sorted(((k, u if u != "http://a/ b\n" else "http://a/%20b%0A", t or "") for k, u, t in ROWS), key=str)


def test_archives_are_warc_files(spark):
    raw = W.write_archives(W.responses(pages(spark, ROWS[:2])), scratch_path(spark, "t"))
    out = W.resolve_revisits(spark, raw, scratch_path(spark, "t"))
    files = [bytes(r.content) for r in spark.read.format("binaryFile").load(out).collect()]
    text = b"".join(gzip.decompress(f) for f in files).decode()
    revisit = [r for r in text.split("WARC/1.1\r\n") if "WARC-Type: revisit" in r]
    assert len(revisit) == 1 and revisit[0].endswith("\r\n\r\n\r\n\r\n") and W.PROFILE in revisit[0]
    assert "WARC-Refers-To: <urn:uuid:" in revisit[0] and "WARC-Payload-Digest: sha1:" in revisit[0]
    assert text.count("abc\r\n\r\nWARC/1.1") == 1  # the payload is there once


def test_revisits_of_given_archives_are_resolved(spark):
    """Archives that hold revisits already: of what was a response, and of something that isn't there."""
    first = written(W.responses(pages(spark, [(1, "u", "a" * 2000), (5, "u", "b" * 2000)])), "t")
    ids = {r.key: (r.record_id, r.payload_digest) for r in first.collect()}
    given = spark.createDataFrame(
        [("<urn:1>", "revisit", 9, "u", W.NO_DATE, ids[1][1], 2000, ids[1][0], 1, None),
         ("<urn:2>", "revisit", 3, "u", W.NO_DATE, "ff" * 20, 4000, "<urn:gone>", 77, None)], W.COLUMNS)
    path = W.write_archives(first.unionByName(given), scratch_path(spark, "t"))
    out = W.read_archives(spark, W.resolve_revisits(spark, path, scratch_path(spark, "t")), payloads=False)
    assert result(W.restored(written(out.drop("payload"), "t"))) == sorted([
        (1, 2000, ids[1][1], "response", None), (5, 2000, ids[5][1], "response", None),
        (9, 2000, ids[1][1], "revisit", 1), (3, 4000, "ff" * 20, "revisit", 77)], key=str)


def test_wrong_archives_are_errors(spark):
    path = W.write_archives(W.responses(pages(spark, ROWS[4:6]).coalesce(1)), scratch_path(spark, "t"))
    content = gzip.decompress(next(bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect())).decode()
    for wrong in (content.replace("é", "e", 1), content[:-3], content.replace("sha1:", "sha1:0", 1), "junk\r\n" + content):
        bad = scratch_path(spark, "t")
        spark.createDataFrame([(wrong,)], "value string").coalesce(1).write.option("lineSep", "\r\n").text(bad)
        with pytest.raises(PySparkException):
            W.read_archives(spark, bad).collect()
