import hashlib
import io

import pytest
import zstandard
from pyspark.errors import PySparkException
from textbench.llm.common import shared_path
from textbench.llm.warc import (SKIPPABLE, archive_round_trip, build_record, filesystem, frames, parse_record, read_warc,
                                resolve_revisits, train_dictionary, write_warc)

LONG = "é漢" * 400 + "x" * 300


def _rows():
    return [(1, "http://a/1", LONG), (2, "http://a/2", LONG), (7, None, LONG), (3, "http://b\r\nX: y", "short"), (4, "http://b/4", "short"),
            (5, "http://c", None), (6, "http://c", ""), (8, "http://d", "y" * 1000), (9, "http://d", "y" * 1000), (10, "u", "z" * 999),
            (11, "u", "z" * 999), (None, "http://n", LONG), (12, "big", "<p>big</p>" * 300_000), (2, "http://a/2", LONG)]


def _frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "d", "k") for i, u, h in rows], "page_id long, url string, html string, digest string, kind string")


def test_round_trip_against_plain_code(spark):
    rows = _rows()
    got = archive_round_trip(_frame(spark, rows), archive_bytes=2000).collect()
    keeper = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 1000 and i is not None:
            keeper[h] = max(i, keeper.get(h, i))
    want = []
    for i, u, h in rows:
        data, k = (h or "").encode(), keeper.get(h)
        revisit = k is not None and i != k
        want.append((str(i), len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", str(k if revisit else None)))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got) == sorted(want)
    assert {r["url"] for r in got if r["page_id"] == 3} == {"http://b%0D%0AX: y"} and {r["url"] for r in got if r["page_id"] == 7} == {None}


def test_payloads_archives_and_empty_table(spark):
    folder = shared_path(spark, "warc-test")
    manifest = write_warc(_frame(spark, _rows()), folder, archive_bytes=3000)
    assert manifest.count() > 1 and manifest.agg({"n_records": "sum"}).first()[0] == len(_rows())
    records = {(r["page_id"], r["record_type"]): r["payload"] for r in read_warc(manifest).collect()}
    assert bytes(records[(12, "response")]) == ("<p>big</p>" * 300_000).encode() and records[(1, "revisit")] is None
    fs, path = filesystem(manifest.first()["archive"])
    raw = fs.open_input_stream(path, compression=None).read()
    assert int.from_bytes(raw[:4], "little") == SKIPPABLE  # and a plain decoder skips the dictionary frame
    size = int.from_bytes(raw[4:8], "little")
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw[8:8 + size]))
    first = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj().decompress(raw[8 + size:])
    assert first.startswith(b"WARC/1.1\r\n") and parse_record(first)["record_type"] in ("response", "revisit")
    assert write_warc(_frame(spark, []), folder + "-none").count() == 0
    assert archive_round_trip(_frame(spark, [])).count() == 0


def _archive(records):
    d = train_dictionary([])
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d))
    return SKIPPABLE.to_bytes(4, "little") + len(d).to_bytes(4, "little") + d + b"".join(packer.compress(r) for r in records)


def test_reader_refuses_what_does_not_fit():
    digest = hashlib.sha1(b"body").hexdigest()
    good = build_record(1, "http://x", b"body", digest, "response", None, "2020-01-01T00:00:00Z")
    assert [parse_record(r)["payload"] for r in frames(io.BytesIO(_archive([good, good])), chunk=7)] == [b"body", b"body"]
    for bad in (good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"body", b"bodi"), good[:-2], good + b"x",
                good.replace(b"WARC-Date", b"X-Date"), good.replace(b"Content-Length: 4", b"Content-Length: 5"), b""):
        with pytest.raises(ValueError):
            parse_record(bad)
    whole = _archive([good])
    for raw in (whole[:-3], whole[:6], b"\x28\xb5\x2f\xfd" + whole[4:]):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(frames(io.BytesIO(raw)))


def test_revisit_without_response_fails(spark):
    rows = [("r1", 1, None, "revisit", "gone", 5, "aa")]
    df = spark.createDataFrame(rows, "record_id string, page_id long, url string, record_type string, refers_to_id string, payload_bytes long, payload_digest string")
    with pytest.raises(PySparkException, match="revisit without its response"):
        resolve_revisits(df).collect()
