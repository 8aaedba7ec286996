import gzip
import hashlib
import pathlib
import random

import pytest

from fleetlens.llm import warc as w

SCHEMA = "page_id long, url string, html string, digest string, value int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", 1) for r in rows], SCHEMA)


def tricky():
    rng = random.Random(2)
    trap = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    long = "".join(rng.choice("ab é🙂\r\n<>") for _ in range(60_000))
    return [
        (1, "http://a/1", "x" * 500), (2, "http://a/2", "x" * 500), (3, None, "short"), (4, "http://a/4", "short"),
        (5, "http://a\r\n/5", None), (6, "http://a/6", ""), (7, "http://é/7", long), (8, "u", long), (9, "u", trap * 900),
        (10, "u", "WARC/1.1\r\n" * 4000), (11, "u", "0\r\n\r\n" + "y" * w.CHUNK_BYTES), (None, "u", "x" * 500), (12, "u", "z" * 200), (12, "u", "z" * 200),
        (13, "u", "p" * (w.SEGMENT_BYTES - 20)), (14, "u", "q" * 3 * w.SEGMENT_BYTES),
    ]


def test_round_trip_is_exact(spark, tmp_path):
    rows, folder = tricky(), f"{tmp_path}/warc"
    w.write_archives(pages(spark, rows).repartition(3), folder)
    got = w.read_archives(spark, folder).collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    payloads = {p: (h or "").encode() for p, _, h in rows}
    refers = {r.page_id: r.refers_to for r in got if r.record_type == "revisit"}
    assert refers == {2: 1, 8: 7, None: 1}
    for r in got:
        if r.record_type == "response":
            assert bytes(r.payload) == payloads[r.page_id]
            assert r.payload_digest == hashlib.sha256(payloads[r.page_id]).hexdigest()
    # continuation records are really there
    text = b"".join(gzip.decompress(p.read_bytes()) for p in pathlib.Path(folder).glob("*.gz"))
    assert text.count(b"WARC-Segment-Total-Length") >= 4 and text.count(b"WARC-Type: continuation") > 10


def test_sizes_of_the_whole_payload(spark, tmp_path):
    rows, folder = tricky(), f"{tmp_path}/warc"
    w.write_archives(pages(spark, rows), folder)
    got = {(r.page_id, r.payload_bytes, r.payload_digest) for r in w._sizes(w.read_archives(spark, folder)).collect()}
    assert got == {(p, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for p, _, h in rows}


def test_damage_is_seen(spark, tmp_path):
    folder = f"{tmp_path}/warc"
    w.write_archives(pages(spark, [(1, "u", "a" * 50_000), (2, "u", "b" * 90)]).coalesce(1), folder)
    path = next(pathlib.Path(folder).glob("*.gz"))
    records = gzip.decompress(path.read_bytes()).split(b"\r\n\r\nWARC/1.1\r\n")
    lost = [r for r in records if b"WARC-Segment-Number: 2" not in r]
    assert len(lost) < len(records)
    path.with_name("part.gz").write_bytes(gzip.compress(b"\r\n\r\nWARC/1.1\r\n".join(lost)))
    path.unlink()
    (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    assert {r.page_id: r.intact for r in w.read_archives(spark, folder).collect()} == {1: False, 2: True}


@pytest.mark.parametrize("body", [b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nabc", b""])
def test_broken_framing(body):
    assert w.unchunked(body) is None


def test_chunks(spark):
    for payload in (b"", b"a", b"x" * 20_000, w.START * 5000, b"\r\n\r\n" + w.START):
        framed = w.chunked(payload)
        assert w.unchunked(framed) == payload and b"\r\n\r\n" + w.START not in framed
        assert b"".join(w.segments(framed, 64)) == framed
        assert not any(p.startswith(w.START) for p in w.segments(framed, 64)[1:])
    assert w.unchunked(b"3;name=x\r\nabc\r\n0\r\n\r\n") == b"abc"


def test_empty_table(spark, tmp_path):
    w.write_archives(pages(spark, []), f"{tmp_path}/warc")
    assert w.read_archives(spark, f"{tmp_path}/warc").count() == 0
