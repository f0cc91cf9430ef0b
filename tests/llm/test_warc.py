import hashlib

import pytest

from textloom.llm import warc as W

BIG = "<p>" + "é" * 80 + "</p>"
PAGES = [(5, "http://a", BIG), (3, "http://b\r\nX: 1 %0D", BIG), (9, None, BIG), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", "WARC/1.1\r\n\r\n" * 20), (3, "http://b\r\nX: 1 %0D", BIG), (None, "u", BIG)]


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip(spark, tmp_path, compression, monkeypatch):
    path = f"file://{tmp_path}/w"
    df = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, digest string, first string")
    if compression == "gzip":
        monkeypatch.setattr(W.WarcWriter, "__init__", lambda self, o, real=W.WarcWriter.__init__: (real(self, o), setattr(self, "zip", True))[0])
    W.archive(df, path)
    got = sorted(map(str, (tuple(r) for r in W.read_pages(spark, path).collect())))
    want = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        revisit = html == BIG and i not in (3, None)
        want.append(str((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None)))
    assert got == sorted(want)
    urls = {r.target_uri for r in W.read_archive(spark, path, payloads=False).collect()}
    assert urls == {p[1] for p in PAGES}


def test_splits_and_pushdown(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    rows = [(i, f"http://h{i % 3}/", f"page {i} " * 50) for i in range(300)]
    spark.dataSource.register(W.WarcSource)
    W.archive(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    reader = W.WarcReader({"path": path, "splitBytes": "10000"})
    parts = reader.partitions()
    payloads = [r for p in parts for b in W.read_stretch(p, W.Wanted(), True) for r in b.column("payload").to_pylist()]
    assert sorted(payloads) == sorted(h.encode() for _, _, h in rows)
    total = sum(b.num_rows for p in parts for b in W.read_stretch(p, W.Wanted(), False))
    assert total == 300
    df = W.read_archive(spark, path)
    assert df.where("record_type = 'response' and target_uri like 'http://h1%'").count() == 100
    assert df.where("record_type in ('revisit', 'request')").count() == 0
    assert df.where("refers_to is null and content_length > 10").count() == 300


def test_marks_split_a_large_file(tmp_path):
    writer = W.WarcWriter({"path": f"file://{tmp_path}/w", "indexBytes": "5000"})
    import pyarrow as pa

    rows = [{"record_type": "response", "record_id": f"<urn:page:{i}>", "warc_date": "d", "target_uri": "u", "refers_to": None, "payload_digest": "sha256:0", "payload": b"x" * 1000} for i in range(60)]
    writer.commit([writer.write(iter([pa.RecordBatch.from_pylist(rows)]))])
    parts = W.WarcReader({"path": f"file://{tmp_path}/w", "splitBytes": "9000"}).partitions()
    assert len(parts) > 3
    ids = [i for p in parts for b in W.read_stretch(p, W.Wanted(), False) for i in b.column("record_id").to_pylist()]
    assert ids == [f"<urn:page:{i}>" for i in range(60)]


def test_empty(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    W.archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert W.read_pages(spark, path).count() == 0


@pytest.mark.parametrize("split", [{}, {"direct_bytes": 0, "words": 4}, {"direct_bytes": 0}])
def test_copies_over_many_tasks(spark, tmp_path, split):
    """A third of all pages has one payload, others occur two or three times, in all tasks."""
    path = f"file://{tmp_path}/w"
    body = lambda i: BIG if i % 3 == 0 else f"<p>{i // 4 * 4 if i % 2 else i} " + "x" * 120
    rows = [(i, f"http://h/{i}", body(i)) for i in range(600)] + [(7, "http://again", body(7))]
    W.archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(12), path, **split)
    first: dict[str, int] = {}
    for i, _, h in rows:
        first[h] = min(first.get(h, i), i)
    want = sorted(str((i, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "revisit" if first[h] != i else "response", first[h] if first[h] != i else None)) for i, _, h in rows)
    assert sorted(str(tuple(r)) for r in W.read_pages(spark, path).collect()) == want
    assert {r.target_uri for r in W.read_archive(spark, path, ("revisit",), payloads=False).collect()} == {u for i, u, h in rows if first[h] != i}


def test_compressed_archives_split_at_members(tmp_path):
    import pyarrow as pa

    writer = W.WarcWriter({"path": f"file://{tmp_path}/w", "indexBytes": "2000", "compression": "gzip"})
    blob = [hashlib.sha256(bytes([i])).hexdigest() * 30 + str(i) for i in range(80)]
    rows = [{"record_type": "resource", "record_id": f"<urn:page:{i}>", "warc_date": "d", "target_uri": "u", "refers_to": None, "payload_digest": None, "payload": b.encode()} for i, b in enumerate(blob)]
    writer.commit([writer.write(iter([pa.RecordBatch.from_pylist(rows)]))])
    (file,) = tmp_path.glob("w/*.warc.gz")
    for path in (f"file://{tmp_path}/w", f"file://{file}"):  # a folder, and one file beside its index
        parts = W.WarcReader({"path": path, "splitBytes": "3000"}).partitions()
        assert len(parts) > 2
        for payloads in (True, False):
            found = [b for p in parts for b in W.read_stretch(p, W.Wanted(), payloads)]
            assert [i for b in found for i in b.column("record_id").to_pylist()] == [f"<urn:page:{i}>" for i in range(80)]
        assert [x.decode() for p in parts for b in W.read_stretch(p, W.Wanted(), True) for x in b.column("payload").to_pylist()] == blob
        some = [i for p in parts for b in W.read_stretch(p, W.Wanted([("record_id", "in", ["<urn:page:70>"])]), False) for i in b.column("record_id").to_pylist()]
        assert some == ["<urn:page:70>"]


def test_http_payloads():
    import gzip
    import zlib

    assert W.http_payload(b"GET /x") == b"GET /x" and W.http_payload(b"") == b""
    assert W.http_payload(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n\r\nbody") == b"\r\nbody"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nWiki\r\n5;x=1\r\npedia\r\n0\r\n\r\n"
    assert W.http_payload(chunked, True) == b"Wikipedia" and W.http_payload(chunked).startswith(b"4\r\n")
    assert W.http_payload(chunked[:-12], True) == chunked[:-12].split(b"\r\n\r\n", 1)[1]
    for coding, body in (("gzip", gzip.compress(b"page")), ("deflate", zlib.compress(b"page")), ("deflate", zlib.compress(b"page")[2:-4]), ("gzip", b"page")):
        assert W.http_payload(b"HTTP/1.1 200 OK\r\nContent-Encoding: " + coding.encode() + b"\r\n\r\n" + body, True) == b"page"


def test_block_without_a_head_loses_nothing(spark, tmp_path):
    raw = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: 9\r\n\r\nheadless!\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(raw)
    assert [bytes(r.payload) for r in W.read_archive(spark, f"file://{tmp_path}/a.warc").collect()] == [b"headless!"]


def test_compressed_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    W.archive(spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3), path, compression="gzip")
    assert list(tmp_path.glob("w/*.warc.gz")) and not list(tmp_path.glob("w/*.warc"))
    raw = next(tmp_path.glob("w/*.warc.gz")).read_bytes()
    import gzip

    assert gzip.decompress(raw).startswith(b"WARC/1.1\r\n")
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in W.read_pages(spark, path).collect()}
    assert got == {(i, len((h or "").encode()), "revisit" if h == BIG and i not in (3, None) else "response", 3 if h == BIG and i not in (3, None) else None) for i, _, h in PAGES}
