import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import matroska as M


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=300), st.integers(1, 400))
def test_round_trip(unit, times):
    payload = unit * times
    file = M.write(payload)
    media = M.parse(file)
    assert b"".join(file[p[4] : p[4] + p[5]] for p in media.packets) == payload
    assert [c[2] for c in media.cues] == media.clusters
    assert media.duration == pytest.approx(len(payload) / 8)
    for track, ns, each, key, offset, size, _ in media.packets:
        assert track == 1 and key and each == 64_000_000 and ns % 64_000_000 == 0
    assert [p[1] for p in media.packets] == [i * 64_000_000 for i in range(len(media.packets))]


def file(blocks, unknown=False):
    tracks = M._element(M.TRACKS, M._element(M.ENTRY, M._number(M.NUMBER, 2) + M._number(M.KIND, 1) + M._element(M.CODEC, b"V_TEST")))
    body = M._number(M.TIME, 100) + blocks
    size = (lambda b: b"\x01" + b"\xff" * 7 + b) if unknown else (lambda b: M._size(len(b)) + b)
    cluster = struct.pack(">I", M.CLUSTER) + size(body)
    return M._HEAD + struct.pack(">I", M.SEGMENT) + size(tracks + M._element(0xEC, b"void") + cluster + cluster)


@pytest.mark.parametrize("unknown", [False, True])
def test_lacing_kinds_groups_and_unknown_sizes(unknown):
    frames = [b"a" * 3, b"b" * 300, b"c" * 260, b"d" * 5]
    xiph = b"\x82\xff\xfe\x82" + bytes([3]) + bytes([3]) + bytes([255, 45]) + bytes([255, 5]) + b"".join(frames)
    ebml = b"\x82\x00\x07\x06" + bytes([3]) + b"\x83" + (297 + 8191 | 0x4000).to_bytes(2, "big") + (-40 + 63 | 0x80).to_bytes(1, "big") + b"".join(frames)
    fixed = b"\x82\x00\x00\x04\x01" + b"xxyy"
    group = M._element(M.GROUP, M._element(M.BLOCK, b"\x82\x00\x09\x00zzz") + M._number(M.BLOCK_DURATION, 40) + M._element(M.REFERENCE, b"\xff"))
    raw = file(M._element(M.SIMPLE, xiph) + M._element(M.SIMPLE, ebml) + M._element(M.SIMPLE, fixed) + group, unknown)
    media = M.parse(raw)
    got = [(raw[p[4] : p[4] + p[5]], p[1] // 10**6, p[3], p[6]) for p in media.packets]
    one = [*[(f, 98, True, 1) for f in frames], *[(f, 107, False, 3) for f in frames], (b"xx", 100, False, 2), (b"yy", 100, False, 2), (b"zzz", 109, False, 0)]
    assert got == one * 2
    assert media.packets[-1][2] == 40_000_000 and media.tracks[2]["codec"] == "V_TEST"


def test_no_file():
    with pytest.raises(ValueError):
        M.parse(b"RIFF")


def test_query_columns(spark):
    texts = [None, "", "x" * 64, "é" * 5000, "a", "a"]
    docs = spark.createDataFrame([(i, t, "f", 3) for i, t in enumerate(texts)], "doc_id long, text string, feature string, media_bytes int")
    rows = {r.doc_id: r for r in M.store_and_read(docs).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        pad = raw + bytes(64 if not raw else -len(raw) % 64)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        assert r.media_sha256 == hashlib.sha256(M.write(pad)).hexdigest() and r.media_bytes == len(M.write(pad))
    assert rows[4].feature == rows[5].feature and rows[0].feature == rows[1].feature
    files = M.to_media(docs)
    packets = M.packet_table(files)
    assert packets.groupBy("doc_id").sum("size").count() == 6
    assert M.packet_table(spark.createDataFrame([(1, None), (2, bytearray(b"junk"))], "doc_id long, media binary")).count() == 0
    assert M.store_and_read(docs.limit(0)).count() == 0


def test_damaged_files_give_what_was_read():
    import random

    rng = random.Random(3)
    whole = M.write(bytes(range(256)) * 40)
    full = M.parse(whole).packets
    for cut in range(4, len(whole), 7):
        part = M.parse(whole[:cut], strict=False).packets
        assert all(p[4] + p[5] <= cut for p in part) and part[:-8] == full[: max(0, len(part) - 8)]
    lace = file(M._element(M.SIMPLE, b"\x81\x00\x00\x02\x02\xff\xff"))
    for raw in (whole, lace, file(M._element(M.SIMPLE, b"\x81\x00\x00\x06\x03\x81"), True)):
        for _ in range(400):
            hurt = bytearray(raw)
            for _ in range(rng.randrange(1, 4)):
                hurt[rng.randrange(4, len(hurt))] = rng.randrange(256)
            M.parse(bytes(hurt), strict=False)
    assert M.parse(lace, strict=False).error
    for many in (b"\x18\x53\x80\x67\xff", b"\x1f\x43\xb6\x75\xff", b"\xa0\xff"):  # elements of unknown size in one another
        assert not M.parse(b"\x1a\x45\xdf\xa3\x80\x18\x53\x80\x67\xff" + many * 2000, strict=False).packets
    with pytest.raises(ValueError):
        M.parse(lace)


def test_damaged_files_and_many_clusters_in_a_job(spark):
    long_text = "abcdefgh" * 20_000
    docs = spark.createDataFrame([(1, long_text), (2, "short")], "doc_id long, text string")
    rows = {r.doc_id: r for r in M.store_and_read(docs).collect()}
    assert rows[1].payload_bytes == len(long_text) and rows[1].payload_sha256 == hashlib.sha256(long_text.encode()).hexdigest()
    assert len(M.parse(M.write(long_text.encode())).clusters) > 4
    whole = M.write(b"x" * 64)
    hurt = file(M._element(M.SIMPLE, b"\x81\x00\x00\x80ok") + M._element(M.SIMPLE, b"\x81\x00\x00\x02\x02\xff\xff"))
    files = spark.createDataFrame([(1, bytearray(whole), 7), (2, bytearray(hurt), 7), (3, bytearray(whole[:4] + b"\x00\x00"), 7), (4, None, 7)], "doc_id long, media binary, error int")
    got = [(r.doc_id, r.packet, r.size, r.error is not None) for r in M.packet_table(files).orderBy("doc_id").collect()]
    assert got[0] == (1, 0, 64, False) and got[1][:2] == (2, 0) and got[1][3] and got[-1] == (3, None, None, True)
