"""Media columns in Matroska: a writer for raw sample streams and a parser into packet tables.

The parser reads variable-length EBML elements (unknown sizes too), walks segment, tracks, clusters and cues, takes
simple blocks and block groups apart by any of the three kinds of lacing, and yields a packet per frame with
track, timestamp, key flag and byte range in the file; payloads stay where they are until someone slices them.

The writer stores bytes as 8-bit mono PCM: frames of ``FRAME`` samples, up to ``LACED`` of them in a block with
fixed-size lacing (EBML lacing where the last is shorter), clusters of ``BLOCKS`` blocks, a cue per cluster.

Defined results: a null text is stored like an empty one, 64 zero bytes; equal texts give equal files; repeated
rows are answered alike; an element that runs over the end of the file ends with it. A damaged file gives what was
read of it and says why no more (``Media.error``): in ``packet_table`` its packets carry the error, and one that has
no packets gets one row of nulls with it. Bytes that are no EBML file raise ``ValueError`` in ``parse`` and give no
rows in ``packet_table``, nor do null media. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.sources.io import read_table

RATE, FRAME, LACED, BLOCKS, UNIT = 8000, 512, 8, 8, 64

EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SCALE, DURATION, ENTRY, NUMBER, KIND, CODEC, AUDIO, FREQUENCY, CHANNELS, DEPTH, DEFAULT_DURATION = 0x2AD7B1, 0x4489, 0xAE, 0xD7, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
TIME, SIMPLE, GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_PLACES, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
_MASTERS = {SEGMENT, INFO, TRACKS, ENTRY, AUDIO, CLUSTER, GROUP, CUES, CUE_POINT, CUE_PLACES}
#: What ends a segment or cluster of unknown size: an element of a higher level.
_TOP = {EBML, SEGMENT}
_LEVEL_1 = {0x114D9B74, INFO, TRACKS, CLUSTER, CUES, 0x1043A770, 0x1941A469, 0x1254C367}


def _size(n: int) -> bytes:
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _number(ident: int, n: int) -> bytes:
    return _element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _block(frames: list[bytes], relative: int) -> bytes:
    head = b"\x81" + struct.pack(">h", relative)
    if len(frames) == 1:
        return head + b"\x80" + frames[0]
    if len({len(f) for f in frames}) == 1:
        return head + b"\x84" + bytes([len(frames) - 1]) + b"".join(frames)
    sizes = _size(len(frames[0]))
    for a, b in zip(frames, frames[1:-1], strict=False):
        delta, width = len(b) - len(a), 1
        while not -(1 << (7 * width - 1)) < delta < 1 << (7 * width - 1):
            width += 1
        sizes += (delta + (1 << (7 * width - 1)) - 1 | 1 << 7 * width).to_bytes(width, "big")
    return head + b"\x86" + bytes([len(frames) - 1]) + sizes + b"".join(frames)


_HEAD = _element(EBML, _number(0x4286, 1) + _number(0x42F7, 1) + _number(0x42F2, 4) + _number(0x42F3, 8) + _element(0x4282, b"matroska") + _number(0x4287, 4) + _number(0x4285, 2))
_TRACKS = _element(
    TRACKS,
    _element(
        ENTRY,
        _number(NUMBER, 1) + _number(0x73C5, 1) + _number(KIND, 2) + _element(CODEC, b"A_PCM/INT/LIT") + _number(DEFAULT_DURATION, FRAME * 10**9 // RATE)
        + _element(AUDIO, _element(FREQUENCY, struct.pack(">d", RATE)) + _number(CHANNELS, 1) + _number(DEPTH, 8)),
    ),
)


def write(payload: bytes) -> bytes:
    """A Matroska file whose one track has the bytes as 8-bit samples."""
    info = _element(INFO, _number(SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + _element(0x4D80, b"textloom") + _element(0x5741, b"textloom"))
    parts, cues, at = [info, _TRACKS], [], len(info) + len(_TRACKS)
    step = FRAME * LACED
    for start in range(0, len(payload), step * BLOCKS):
        stop = min(len(payload), start + step * BLOCKS)
        begin = start * 1000 // RATE
        blocks = [_number(TIME, begin)]
        for b in range(start, stop, step):
            frames = [payload[f : min(f + FRAME, stop)] for f in range(b, min(b + step, stop), FRAME)]
            blocks.append(_element(SIMPLE, _block(frames, b * 1000 // RATE - begin)))
        cluster = _element(CLUSTER, b"".join(blocks))
        cues.append(_element(CUE_POINT, _number(CUE_TIME, begin) + _element(CUE_PLACES, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(_element(CUES, b"".join(cues)))
    return _HEAD + _element(SEGMENT, b"".join(parts))


@dataclass
class Media:
    """What a file holds; packets are (track, nanoseconds, duration, key, offset, size, lacing)."""

    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, bool, int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    segment: int = 0
    #: Why the rest of a damaged file wasn't read.
    error: str | None = None


class Damaged(ValueError):
    """Bytes that aren't what a Matroska file has at their place."""


def _vint(raw: bytes, at: int) -> tuple[int, int, bool]:
    """Value without its marker, next place, whether all its bits are ones (unknown)."""
    if at >= len(raw):
        raise Damaged("the file ends within a number")
    first = raw[at]
    width = 9 - first.bit_length()
    if width > 8:
        raise Damaged("an element size that is longer than eight bytes")
    if at + width > len(raw):
        raise Damaged("the file ends within a number")
    value = int.from_bytes(raw[at : at + width], "big") & (1 << 7 * width) - 1
    return value, at + width, value == (1 << 7 * width) - 1


def elements(raw: bytes, at: int, stop: int) -> Iterator[tuple[int, int, int, int, bool]]:
    """Children in a range: (id, where its id begins, body, end, whether the size is unknown)."""
    while at < stop:
        first = raw[at]
        width = 9 - first.bit_length()
        if width > 4:
            raise Damaged("no element where one should begin")
        ident = int.from_bytes(raw[at : at + width], "big")
        if at + width >= stop:
            return
        size, body, unknown = _vint(raw, at + width)
        end = stop if unknown else min(stop, body + size)
        yield ident, at, body, end, unknown
        if unknown:  # its children tell where it ends
            end = _end_of_unknown(raw, ident, body, stop)
        at = end


def _end_of_unknown(raw: bytes, ident: int, at: int, stop: int) -> int:
    enders = _TOP if ident == SEGMENT else _TOP | _LEVEL_1
    for child, begin, _, _, _ in elements(raw, at, stop):
        if child in enders:
            return begin
    return stop


def _uint(raw: bytes, at: int, end: int) -> int:
    if end - at > 8:
        raise Damaged("a number of more than eight bytes")
    return int.from_bytes(raw[at:end], "big")


def _float(raw: bytes, at: int, end: int) -> float:
    if end - at not in (0, 4, 8):
        raise Damaged("a float of another size than four or eight bytes")
    return struct.unpack(">f" if end - at == 4 else ">d", raw[at:end])[0] if end > at else 0.0


def lace(raw: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames in a block's body: 0 no lacing, 1 Xiph, 2 fixed size, 3 EBML."""
    if kind == 0:
        return [(at, end - at)]
    if at >= end:
        raise Damaged("a block that ends before its lacing")
    count = raw[at] + 1
    at += 1
    if kind == 2:
        each = (end - at) // count
        return [(at + i * each, each) for i in range(count)]
    sizes: list[int] = []
    for i in range(count - 1):
        if kind == 1:
            total = 0
            while at < end and raw[at] == 255:
                total, at = total + 255, at + 1
            if at >= end:
                raise Damaged("lacing that ends within a size")
            sizes.append(total + raw[at])
            at += 1
        elif i == 0:
            value, at, _ = _vint(raw, at)
            sizes.append(value)
        else:
            before = at
            value, at, _ = _vint(raw, at)
            sizes.append(sizes[-1] + value - ((1 << 7 * (at - before) - 1) - 1))
    sizes.append(end - at - sum(sizes))
    out = []
    for size in sizes:
        if size < 0 or at + size > end:
            raise Damaged("laced frames that don't fit their block")
        out.append((at, size))
        at += size
    return out


def parse(raw: bytes, strict: bool = True) -> Media:
    """Packet table and tables of tracks, clusters and cues of a file; without ``strict``, damage ends it with an error instead of an exception."""
    media = Media()
    try:
        _walk(raw, media)
    except RecursionError:
        media.error = "elements without a size in one another, too deep"
    except Damaged as damage:
        media.error = str(damage)
    if strict and media.error:
        raise Damaged(media.error)
    return media


def _walk(raw: bytes, media: Media) -> None:
    if raw[:4] != b"\x1a\x45\xdf\xa3":
        raise Damaged("no EBML header")

    def block(body: int, end: int, cluster_time: int, key: bool | None, duration: int | None) -> None:
        track, at, _ = _vint(raw, body)
        if at + 3 > end:
            raise Damaged("a block that ends within its head")
        relative = struct.unpack_from(">h", raw, at)[0]
        flags = raw[at + 2]
        kind = flags >> 1 & 3
        frames = lace(raw, at + 3, end, kind)
        each = media.tracks.get(track, {}).get("default_duration", 0)
        if duration is not None:
            each = duration * media.scale // len(frames)
        start = (cluster_time + relative) * media.scale
        if not -(1 << 62) < start < 1 << 62 or not 0 <= each * len(frames) < 1 << 62:
            raise Damaged("a time that is no 64-bit number")
        is_key = bool(flags & 0x80) if key is None else key
        for i, (offset, size) in enumerate(frames):
            media.packets.append((track, start + i * each, each, is_key, offset, size, kind))

    def cluster(body: int, end: int) -> None:
        time = 0
        for ident, _, a, b, _ in elements(raw, body, end):
            if ident == TIME:
                time = _uint(raw, a, b)
            elif ident == SIMPLE:
                block(a, b, time, None, None)
            elif ident == GROUP:
                found, duration, key = None, None, True
                for child, _, x, y, _ in elements(raw, a, b):
                    if child == BLOCK:
                        found = (x, y)
                    elif child == BLOCK_DURATION:
                        duration = _uint(raw, x, y)
                    elif child == REFERENCE:
                        key = False
                if found:
                    block(*found, time, key, duration)

    def track(body: int, end: int) -> None:
        entry: dict = {}
        for ident, _, a, b, _ in elements(raw, body, end):
            if ident == NUMBER:
                entry["number"] = _uint(raw, a, b)
            elif ident == KIND:
                entry["kind"] = _uint(raw, a, b)
            elif ident == CODEC:
                entry["codec"] = raw[a:b].rstrip(b"\0").decode("ascii", "replace")
            elif ident == DEFAULT_DURATION:
                entry["default_duration"] = _uint(raw, a, b)
            elif ident == AUDIO:
                for child, _, x, y, _ in elements(raw, a, b):
                    if child == FREQUENCY:
                        entry["rate"] = _float(raw, x, y)
                    elif child in (CHANNELS, DEPTH):
                        entry["channels" if child == CHANNELS else "depth"] = _uint(raw, x, y)
        media.tracks[entry.get("number", 0)] = entry

    for top, _, body, end, unknown in elements(raw, 0, len(raw)):
        if top != SEGMENT:
            continue
        media.segment = body
        stop = _end_of_unknown(raw, SEGMENT, body, end) if unknown else end
        for ident, begin, a, b, open_ended in elements(raw, body, stop):
            if ident == INFO:
                for child, _, x, y, _ in elements(raw, a, b):
                    if child == SCALE:
                        media.scale = _uint(raw, x, y)
                    elif child == DURATION:
                        media.duration = _float(raw, x, y)
            elif ident == TRACKS:
                for child, _, x, y, _ in elements(raw, a, b):
                    if child == ENTRY:
                        track(x, y)
            elif ident == CLUSTER:
                media.clusters.append(begin)
                cluster(a, _end_of_unknown(raw, CLUSTER, a, b) if open_ended else b)
            elif ident == CUES:
                for child, _, x, y, _ in elements(raw, a, b):
                    if child != CUE_POINT:
                        continue
                    time, places = 0, []
                    for c, _, p, q, _ in elements(raw, x, y):
                        if c == CUE_TIME:
                            time = _uint(raw, p, q)
                        elif c == CUE_PLACES:
                            place = {k: _uint(raw, s, e) for k, _, s, e, _ in elements(raw, p, q) if k in (CUE_TRACK, CUE_CLUSTER)}
                            places.append((place.get(CUE_TRACK, 0), place.get(CUE_CLUSTER, 0)))
                    media.cues += [(time * media.scale, t, media.segment + at) for t, at in places]


def padded(text: str | None) -> tuple[bytes, int]:
    """The text's bytes with zeros up to a positive multiple of ``UNIT``, and how many there were."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes((-len(raw) % UNIT) or (0 if raw else UNIT)), len(raw)


def describe(media: Media, payload: bytes) -> str:
    """Counts of packets, clusters and cues that point at clusters, duration, loudness: a line of text."""
    samples = np.frombuffer(payload, np.uint8)
    clusters = set(media.clusters)
    good = sum(at in clusters for _, _, at in media.cues)
    last = media.packets[-1]
    total, square = int(samples.sum(dtype=np.int64)), int((samples.astype(np.uint16) ** 2).sum(dtype=np.int64))
    mean = total / len(samples)
    codec = media.tracks[last[0]].get("codec", "")
    return f"codec={codec} packets={len(media.packets)} laced={sum(p[6] > 0 for p in media.packets)} clusters={len(clusters)} cues={good} last_ns={last[1]} mean={mean:.4f} power={square / len(samples):.4f}"


def _store_and_read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            payload, n = padded(text.as_py())
            stored = write(payload)
            media = parse(stored)
            back = b"".join([stored[p[4] : p[4] + p[5]] for p in media.packets])
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), describe(media, back)))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)


def store_and_read(docs: DataFrame) -> DataFrame:
    """Per document its text's way through a file and back: sizes, digests, and features of what was read."""
    return docs.select("doc_id", "text").mapInArrow(_store_and_read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, media): the texts as files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([write(padded(t.as_py())[0]) for t in batch.column("text")], pa.binary())], ["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, media binary")


def packet_table(files: DataFrame) -> DataFrame:
    """Of (doc_id, media) a row per packet: track, timestamp, duration, key flag, byte range and lacing, and the file's error where it is damaged."""
    schema = "doc_id long, packet int, track long, timestamp_ns long, duration_ns long, key boolean, offset long, size long, lacing int, error string"
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    names = ["doc_id", "packet", "track", "timestamp_ns", "duration_ns", "key", "offset", "size", "lacing", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, file in zip(batch.column("doc_id").to_pylist(), batch.column("media"), strict=True):
                raw = file.as_py()
                if raw is None or raw[:4] != _HEAD[:4]:
                    continue
                media = parse(raw, strict=False)
                rows += [(doc, i, *p, media.error) for i, p in enumerate(media.packets)]
                if media.error and not media.packets:
                    rows.append((doc, *[None] * 8, media.error))
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return files.select("doc_id", "media").mapInArrow(run, schema)


def op6_matroska(spark, sf_dir: str) -> DataFrame:
    return store_and_read(read_table(spark, f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_matroska": op6_matroska}
SQL: dict[str, str] = {}
