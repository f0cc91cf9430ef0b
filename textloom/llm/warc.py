"""WARC archives as a Spark data source.

Reading plans one partition per file, or one per stretch of records where a file is large and its writer left an
index beside it. Headers are parsed first; a record whose type or headers don't satisfy the pushed predicates,
or any record when payloads aren't asked for, is passed over by its length without reading or decoding its
block (a compressed member has to be inflated to find its end, but nothing of it is kept). Records of a compressed
archive are members of their own, so an indexed one is split like a plain one. Predicates come from
the query: =, IN, IS [NOT] NULL and LIKE 'x%' on the header columns; ``read_archive`` turns on the session's
``spark.sql.python.filterPushdown.enabled``, without which Spark refuses such a reader.

Writing makes one file a task under a name of its own and moves the files in place at commit, so that lost or
repeated tasks leave nothing behind.

A block of ``application/http`` is its head, an empty line and the payload; one without an empty line is all payload.
The option ``decode`` undoes chunked transfer and gzip or deflate content codings as the head names them; a payload
that isn't so coded after all stays as it is.

Defined results of ``archive``: null payloads are empty; a page without an id, or all of whose equals lack one,
is a response; rows that repeat the smallest id are all responses; rows without a URL have no target header;
an empty table makes an empty archive; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from textloom.llm.common import join_side, scratch_path, staged, without
from textloom.sources.io import read_table

MIN_SHARED = 100
SPLIT = 64 << 20
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "warc_date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, refers_to string, payload_digest string, content_length long, payload binary"
_ARROW = pa.schema([*[(c, pa.string()) for c in HEADERS], ("content_length", pa.int64()), ("payload", pa.binary())])
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])


def record(headers: dict[str, str | None], payload: bytes) -> bytes:
    """One record; a response or revisit carries an HTTP head before its payload."""
    http = headers.get("WARC-Type") in ("response", "revisit")
    block = (_HTTP if http else b"") + payload
    lines = ["WARC/1.1", *[f"{k}: {v.replace('%', '%25').replace(chr(13), '%0D').replace(chr(10), '%0A') if k == 'WARC-Target-URI' else v}" for k, v in headers.items() if v is not None]]
    lines += ["Content-Type: application/http; msgtype=response"] if http else []
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("no WARC record where one should begin")
    found: dict[str, str] = {}
    last = ""
    for line in lines[1:]:
        if line[:1] in (b" ", b"\t") and last:
            found[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, _, value = line.partition(b":")
        last = name.strip().lower().decode("ascii", "replace")
        found[last] = value.strip().decode("utf-8", "replace")
    return found


@dataclass
class Stretch(InputPartition):
    path: str
    begin: int = 0
    end: int | None = None


@dataclass
class Wanted:
    """Predicates on header columns: (column, operation, operand)."""

    tests: list[tuple[str, str, object]] = field(default_factory=list)

    def __call__(self, row: dict[str, str | None]) -> bool:
        for column, op, operand in self.tests:
            value = row[column]
            if op == "in" and (value is None or value not in operand):
                return False
            if op == "starts" and (value is None or not value.startswith(operand)):
                return False
            if op == "null" and (value is None) != operand:
                return False
        return True


class _Source:
    """Bytes of a file on demand, from plain records or gzip members."""

    def __init__(self, path: str, begin: int):
        system, at = _open(path)
        self.file = system.open_input_file(at)
        self.at = begin
        self.buffer = b""
        self.zip = path.endswith(".gz")
        self.inflate = None
        self.member = begin

    def _more(self, least: int = 1 << 16) -> bool:
        if not self.zip:
            self.file.seek(self.at + len(self.buffer))
            new = self.file.read(max(least, 1 << 16))
            self.buffer += new
            return bool(new)
        raw = self.inflate.unused_data if self.inflate and self.inflate.eof else b""
        begins = self.at - len(raw)
        if not raw:
            self.file.seek(self.at)
            raw = self.file.read(1 << 18)
            self.at += len(raw)
        if not raw:
            return False
        if self.inflate is None or self.inflate.eof:
            self.inflate, self.member = zlib.decompressobj(31), begins
        self.buffer += self.inflate.decompress(raw)
        return True

    def place(self) -> int:
        """Where the next record begins: in a compressed file, its member."""
        if not self.zip:
            return self.at
        if self.inflate and self.inflate.eof and not self.buffer:
            return self.at - len(self.inflate.unused_data)
        return self.member

    def head(self) -> bytes | None:
        while True:
            stop = self.buffer.find(b"\r\n\r\n")
            if stop >= 0:
                head = self.buffer[:stop]
                self._drop(stop + 4)
                return head
            if not self._more():
                if self.buffer.strip():
                    raise ValueError("an archive ends within a record")
                return None

    def _drop(self, n: int) -> None:
        self.buffer = self.buffer[n:]
        if not self.zip:
            self.at += n

    def skip(self, n: int) -> None:
        if not self.zip:
            self.buffer = self.buffer[n:]
            self.at += n
            return
        while n > len(self.buffer):
            n -= len(self.buffer)
            self.buffer = b""
            if not self._more():
                raise ValueError("an archive ends within a record")
        self._drop(n)
        if not self.buffer and not self.inflate.eof:  # the member's check sums may be still to come
            self._more()

    def block(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more(n - len(self.buffer)):
                raise ValueError("an archive ends within a record")
        found = self.buffer[:n]
        self._drop(n)
        return found


def _dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        if end + 2 + size > len(body):
            raise ValueError("a chunk that runs over the end")
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def http_payload(block: bytes, decode: bool = False) -> bytes:
    """What follows the head of an HTTP message; without a head's end, everything."""
    stop = block.find(b"\r\n\r\n")
    if stop < 0:
        return block
    body = block[stop + 4 :]
    if not decode:
        return body
    head = {k.strip().lower(): v.strip().lower() for k, _, v in (line.partition(b":") for line in block[:stop].split(b"\r\n")[1:])}
    try:
        if b"chunked" in head.get(b"transfer-encoding", b""):
            body = _dechunked(body)
        coding = head.get(b"content-encoding", b"")
        if coding in (b"gzip", b"x-gzip", b"deflate"):
            for bits in (31,) if b"gzip" in coding else (15, -15):
                try:
                    return zlib.decompress(body, bits)
                except zlib.error:
                    continue
    except ValueError:
        pass
    return body


def read_stretch(part: Stretch, wanted: Wanted, payloads: bool, decode: bool = False) -> Iterator[pa.RecordBatch]:
    source = _Source(part.path, part.begin)
    rows: list[tuple] = []
    held = 0
    while part.end is None or source.place() < part.end:
        head = source.head()
        if head is None:
            break
        headers = parse_head(head)
        length = int(headers["content-length"])
        row = {c: headers.get(h) for c, h in HEADERS.items()}
        if row["target_uri"] is not None:
            row["target_uri"] = row["target_uri"].replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
        if not wanted(row):
            source.skip(length + 4)
            continue
        payload = None
        if payloads:
            payload = source.block(length)
            source.skip(4)
            if headers.get("content-type", "").startswith("application/http"):
                payload = http_payload(payload, decode)
            held += len(payload)
        else:
            source.skip(length + 4)
        rows.append((*row.values(), length, payload))
        if len(rows) >= 5000 or held > 16 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payloads = options.get("payloads", "true").lower() == "true"
        self.decode = options.get("decode", "false").lower() == "true"
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT)))
        self.wanted = Wanted()

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in HEADERS:
                yield f
            elif isinstance(f, (EqualTo, EqualNullSafe)) and f.value is not None:
                self.wanted.tests.append((column, "in", [f.value]))
            elif isinstance(f, In):
                self.wanted.tests.append((column, "in", list(f.value)))
            elif isinstance(f, StringStartsWith):
                self.wanted.tests.append((column, "starts", f.value))
            elif isinstance(f, IsNull):
                self.wanted.tests.append((column, "null", True))
            elif isinstance(f, IsNotNull):
                self.wanted.tests.append((column, "null", False))
            else:
                yield f

    def partitions(self):
        system, root = _open(self.path)
        info = system.get_file_info(root)
        files = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(root, recursive=True))
        prefix = self.path[: -len(root)] if self.path.endswith(root) else ""
        files = sorted((f for f in files if f.type == pafs.FileType.File and f.path.endswith((".warc", ".warc.gz")) and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)
        if info.type == pafs.FileType.File:
            around = system.get_file_info([root + ".idx"])
        else:
            around = system.get_file_info(pafs.FileSelector(root, recursive=True))
        indexed = {f.path for f in around if f.type == pafs.FileType.File}
        parts = []
        for f in files:
            cuts = [0]
            if f.size > self.split and f.path + ".idx" in indexed:
                with system.open_input_stream(f.path + ".idx", compression=None) as marks:
                    for mark in json.loads(marks.read()):
                        if mark - cuts[-1] >= self.split:
                            cuts.append(mark)
            parts += [Stretch(prefix + f.path, a, b) for a, b in zip(cuts, [*cuts[1:], None], strict=True)]
        return parts or [Stretch("")]

    def read(self, partition):
        if partition.path:
            yield from read_stretch(partition, self.wanted, self.payloads, self.decode)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.zip = options.get("compression", "none") == "gzip"
        self.mark = int(options.get("indexbytes", options.get("indexBytes", SPLIT // 4)))

    def write(self, iterator):
        name = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.zip
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        marks, at, last, out = [], 0, 0, None
        for batch in iterator:
            if out is None and batch.num_rows:
                out = system.open_output_stream(f"{root}/.{name}", compression=None)  # the members are compressed already
            for row in batch.to_pylist():
                raw = record(
                    {
                        "WARC-Type": row["record_type"], "WARC-Record-ID": row["record_id"], "WARC-Date": row["warc_date"], "WARC-Target-URI": row["target_uri"],
                        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if row["record_type"] == "revisit" else None,
                        "WARC-Refers-To": row["refers_to"], "WARC-Payload-Digest": row["payload_digest"],
                    },
                    row["payload"] or b"",
                )
                if self.zip:
                    deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
                    raw = deflate.compress(raw) + deflate.flush()
                if at - last >= self.mark:
                    marks.append(at)
                    last = at
                out.write(raw)
                at += len(raw)
        if out is None:
            return Written([])
        out.close()
        with system.open_output_stream(f"{root}/.{name}.idx", compression=None) as index:
            index.write(json.dumps(marks).encode())
        return Written([(f"{root}/.{name}", f"{root}/{name}"), (f"{root}/.{name}.idx", f"{root}/{name}.idx")])

    def commit(self, messages):
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        for message in messages:
            for a, b in message.files if message else []:
                system.move(a, b)

    def abort(self, messages):
        system, _ = _open(self.path)
        for message in messages:
            for a, _b in message.files if message else []:
                system.delete_file(a)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def read_archive(spark: SparkSession, path: str, record_types: tuple[str, ...] = (), payloads: bool = True, decode: bool = False) -> DataFrame:
    """The records of an archive; types not asked for are passed over at their headers."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # a reader with predicates can't be planned otherwise
    found = spark.read.format("warc").option("payloads", str(payloads).lower()).option("decode", str(decode).lower()).load(path)
    return found.where(F.col("record_type").isin(*record_types)) if record_types else found


def archive(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", min_shared: int = MIN_SHARED, compression: str = "none", **split: int) -> None:
    """Writes (page_id, url, html): of equal payloads of at least ``min_shared`` bytes the smallest id is the response, the others revisit it.

    Ids, URLs and digests alone are shuffled to find the equal payloads, and revisit records come from these. Payloads
    go straight to the writer from where they are read, but for the few that two Bloom filters of bounded size can't
    tell (see ``common.without``).
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    marked = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    long_ones = staged(marked.where((F.octet_length("payload") >= min_shared) & F.col("page_id").isNotNull()).select("digest", "page_id", "url"), "digests")
    firsts = long_ones.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("last <> first").drop("last")
    revisits = staged(long_ones.join(firsts.hint("shuffle_hash"), "digest").where("page_id <> first"), "revisits")
    chosen = staged(revisits.select("digest", "page_id").distinct(), "revisit-keys")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))

    def records(rows: DataFrame, kind: str) -> DataFrame:
        again = kind == "revisit"
        return rows.select(
            urn(F.col("page_id")).alias("record_id"),
            F.lit(kind).alias("record_type"),
            F.col("url").alias("target_uri"),
            F.lit(date).alias("warc_date"),
            (urn(F.col("first")) if again else F.lit(None).cast("string")).alias("refers_to"),
            F.concat(F.lit("sha256:"), F.col("digest")).alias("payload_digest"),
            F.lit(0).cast("long").alias("content_length"),
            (F.lit(None).cast("binary") if again else F.col("payload")).alias("payload"),
        )

    responses = marked if chosen.isEmpty() else without(marked, ["digest", "page_id"], chosen, long_ones, **split)
    everything = records(responses, "response").unionByName(records(revisits, "revisit"))
    everything.write.format("warc").option("compression", compression).mode("append").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): responses from their payloads as read back, revisits by the response they refer to."""
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]*)>$", 1).try_cast("long")
    responses = staged(read_archive(spark, path, ("response",)).select(number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")), "responses")
    revisits = read_archive(spark, path, ("revisit",), payloads=False).select(number("record_id").alias("page_id"), number("refers_to").alias("refers_to"), F.substring("payload_digest", 8, 64).alias("claimed"))
    # only what is referred to, which is little where few pages have many copies: then the copies aren't shuffled at all
    referred = revisits.select("refers_to", F.col("claimed").alias("payload_digest")).distinct()
    first = responses.select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").distinct().join(referred.hint("shuffle_hash"), ["refers_to", "payload_digest"], "left_semi")
    first = join_side(staged(first, "referred"), 160)
    resolved = revisits.join(first, (revisits["refers_to"] == first["refers_to"]) & (revisits["claimed"] == first["payload_digest"]))
    resolved = resolved.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), revisits["refers_to"])
    return responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(resolved)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    archive(read_table(spark, f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    return read_pages(spark, path)


QUERIES = {"op4_warc": op4_warc}
SQL = {
    "op4_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
}
