"""WARC archives as a Spark data source, and pages written with revisit records.

    spark.dataSource.register(WarcSource)
    spark.read.format("warc").option("path", folder).load().filter("record_type = 'response'")

Reading plans partitions of whole files and of byte ranges of large ones. Header predicates
(equality, IN, IS NOT NULL on header columns) are pushed down and decided on the headers, before
a payload is touched; rejected payloads are skipped, not decoded. Each record is a gzip member of
its own or plain; a range starts at the first record whose offset lies in it.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from .common import work_path

#: WARC header of every column that predicates can use
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "record_date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "X-Payload-Length",
    "profile": "WARC-Profile",
    "content_type": "Content-Type",
}
SCHEMA = ", ".join([f"{c} string" for c in HEADERS]) + ", content_length long, payload binary"
MANIFEST = "_warc_manifest.json"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 16
_MARK = b"WARC/1."


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:/") else f"file://{path}")


@dataclass
class Range(InputPartition):
    """Records of a file whose first byte lies in [start, end)."""

    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcSource(DataSource):
    """Options: path; split (bytes of a partition, default 64 MB); payload (false: headers only); for writing, roll (bytes of a file)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options, [f.name for f in schema.fields])

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, [f.name for f in schema.fields])


class WarcReader(DataSourceReader):
    def __init__(self, options, columns: list[str]):
        self.path = options["path"]
        self.split = int(options.get("split", 64 << 20))
        self.payload = options.get("payload", "true").lower() != "false"
        self.columns = columns
        self.wanted: list[tuple[str, object]] = []

    def pushFilters(self, filters) -> Iterator:
        """Take what the headers can decide; hand the rest back."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in HEADERS:
                yield f
            elif isinstance(f, EqualTo):
                self.wanted.append((name, (f.value,)))
            elif isinstance(f, In):
                self.wanted.append((name, tuple(f.value)))
            elif isinstance(f, IsNotNull):
                self.wanted.append((name, None))
            else:
                yield f

    def partitions(self) -> list[Range]:
        files, root = _open(self.path)
        listed = f"{root}/{MANIFEST}"
        if files.get_file_info(listed).type == pafs.FileType.File:  # only what was committed
            with files.open_input_stream(listed) as f:
                found = [(f"{root}/{n}", size) for n, size in json.loads(f.read())]
        else:
            info = files.get_file_info(pafs.FileSelector(root, recursive=True)) if files.get_file_info(root).type == pafs.FileType.Directory else [files.get_file_info(root)]
            found = [(i.path, i.size) for i in info if i.path.endswith((".warc", ".warc.gz"))]
        scheme = self.path.split("://")[0] if "://" in self.path else "file"
        ranges = [Range(p, a, min(a + self.split, size)) for p, size in found for a in range(0, size, self.split)]
        return [Range(r.path if scheme == "file" else self.path.split("://")[0] + "://" + r.path, r.start, r.end) for r in ranges]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files, so no ranges
            return
        kinds = {"content_length": pa.int64(), "payload": pa.binary()}
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in self.columns], self.columns)

        for r in records(partition, self._accepts, self.payload):
            rows.append(r)
            held += len(r["payload"] or b"")
            if len(rows) >= 4096 or held >= 8 << 20:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()

    def _accepts(self, row: dict) -> bool:
        return all(row[n] is not None and (values is None or row[n] in values) for n, values in self.wanted)


class _Stream:
    """The decoded bytes of a file from a place on; knows where the gzip member begins that it reads."""

    def __init__(self, source, at: int, gz: bool):
        self.source, self.gz, self.buf = source, gz, b""
        self.member = self.at = at  # of the next raw byte
        self.raw = b""
        self.inflate = zlib.decompressobj(31) if gz else None
        source.seek(at)

    def _more(self) -> bool:
        if not self.gz:
            data = self.source.read(_CHUNK)
            self.at += len(data)
            self.buf += data
            return bool(data)
        if not self.raw:
            self.raw = self.source.read(_CHUNK)
            self.at += len(self.raw)
        if not self.raw:
            return False
        self.buf += self.inflate.decompress(self.raw, _CHUNK)
        self.raw = self.inflate.unconsumed_tail
        if self.inflate.eof:
            self.raw = self.inflate.unused_data
            self.inflate = None
        return True

    def begin(self) -> int | None:
        """Offset of the record that starts here, or None at the end."""
        if self.gz and self.inflate is None:
            if not self.raw:
                self.raw = self.source.read(_CHUNK)
                self.at += len(self.raw)
            if not self.raw:
                return None
            self.inflate = zlib.decompressobj(31)
        place = self.at - len(self.raw) - (0 if self.gz else len(self.buf))
        while len(self.buf) < len(_MARK):
            if not self._step():
                return None
        return place

    def _step(self) -> bool:
        return not (self.gz and self.inflate is None) and self._more()

    def head(self) -> bytes:
        seen = 0
        while (end := self.buf.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.buf)
            if not self._step():
                raise ValueError("a WARC header is cut off")
        out, self.buf = self.buf[:end], self.buf[end + 4 :]
        return out

    def body(self, n: int) -> bytes:
        parts, have = [], 0
        while have + len(self.buf) < n:
            parts.append(self.buf)
            have += len(self.buf)
            self.buf = b""
            if not self._step():
                raise ValueError("a WARC block is cut off")
        parts.append(self.buf[: n - have])
        self.buf = self.buf[n - have :]
        return b"".join(parts)

    def skip(self, n: int) -> None:
        """Pass over a block: plain bytes by seeking, members by inflating only to find their end."""
        if not self.gz and len(self.buf) < n:
            self.at += n - len(self.buf)
            self.source.seek(self.at)
            self.buf = b""
            return
        while n > len(self.buf):
            n -= len(self.buf)
            self.buf = b""
            if not self._step():
                raise ValueError("a WARC block is cut off")
        self.buf = self.buf[n:]

    def finish(self) -> None:
        """To the start of the next record."""
        if self.gz:
            while self.inflate is not None and self._more():
                self.buf = b""
            self.buf = b""
            return
        while True:
            self.buf = self.buf.lstrip(b"\r\n")
            if self.buf or not self._more():
                return


def _starts(source, part: Range, gz: bool) -> int | None:
    """Offset of the first record at or after the range's start, if it lies in the range."""
    if part.start == 0:
        return 0
    mark = b"\x1f\x8b\x08" if gz else b"\r\n\r\n" + _MARK
    at, kept = max(0, part.start - (0 if gz else 4)), b""
    source.seek(at)
    while at < part.end:
        data = kept + source.read(_CHUNK)
        if len(data) == len(kept):
            return None
        k = data.find(mark)
        while k >= 0:
            place = at + k
            if place >= part.end:
                return None
            if _is_record(source, place if gz else place + 4, gz):
                return place if gz else place + 4
            k = data.find(mark, k + 1)
        kept = data[-(len(mark) - 1) :]
        source.seek(at + len(data))
        at += len(data) - len(kept)
    return None


def _is_record(source, place: int, gz: bool) -> bool:
    """Whether a record begins here and its successor is where its length says: payloads may hold the same bytes."""
    source.seek(place)
    try:
        if not gz:
            stream = _Stream(source, place, False)
            stream.begin()
            fields = _fields(stream.head())
            if "warc-record-id" not in fields:
                return False
            stream.skip(int(fields["content-length"]))
            return stream.body(4) == b"\r\n\r\n"
        return zlib.decompressobj(31).decompress(source.read(1 << 12), len(_MARK)) == _MARK
    except (zlib.error, ValueError, KeyError):
        return False


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def records(part: Range, accepts, payload: bool) -> Iterator[dict]:
    """Rows of the records that begin in the range: headers first, the block only of accepted ones."""
    files, path = _open(part.path)
    gz = path.endswith(".gz")
    with files.open_input_file(path) as source:
        first = _starts(source, part, gz)
        if first is None:
            return
        stream = _Stream(source, first, gz)
        while (at := stream.begin()) is not None and at < part.end:
            fields = _fields(stream.head())
            row = {c: fields.get(h.lower()) for c, h in HEADERS.items()}
            size = int(fields.get("content-length", 0))
            row["content_length"], row["payload"] = size, None
            if not accepts(row):
                stream.skip(size)
            else:
                if payload:
                    row["payload"] = stream.body(size)
                else:
                    stream.skip(size)
                yield row
            stream.finish()


class WarcWriter(DataSourceArrowWriter):
    """Writes rows with columns named as in SCHEMA; files appear in the manifest only when the job commits, so a task that was lost leaves nothing that is read."""

    def __init__(self, options, columns: list[str]):
        self.path, self.columns = options["path"], columns
        self.roll = int(options.get("roll", 256 << 20))
        self.gz = options.get("compression", "gzip") == "gzip"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        done, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                data = encode(row, self.gz)
                if out is not None and size + len(data) > self.roll:
                    out.close()
                    out = None
                    done[-1][1] = size
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gz
                    out, size = files.open_output_stream(f"{root}/{name}", compression=None), 0
                    done.append([name, 0])
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            done[-1][1] = size
        return Written(done)

    def commit(self, messages: list) -> None:
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/{MANIFEST}", compression=None) as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())

    def abort(self, messages: list) -> None:
        files, root = _open(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                files.delete_file(f"{root}/{name}")


def encode(row: dict, gz: bool) -> bytes:
    block = row.get("payload") or b""
    head = ["WARC/1.1"] + [f"{h}: {row[c]}" for c, h in HEADERS.items() if row.get(c) is not None]
    data = "\r\n".join([*head, f"Content-Length: {len(block)}"]).replace("\0", "").encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    if not gz:
        return data
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """One WARC row per page: of equal payloads of at least least_bytes, the smallest id is response and the others revisit it.

    A null html is an empty payload. Rows that share the smallest id of equal payloads are all
    response. Rows without an id come last: they revisit a response that has one, and are response
    where none has. Urls lose line breaks, which headers cannot hold. The digest decides equality.
    A digest that a third of all pages have is counted map-side; the join back splits it.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.regexp_replace(F.col(url_col).cast("string"), r"[\r\n\x00]+", " ").alias("target_uri"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumns({"digest": F.sha2("payload", 256), "n": F.octet_length("payload")})
    firsts = rows.filter(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("k")).filter("k > 1 AND first IS NOT NULL").select("digest", "first")
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return rows.join(firsts, "digest", "left").select(
        F.coalesce(urn(F.col("id")), F.lit("<urn:page:>")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.lit("1970-01-01T00:00:00Z").alias("record_date"),
        F.when(again, urn(F.col("first"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.col("n").cast("string").alias("payload_length"),
        F.when(again, F.lit(REVISIT)).alias("profile"),
        F.lit("text/html").alias("content_type"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, payload_ok.

    Responses are measured on the payload that was read; revisits, which hold none, by the headers
    they were written with. payload_ok: what was read agrees with its headers.
    """
    spark = pages.sparkSession
    register(spark)
    path = work_path(spark, "warc")
    page_records(pages, **columns).write.format("warc").option("path", path).mode("append").save()
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    page = F.when(number("record_id") != "", number("record_id").cast("long"))
    said = F.regexp_replace("payload_digest", "^sha256:", "")
    load = spark.read.format("warc").option("path", path)
    full = load.load().filter(F.col("record_type") == "response")
    full = full.select(page.alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"), "target_uri", (F.sha2("payload", 256) == said).alias("payload_ok"))
    short = load.option("payload", "false").load().filter(F.col("record_type") == "revisit")
    short = short.select(page.alias("page_id"), F.col("payload_length").cast("long").alias("payload_bytes"), said.alias("payload_digest"), "record_type", number("refers_to").cast("long").alias("refers_to"), "target_uri", (F.col("content_length") == 0).alias("payload_ok"))
    return full.unionByName(short)
