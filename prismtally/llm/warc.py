"""WARC archives as a Python data source: ``format("warc")`` reads and writes records.

Reading plans partitions from the sizes of the files, tests record type and header predicates on the headers, which come
first in a record, and only then reads, or skips, the payload. Payloads are decoded only for record types that carry
them and only if asked for. Records are told apart by their lengths, so a gzip member may hold one (as written here, and as the format
recommends), several or a part of one, and files may be plain. Files are reached through the file system of their URI, so a shared
folder can be a mount or a store.

A task writes a file, and another one whenever a file has grown to ``fileBytes``. A file is visible under its final name only after the job
commits, so a task that is run again leaves no second copy.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator, Sequence

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    In,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from prismtally.llm.common import stored

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, payload_digest string, "
    "payload_bytes long, refers_to string, page_id long, payload binary"
)
VERSION = b"WARC/1.1"
DATE = "2020-01-01T00:00:00Z"  # records of one table carry one date, so reruns write the same bytes
PART_BYTES = 64 << 20
FILE_BYTES = 256 << 20
CHUNK = 1 << 16
GZIP = b"\x1f\x8b"
#: Column by WARC header; these columns can be tested before a payload is read.
HEADERS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To",
}


def digest_text(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def header_safe(text: str) -> str:
    """Line breaks would end a header, so they (and the escape itself) are percent-encoded."""
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def header_text(text: str) -> str:
    return text.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode("utf-8", "surrogatepass") for k, v in headers), b"Content-Length: %d" % len(block), b"", b""]
    return b"\r\n".join(lines) + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def page_record(row, level: int = 6) -> bytes:
    """A response with its payload, or a revisit with the HTTP headers alone."""
    payload, revisit = bytes(row.payload), row.refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", page_urn(row.page_id)),
        ("WARC-Date", DATE),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest_text(payload)}"),
    ]
    if row.target_uri is not None:
        headers.append(("WARC-Target-URI", header_safe(row.target_uri)))
    if revisit:
        headers += [("WARC-Refers-To", page_urn(row.refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return gzip_member(record_bytes(headers, http if revisit else http + payload), level)


class RecordStream:
    """Bytes of an archive, plain or in gzip members, unpacked no further than they are asked for."""

    def __init__(self, source) -> None:
        self.source, self.ready = source, bytearray()
        self.packed = source.read(CHUNK)
        self.unpacker = zlib.decompressobj(31) if self.packed.startswith(GZIP) else None

    def _more(self) -> bool:
        """Some more bytes; false at the end of the file."""
        if not self.packed:
            self.packed = self.source.read(CHUNK)
        if self.unpacker is None:
            self.ready += self.packed
            found, self.packed = bool(self.packed), b""
            return found
        if self.unpacker.eof:
            self.packed = self.packed.lstrip(b"\0")  # padding between members
            if not self.packed:
                self.packed = self.source.read(CHUNK)
                return self._more() if self.packed else False
            self.unpacker = zlib.decompressobj(31)
        elif not self.packed:
            raise EOFError("A gzip member ends too early.")
        self.ready += self.unpacker.decompress(self.packed, CHUNK)
        self.packed = self.unpacker.unused_data if self.unpacker.eof else self.unpacker.unconsumed_tail
        return True

    def next_record(self) -> bool:
        """Goes past the line breaks between records; false at the end of the file."""
        while True:
            del self.ready[: len(self.ready) - len(self.ready.lstrip(b"\r\n"))]
            if self.ready:
                return True
            if not self._more():
                return False

    def until(self, mark: bytes, most: int | None = None) -> bytes | None:
        """Bytes before ``mark``, which is taken too; ``None``, and nothing taken, if it does not end within ``most`` bytes."""
        at, searched = -1, 0
        while True:
            at = self.ready.find(mark, max(0, searched - len(mark)), most)
            if at >= 0 or (most is not None and len(self.ready) >= most):
                break
            searched = len(self.ready)
            if not self._more():
                if most is not None:
                    break
                raise EOFError("A WARC record has no end of headers.")
        if at < 0:
            return None
        out = bytes(self.ready[:at])
        del self.ready[: at + len(mark)]
        return out

    def take(self, count: int) -> bytes:
        while len(self.ready) < count:
            if not self._more():
                raise EOFError("A WARC record ends too early.")
        out = bytes(self.ready[:count])
        del self.ready[:count]
        return out

    def skip(self, count: int) -> None:
        while count > len(self.ready):
            count -= len(self.ready)
            self.ready.clear()
            if not self._more():
                raise EOFError("A WARC record ends too early.")
        del self.ready[:count]


def parse_headers(head: bytes) -> dict[str, str]:
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"Not a WARC record: {version[:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


class FilePart(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        super().__init__(0)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.uri = options["path"]
        self.part_bytes = int(options.get("partitionbytes", PART_BYTES))
        self.payload = options.get("payload", "true").lower() == "true"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and IN on header columns are settled before payloads; the rest goes back to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS and f.attribute[0] != "payload_digest":
                values = set(f.value) if isinstance(f, In) else {f.value}
                name = f.attribute[0]
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        """Files in order of name, small ones together up to ``partitionbytes``; a larger file is a partition alone."""
        store, path = fs.FileSystem.from_uri(self.uri)
        infos = store.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((i.path, i.size) for i in infos if i.type == fs.FileType.File and i.path.endswith((".warc", ".warc.gz")))
        out: list[FilePart] = []
        filled = self.part_bytes
        for name, size in files:
            if filled + size > self.part_bytes:
                out.append(FilePart([]))
                filled = 0
            out[-1].paths.append(name)
            filled += size
        return out

    def read(self, partition: FilePart | None) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.uri)
        for path in partition.paths if partition else ():  # Spark reads None where there is no partition
            with store.open_input_stream(path, compression=None) as source:
                stream = RecordStream(source)
                while stream.next_record():
                    headers = parse_headers(stream.until(b"\r\n\r\n"))
                    row = self._row(headers, stream, int(headers.get("content-length", 0)))
                    if row is not None:
                        yield row

    def _row(self, headers: dict[str, str], stream: RecordStream, left: int) -> tuple | None:
        """The row of a record whose block of ``left`` bytes comes next; the whole block is taken or skipped."""
        values = {c: headers.get(h.lower()) for c, h in HEADERS.items()}
        page = page_of(values["record_id"])
        if values["target_uri"] is not None and (values["record_id"] or "").startswith("<urn:page:"):
            values["target_uri"] = header_text(values["target_uri"])
        if any(values[c] not in wanted for c, wanted in self.wanted.items()):
            stream.skip(left)  # never decoded into a row
            return None
        payload, size = None, None
        http = stream.until(b"\r\n\r\n", left) if headers.get("content-type", "").startswith("application/http") else None
        if http is not None:
            left -= len(http) + 4
        if values["record_type"] == "revisit":
            fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in (http or b"").decode("latin-1").split("\r\n")[1:])}
            length = fields.get("content-length", "")
            size = int(length) if length.isdigit() else 0
        else:
            size = left
            if self.payload:
                payload, left = stream.take(left), 0
        stream.skip(left)
        digest = values["payload_digest"]
        return (
            values["record_id"], values["record_type"], values["target_uri"], values["date"],
            digest and digest.removeprefix("sha1:"), size, values["refers_to"], page, payload,
        )


class Written(WriterCommitMessage):
    def __init__(self, moves: list[tuple[str, str]]) -> None:
        self.moves = moves


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.uri, self.overwrite = options["path"], overwrite
        self.level = int(options.get("level", 6))
        self.file_bytes = int(options.get("filebytes", FILE_BYTES))

    def write(self, iterator: Iterator) -> Written:
        """Records of one task into hidden files; rows have page_id, target_uri, payload and refers_to."""
        from pyspark import TaskContext

        store, path = fs.FileSystem.from_uri(self.uri)
        part = TaskContext.get().partitionId()
        store.create_dir(f"{path}/_temporary", recursive=True)
        info = json.dumps({"software": "prismtally", "format": "WARC File Format 1.1"}).encode()
        moves, out, filled = [], None, 0
        try:
            for row in iterator:
                if out is None or filled >= self.file_bytes:
                    if out is not None:
                        out.close()
                    name = f"part-{part:05d}-{uuid.uuid4().hex}"  # appending never meets an older file of that name
                    moves.append((f"{path}/_temporary/{name}", f"{path}/{name}.warc.gz"))
                    out = store.open_output_stream(moves[-1][0], compression=None)
                    head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:part:{name}>"), ("WARC-Date", DATE), ("Content-Type", "application/json")]
                    out.write(gzip_member(record_bytes(head, info), self.level))
                    filled = 0
                record = page_record(row, self.level)
                out.write(record)
                filled += len(record)
        finally:
            if out is not None:
                out.close()
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = fs.FileSystem.from_uri(self.uri)
        store.create_dir(path, recursive=True)
        for message in messages:
            for hidden, final in message.moves if message else []:
                store.move(hidden, final)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = fs.FileSystem.from_uri(self.uri)
        for message in messages:
            for hidden, _final in message.moves if message else []:
                store.delete_file(hidden)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(uri)``; options ``payload`` (false: leave it out), ``partitionBytes``, ``fileBytes``, ``level``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session; Spark hands predicates to Python sources only with this setting."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """``page_id, target_uri, payload, refers_to``: of equal payloads of at least ``least`` bytes the smallest id holds it.

    A null html is an empty payload. A null id comes after all others. Rows that repeat an id with the same payload are
    all responses if theirs is the smallest id.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"),
        F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b"")).alias("payload"),
    )
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    firsts = rows.where(F.length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    # Stored, so that both sides of the join come from a shuffle of their own and the rows of a frequent payload can be split.
    shared = stored(firsts.where("n > 1").select("digest", "first"), "shared-payloads")
    later = ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(shared, "digest", "left").select(
        "page_id", "target_uri", "payload", F.when(F.col("first").isNotNull() & later, F.col("first")).alias("refers_to")
    )


def write_pages(pages: DataFrame, uri: str, least: int = 0, level: int = 6) -> None:
    register(pages.sparkSession)
    with_revisits(pages, least).write.format("warc").option("level", str(level)).mode("append").save(uri)


def read_records(spark: SparkSession, uri: str, payload: bool = True, part_bytes: int = PART_BYTES) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("partitionBytes", str(part_bytes)).load(uri)
