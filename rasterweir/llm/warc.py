"""WARC files as a Spark data source: ``df.write.format("warc")`` and ``spark.read.format("warc")``.

Records are WARC 1.1. By default they are written uncompressed, their payloads gzipped as the HTTP content encoding, so
that a reader can seek from header to header; with ``compression`` ``gzip`` each record is a gzip member of a ``.warc.gz``
file, the usual form. The reader takes any folder of such files, plans one partition per file, tests record type and other
header predicates on the headers, and skips the payloads of records that don't qualify or whose payload isn't asked for.
A payload that can't be decoded leaves its row with a null payload and the reason in ``problem``; where a file itself is
broken, a last row of type ``broken`` says why and where, and the other files are read on.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from .shared import discard, memory_bytes, new_path, written

SCHEMA = "page_id long, record_type string, record_id string, date string, target_uri string, payload_digest string, payload_bytes long, refers_to long, refers_to_uri string, payload binary, problem string"
#: A writer task begins another file beyond so many bytes.
FILE_BYTES = 256 << 20
READ_BYTES = 1 << 20
#: The digests of repeated payloads are broadcast up to so many bytes (DIGEST_BYTES and the URL a row, counted).
BROADCAST_BYTES = 64 << 20
DIGEST_BYTES = 160
# Version, and the profile of revisit records, from the WARC 1.1 format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Beginning of the names of manifests, one for each commit to a folder.
MANIFEST = "_MANIFEST"
SUFFIXES = (".warc", ".warc.gz")


def _fs(path: str):  # noqa: ANN202
    """The file system of a path or URI and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _uri(path: str) -> str:
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def _manifests(fs, root: str) -> list[str]:  # noqa: ANN001
    """Paths of a folder's manifests, in the order of their names; none for a folder that isn't there."""
    from pyarrow.fs import FileSelector, FileType

    found = fs.get_file_info(FileSelector(root, allow_not_found=True))
    return sorted(f.path for f in found if f.type == FileType.File and f.path.rsplit("/", 1)[-1].startswith(MANIFEST))


def _listed(fs, manifest: str) -> list[str]:  # noqa: ANN001
    with fs.open_input_stream(manifest) as f:
        return f.read().decode().split()


def record_bytes(row: dict, record_id: str, date: str, *, encode: bool = True) -> bytes:
    """One record. Line ends in a target URI are percent-encoded, a null or empty one is ``urn:page:`` and the page's id;
    a page's id and payload size are extension headers. encode: gzip as the content encoding."""
    revisit = row["record_type"] == "revisit"
    http, body = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8"], b""
    if not revisit:
        body = bytes(row["payload"] or b"")
        if encode:
            http.append(b"Content-Encoding: gzip")
            body = gzip.compress(body, 4, mtime=0)
    block = b"\r\n".join(http) + b"\r\n\r\n" + body
    line = lambda uri: uri.replace("\r", "%0D").replace("\n", "%0A")
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", line(row["target_uri"] or f"urn:page:{row['page_id']}"))]
    head.append(("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", line(row["refers_to_uri"] or f"urn:page:{row['refers_to']}")), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page", str(row["refers_to"]))]
    if row["page_id"] is not None:
        head.append(("X-Page-Id", str(row["page_id"])))
    head += [("X-Payload-Bytes", str(row["payload_bytes"])), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


class _Source:
    """Sequential reads and skips over a file; where it can seek, a skip costs no read."""

    def __init__(self, file, *, seeks: bool) -> None:  # noqa: ANN001
        self.file, self.seeks = file, seeks
        # of a compressed file as much as there is: a broken end doesn't take what lies before it
        self.read = file.read if seeks else file.read1
        self.held, self.at = b"", 0

    def _more(self, n: int) -> bool:
        """At least one more byte is held, if there is one."""
        got = self.read(max(n, READ_BYTES))
        self.held, self.at = self.held[self.at :] + got, 0
        return bool(got)

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            if not self._more(n - (len(self.held) - self.at)):
                raise ValueError("a WARC record ends before its length")
        self.at += n
        return self.held[self.at - n : self.at]

    def skip(self, n: int) -> None:
        own = min(n, len(self.held) - self.at)
        self.at += own
        n -= own
        if n and self.seeks:
            self.file.seek(self.file.tell() + n)
        while n and not self.seeks and (got := self.read(min(n, READ_BYTES))):
            n -= len(got)

    def head(self) -> bytes | None:
        """Up to and without the next empty line, line ends before it skipped; null at the end of the file."""
        while True:
            while self.held[self.at : self.at + 1] in (b"\r", b"\n"):
                self.at += 1
            if self.at < len(self.held) and (end := self.held.find(b"\r\n\r\n", self.at)) >= 0:
                out, self.at = self.held[self.at : end], end + 4
                return out
            if not self._more(READ_BYTES):
                if self.at < len(self.held):
                    raise ValueError("a WARC header has no end")
                return None


def _unchunked(body: bytes) -> bytes:
    """The body without the marks of HTTP's chunked transfer."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0 and (n := int(body[at:end].split(b";")[0] or b"0", 16)):
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
    return b"".join(out)


def _payload(kind: str, content: str, block: bytes) -> bytes | None:
    """HTTP body of a response, its transfer and content encoding undone; the block of a resource or conversion; else null."""
    if kind in ("resource", "conversion") or (kind == "response" and not content.startswith("application/http")):
        return block
    if kind != "response":
        return None
    raw, _, body = block.partition(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in raw.split(b"\r\n")[1:])}
    if http.get(b"transfer-encoding", b"").endswith(b"chunked"):
        body = _unchunked(body)
    if http.get(b"content-encoding") in (b"gzip", b"x-gzip"):
        return gzip.decompress(body)
    return zlib.decompress(body) if http.get(b"content-encoding") == b"deflate" else body


def _number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def _bare(uri: str | None) -> str | None:
    """A URI without the angle brackets that older archives put around it."""
    return uri[1:-1] if uri and uri.startswith("<") and uri.endswith(">") else uri


def parse(file, types: set[str] | None, headers: dict[str, set[str] | None], payload: bool, *, seeks: bool = True, strict: bool = False) -> Iterator[tuple]:  # noqa: ANN001
    """Rows of SCHEMA. headers: the values that a header may have, None for any. Headers first: a record that a predicate
    rejects is skipped, its payload isn't read or decoded. strict: a broken payload or file raises instead of giving a row."""
    src = _Source(file, seeks=seeks)
    record = 0
    while True:
        try:
            if (raw := src.head()) is None:
                return
            lines = raw.decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no WARC record: {lines[0][:40]!r}")
            h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            h |= {k: _bare(h[k]) for k in ("warc-target-uri", "warc-refers-to-target-uri", "warc-record-id") if k in h}
            size, kind, data, problem = int(h["content-length"]), h.get("warc-type", ""), None, None
            if size < 0:
                raise ValueError("a WARC record of negative length")
            if (types is not None and kind not in types) or not all(k in h if v is None else h.get(k) in v for k, v in headers.items()):
                src.skip(size)
                continue
            block = None
            if payload and kind in ("response", "resource", "conversion"):
                block = src.take(size)
            else:
                src.skip(size)
        except (ValueError, KeyError, OSError, EOFError, zlib.error) as e:  # where the next record begins isn't known
            if strict:
                raise
            if types is None or "broken" in types:
                yield (None, "broken", None, None, None, None, None, None, None, None, f"record {record}: {type(e).__name__}: {e}")
            return
        finally:
            record += 1
        if block is not None:
            try:
                data = _payload(kind, h.get("content-type", ""), block)
            except (ValueError, OSError, EOFError, zlib.error) as e:
                if strict:
                    raise
                problem = f"{type(e).__name__}: {e}"
        n = _number(h.get("x-payload-bytes"))
        yield (
            _number(h.get("x-page-id")), kind, h.get("warc-record-id"), h.get("warc-date"), h.get("warc-target-uri"), (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
            len(data) if n is None and data is not None else n, _number(h.get("x-refers-to-page")), h.get("warc-refers-to-target-uri"), data, problem,
        )


@dataclass
class FilePart(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    """Options: path; payload ("false": payload columns stay null and nothing is decoded); strict ("true": what is broken raises)."""

    # columns that a header decides, and the header's name
    COLUMNS = {"record_type": "warc-type", "target_uri": "warc-target-uri"}

    def __init__(self, options: dict) -> None:
        self.path, self.payload = _uri(options["path"]), str(options.get("payload", "true")).lower() != "false"
        self.strict = str(options.get("strict", "false")).lower() == "true"
        self.types: set[str] | None = None
        self.headers: dict[str, set[str] | None] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In | IsNotNull) and len(f.attribute) == 1 else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else set()
            if name not in self.COLUMNS or None in values:
                yield f  # Spark applies it
            elif isinstance(f, IsNotNull):
                self.headers.setdefault(self.COLUMNS[name], None)
            elif name == "record_type":
                self.types = values if self.types is None else self.types & values
            else:
                before = self.headers.get(self.COLUMNS[name])
                self.headers[self.COLUMNS[name]] = values if before is None else before & values

    def partitions(self) -> list[InputPartition]:
        """A file that is named; what the manifests of a folder list; else all its WARC files, in folders below it too."""
        from pyarrow.fs import FileSelector, FileType

        fs, root = _fs(self.path)
        if fs.get_file_info(root).type == FileType.File:
            return [FilePart(self.path)]
        if manifests := _manifests(fs, root):
            names = [n for m in manifests for n in _listed(fs, m)]
        else:
            names = sorted(f.path[len(root) :].lstrip("/") for f in fs.get_file_info(FileSelector(root, recursive=True)) if f.type == FileType.File and f.path.endswith(SUFFIXES))
        return [FilePart(f"{self.path}/{n}") for n in names]

    def read(self, partition: FilePart | None) -> Iterator[tuple]:
        if partition is None:  # no files at all
            return
        fs, path = _fs(partition.path)
        with fs.open_input_file(path) as f:
            if path.endswith(".gz"):
                with gzip.GzipFile(fileobj=f) as g:
                    yield from parse(g, self.types, self.headers, self.payload, seeks=False, strict=self.strict)
            else:
                yield from parse(f, self.types, self.headers, self.payload, strict=self.strict)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceWriter):
    """Options: path; date (of the capture, ISO 8601 in UTC; the time of writing if unset); compression ("gzip": a member per record).

    Tasks write files under names of their own; only those of committed tasks are listed in the commit's manifest, which
    appears at once under a name of its own: a folder holds the records of all commits to it. With mode overwrite the manifests
    and listed files that were there are deleted once the new manifest is. Record ids follow from the file's name and the
    record's place, so they are unique.
    """

    def __init__(self, options: dict, overwrite: bool = False) -> None:
        self.overwrite = overwrite
        self.path, self.gzip = _uri(options["path"]), options.get("compression") == "gzip"
        self.date = options.get("date") or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator: Iterator) -> Written:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        names, out, size, n = [], None, 0, 0
        for row in iterator:
            if out is None or size > FILE_BYTES:
                if out is not None:
                    out.close()
                own, n = uuid.uuid4(), 0
                names.append(f"part-{own.hex}.warc{'.gz' if self.gzip else ''}")
                out, size = fs.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
            data = record_bytes(row.asDict(), str(uuid.uuid5(own, str(n))), self.date, encode=not self.gzip)
            data = gzip.compress(data, 4, mtime=0) if self.gzip else data
            out.write(data)
            size, n = size + len(data), n + 1
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        before = _manifests(fs, root) if self.overwrite else []
        own = uuid.uuid4().hex
        with fs.open_output_stream(f"{root}/.{own}") as f:
            f.write("\n".join(n for m in messages if m for n in m.names).encode())
        fs.move(f"{root}/.{own}", f"{root}/{MANIFEST}-{own}")
        for old in before:
            gone = _listed(fs, old)
            fs.delete_file(old)
            for n in gone:
                fs.delete_file(f"{root}/{n}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _fs(self.path)
        for n in (n for m in messages if m for n in m.names):
            fs.delete_file(f"{root}/{n}")


class WarcSource(DataSource):
    """The format "warc"."""

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
    """Make the format known, and let predicates reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# The base32 alphabet of RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def sha1_base32(digest: F.Column) -> F.Column:
    """Upper-case base32 of a SHA-1 in hexadecimal: five of its digits are four letters."""
    letters, out = F.lit(BASE32), []
    for i in range(0, 40, 5):
        five = F.conv(F.substring(digest, i + 1, 5), 16, 10).cast("int")
        out += [F.substr(letters, F.shiftright(five, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def archive_rows(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """Pages as rows of SCHEMA, and the written table they read: of equal payloads of ``least_bytes`` or more the smallest id is the response, others revisit it.

    Null html: empty payload. Rows that repeat the smallest id are all responses. A null id can't be referred to: such
    rows are responses. A very long payload is one record. Other columns are ignored, whatever their names. Equal payloads
    are told by SHA-1 and length. First the digests that repeat are found, with map-side combination; if they take
    BROADCAST_BYTES at most they are broadcast and payloads go straight to their files, else both are joined by shuffle,
    where adaptive execution splits hot digests.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("target_uri"), payload.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("sha"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    first = rows.where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("sha", "payload_bytes").agg(F.min(F.struct("page_id", "target_uri")).alias("first"), F.count("*").alias("n"))
    first = written(first.where("n > 1").select("sha", "payload_bytes", F.col("first.page_id").alias("first"), F.col("first.target_uri").alias("first_uri")), "repeated-digests")
    small = memory_bytes(first, DIGEST_BYTES, "first_uri") <= BROADCAST_BYTES
    rows = rows.join(F.broadcast(first) if small else first, ["sha", "payload_bytes"], "left")
    again = F.col("first").isNotNull() & F.col("page_id").isNotNull() & (F.col("first") != F.col("page_id"))
    none = F.lit(None).cast("string")
    return rows.select(
        "page_id", F.when(again, "revisit").otherwise("response").alias("record_type"), none.alias("record_id"), none.alias("date"), "target_uri", sha1_base32(F.col("sha")).alias("payload_digest"), "payload_bytes",
        F.when(again, F.col("first")).alias("refers_to"), F.when(again, F.col("first_uri")).alias("refers_to_uri"), F.when(~again, F.col("payload")).alias("payload"), none.alias("problem"),
    ), first


def write_archive(pages: DataFrame, path: str | None = None, least_bytes: int = 0, **options: str) -> str:
    """Write a record per page; returns the folder (a new one in the shared folder unless named). options: the writer's.

    An empty table: no records. A folder that has an archive keeps it: the records are added. Payloads are told apart within
    one call only, so a page that an earlier call has written is a response again.
    """
    register(pages.sparkSession)
    path = path or new_path(pages.sparkSession, "warc")
    rows, first = archive_rows(pages, least_bytes)
    rows.write.format("warc").options(**options).mode("append").save(path)
    discard(first)
    return path


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Rows of SCHEMA from a file or folder; filters on record_type and target_uri are decided on the headers.

    Page ids are null in archives from elsewhere. Angle brackets around URIs (WARC 1.0) are taken off before predicates are
    tested. A payload that can't be decoded is null and ``problem`` says why; a file that breaks off or isn't WARC ends with
    a row of type ``broken``. ``problem`` is null in all other rows.
    """
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
