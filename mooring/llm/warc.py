"""WARC records in ZIP-packaged archives, read by ranges without extraction.

A task writes archives of bounded size: a ZIP whose stored members are `archive/data.warc.gz` (a gzip
member per record) and `indexes/index.cdxj`. The reader finds the end of the central directory, or
its ZIP64 form, locates the stored members, reads the index, and fetches records by byte range from
the archive as it lies, a run of neighbours at a time.
"""
import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooring.llm.catalog import register
from mooring.llm.common import stored, table, text_workers
from mooring.session import scratch_path

#: Payloads from this size on are written once; equal ones become revisits.
REVISIT_BYTES = 1000
#: An archive is closed after so many bytes or records.
ARCHIVE_BYTES = 64 << 20
ARCHIVE_RECORDS = 50_000
#: Neighbouring records are fetched together up to this size.
FETCH_BYTES = 4 << 20
DATA_MEMBER = "archive/data.warc.gz"
INDEX_MEMBER = "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---- which records are revisits -------------------------------------------------------------

def with_roles(pages: DataFrame, page_id: str = "page_id", url: str = "url",
               html: str = "html") -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to is null for responses.

    Of equal payloads of REVISIT_BYTES or more, the largest page_id is the response; rows that repeat
    it are responses too. Rows without id refer to it like others, and are responses where no
    id is known. A digest with a third of all rows is one row of the aggregate, and its pages meet
    it in a join that Spark can split.
    """
    payload = F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"),
                        payload.alias("payload"), F.sha2(payload, 256).alias("same"))
    large = F.octet_length("payload") >= REVISIT_BYTES
    groups = stored(rows.where(large).groupBy("same").agg(
        F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "same", "last"), "payload-groups")
    return rows.join(groups, "same", "left").select(
        "page_id", "url", "payload",
        F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


# ---- writing --------------------------------------------------------------------------------

def _name(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _clean(url) -> str:
    """The URL on one header line."""
    return "".join(c if " " < c != "\x7f" else "%%%02X" % ord(c) for c in url or "")


def record(page_id, url, payload: bytes, refers_to) -> tuple:
    """One WARC record as its own gzip member, and the payload's digest as the index has it."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: {digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    return squeeze.compress(raw) + squeeze.flush(), digest


def _archiver(folder: str):
    def run(batches):
        rows = ((b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].as_py(),
                 b.column(3)[i].as_py()) for b in batches for i in range(b.num_rows))
        where, inner = fs.FileSystem.from_uri(folder)
        where.create_dir(inner, recursive=True)
        pending = next(rows, None)
        while pending is not None:
            # A name of its own for each attempt; only paths that a finished task gives are read.
            name = f"{uuid.uuid4().hex}.wacz"
            index, written = [], 0
            with where.open_output_stream(f"{inner}/{name}") as out, zipfile.ZipFile(
                    out, "w", zipfile.ZIP_STORED) as packed:
                with packed.open(DATA_MEMBER, "w", force_zip64=True) as data:
                    while pending is not None and written < ARCHIVE_BYTES and len(
                            index) < ARCHIVE_RECORDS:
                        page_id, url, payload, refers_to = pending
                        raw, digest = record(page_id, url, payload, refers_to)
                        data.write(raw)
                        entry = {"url": url, "digest": digest, "offset": written,
                                 "length": len(raw), "filename": DATA_MEMBER.split("/")[1]}
                        index.append(f"{_clean(url)} {DATE} {json.dumps(entry)}\n")
                        written += len(raw)
                        pending = next(rows, None)
                packed.writestr(INDEX_MEMBER, "".join(index))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{name}"]), pa.array([len(index)], pa.int64())],
                names=["path", "records"])
    return run


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url",
                   html: str = "html") -> DataFrame:
    """Writes all pages into archives in the shared folder; returns (path, records) of each."""
    text_workers(pages.sparkSession)
    folder = scratch_path(pages.sparkSession, "archives")
    if "://" not in folder and not folder.startswith("/"):
        folder = folder.replace("file:/", "file:///", 1)
    rows = with_roles(pages, page_id, url, html)
    return stored(rows.mapInArrow(_archiver(folder), "path string, records bigint"), "manifest")


# ---- reading --------------------------------------------------------------------------------

class Archive:
    """The stored members of a ZIP file, by ranges of the file."""

    def __init__(self, path: str):
        where, inner = fs.FileSystem.from_uri(path)
        self.file = where.open_input_file(inner)
        self.size = self.file.size()
        self.members = self._directory()

    def read(self, start: int, length: int) -> bytes:
        data = self.file.read_at(length, start)
        if len(data) != length:
            raise ValueError(f"archive ends before {start + length}")
        return data

    def _directory(self) -> dict:
        """name -> (method, size, local header's place)."""
        tail = min(self.size, 22 + 65_535)
        data = self.read(self.size - tail, tail)
        at = data.rfind(b"PK\5\6")
        # The record's own comment length must reach the file's end.
        while at >= 0 and (at + 22 > tail or at + 22 + struct.unpack_from(
                "<H", data, at + 20)[0] != tail):
            at = data.rfind(b"PK\5\6", 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        entries, length, start = struct.unpack_from("<HII", data, at + 10)
        if entries == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
            locator = self.read(self.size - tail + at - 20, 20)
            if locator[:4] != b"PK\6\7":
                raise ValueError("no ZIP64 locator")
            wide = self.read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if wide[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 directory record")
            entries, length, start = struct.unpack_from("<QQQ", wide, 32)
        return self._entries(self.read(start, length), entries)

    @staticmethod
    def _entries(data: bytes, entries: int) -> dict:
        members, at = {}, 0
        for _ in range(entries):
            if data[at:at + 4] != b"PK\1\2":
                raise ValueError("broken central directory")
            method, = struct.unpack_from("<H", data, at + 10)
            packed, size, name_len, extra_len, note_len = struct.unpack_from("<IIHHH", data, at + 20)
            place, = struct.unpack_from("<I", data, at + 42)
            name = data[at + 46:at + 46 + name_len].decode("utf-8")
            extra = data[at + 46 + name_len:at + 46 + name_len + extra_len]
            k = 0
            while k + 4 <= len(extra):
                kind, n = struct.unpack_from("<HH", extra, k)
                if kind == 1:
                    # The wide fields are there for the narrow ones that are full, in this order.
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                    size = next(wide) if size == 0xFFFFFFFF else size
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    place = next(wide) if place == 0xFFFFFFFF else place
                k += 4 + n
            members[name] = (method, packed, place)
            at += 46 + name_len + extra_len + note_len
        return members

    def span(self, name: str) -> tuple:
        """(start, length) of a stored member's bytes in the file."""
        method, size, place = self.members[name]
        if method:
            raise ValueError(f"{name} is not stored")
        local = self.read(place, 30)
        if local[:4] != b"PK\3\4":
            raise ValueError(f"no local header of {name}")
        name_len, extra_len = struct.unpack_from("<HH", local, 26)
        return place + 30 + name_len + extra_len, size

    def index(self) -> list:
        """(offset, length) in the data member of each record, from the stored indexes."""
        out = []
        for name in self.members:
            if name.startswith("indexes/"):
                for line in self.read(*self.span(name)).decode("utf-8").splitlines():
                    entry = json.loads(line[line.index(" {") + 1:])
                    out.append((int(entry["offset"]), int(entry["length"])))
        return sorted(out)

    def records(self):
        """The bytes of each record, fetched in runs of neighbours."""
        start, size = self.span(DATA_MEMBER)
        run = []

        def fetch():
            first, (last, length) = run[0][0], run[-1]
            if last + length > size:
                raise ValueError("an index entry leaves its member")
            data = self.read(start + first, last + length - first)
            for offset, n in run:
                yield zlib.decompress(data[offset - first:offset - first + n], 31)

        for offset, n in self.index():
            if run and (offset + n - run[0][0] > FETCH_BYTES):
                yield from fetch()
                run = []
            run.append((offset, n))
        if run:
            yield from fetch()


def _fields(block: bytes) -> dict:
    lines = block.decode("utf-8").split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}


def _page(name: str):
    number = name.rpartition(":")[2].rstrip(">")
    return int(number) if number else None


def parse(raw: bytes) -> dict:
    """The fields of one record; a response's digest is that of the bytes it holds."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    body = rest[:int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    told = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
    size = int(_fields(http)["content-length"])
    if fields["warc-type"] == "response":
        if hashlib.sha1(payload).hexdigest() != told or len(payload) != size:
            raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
    refers = fields.get("warc-refers-to")
    return {"page_id": _page(fields["warc-record-id"]), "url": fields["warc-target-uri"],
            "record_type": fields["warc-type"], "payload": payload, "payload_bytes": size,
            "payload_digest": told, "refers_to": _page(refers) if refers else None}


READ = ("page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, "
        "record_type string, refers_to bigint")


def _reader(with_payload: bool):
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(),
             "payload_bytes": pa.int64(), "payload_digest": pa.string(),
             "record_type": pa.string(), "refers_to": pa.int64()}

    def batch_of(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], kind) for k, kind in kinds.items()], names=list(kinds))

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for raw in Archive(path).records():
                    row = parse(raw)
                    if not with_payload:
                        row["payload"] = None
                    rows.append(row)
                    held += len(raw) if with_payload else 200
                    if held > FETCH_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)
    return run


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives in `path`. A revisit has no payload of its own (empty), but the
    digest and size of the full one."""
    text_workers(manifest.sparkSession)
    count = max(1, manifest.count())
    return manifest.select("path").repartition(min(count, 10_000)).mapInArrow(
        _reader(with_payload), READ)


@register("op4_warc", """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (
  SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest,
         max(page_id) OVER (PARTITION BY payload) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM d
""")
def op4_warc(spark, sf_dir):
    """Every page, as read back from the archives it was written to."""
    return read_archives(write_archives(table(spark, sf_dir, "pages")), False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
