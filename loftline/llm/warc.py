"""WARC archives: records with revisits, and a reader that salvages what follows damage.

The reader goes from record to record. Where a check fails (gzip member, version line, headers, length, digest)
it looks for the next place that starts a valid record, goes on there and logs the bytes in between as a
quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir, cut, join_hot, table

#: Payloads of so many bytes are written once; equal ones revisit.
LEAST_REVISIT = 100
#: Bytes of an archive after which a task begins the next one.
ARCHIVE_BYTES = 4 << 20
#: Bytes that are unpacked at once, and at first: a member that begins here has some data by then.
PIECE, FIRST = 1 << 14, 1 << 10
DATE = "2024-01-01T00:00:00Z"

_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
_LENGTH = re.compile(rb"(?i)\ncontent-length:\s*([0-9]{1,18})\s*(?:\r?\n|$)")
_TAIL = re.compile(rb"(?:\r?\n){2}")
_BAD = (ValueError, zlib.error)


def _fields(fields: list[tuple[str, str]]) -> bytes:
    clean = ((k, re.sub(r"[\r\n]+", " ", v)) for k, v in fields)
    return "".join(f"{k}: {v}\r\n" for k, v in clean).encode() + b"\r\n"


def record_id(page_id, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"


def write_record(kind: str, page_id, url: str | None, payload: bytes, digest: str, refers_to=None, refers_url: str | None = None) -> bytes:
    """One gzip member. A revisit holds the HTTP head alone, which tells the length of the payload it stands for.

    It names the record that has the payload by id, URI and date, as the format says, and by the page's id.
    """
    head = b"HTTP/1.1 200 OK\r\n" + _fields([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    block = head + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page_id, url)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    fields += [("WARC-Target-URI", url)] * (url is not None) + [("X-Page-ID", str(page_id))] * (page_id is not None)
    if kind == "revisit":
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_to, refers_url)),
            ("WARC-Refers-To-Date", DATE),
            ("X-Refers-To-Page-ID", str(refers_to)),
        ] + [("WARC-Refers-To-Target-URI", refers_url)] * (refers_url is not None)
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(b"WARC/1.1\r\n" + _fields(fields) + block + b"\r\n\r\n") + pack.flush()


def digest_differs(stated: str, data: bytes) -> bool:
    """Whether a labelled digest in hex or base32 is another than that of the data; unknown labels are not checked."""
    label, colon, value = stated.partition(":")
    make = {"sha1": hashlib.sha1, "sha256": hashlib.sha256, "sha512": hashlib.sha512, "md5": hashlib.md5}.get(label.strip().lower().replace("-", ""))
    if not colon or make is None:
        return False
    found, value = make(data), value.strip()
    if len(value) == 2 * found.digest_size:
        return value.lower() != found.hexdigest()
    return value.upper().rstrip("=") != base64.b32encode(found.digest()).decode().rstrip("=")


def _headers(data: bytes, at: int) -> tuple[int, dict[str, str]]:
    """End and fields of header lines up to an empty one; reads no further than the first line that is none."""
    fields: dict[str, str] = {}
    while True:
        stop = data.find(b"\n", at)
        if stop < 0:
            raise ValueError("headers do not end")
        line, at = data[at:stop].rstrip(b"\r"), stop + 1
        if not line:
            return at, fields
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise ValueError("bad header line")
        fields.setdefault(name.strip().lower(), value.strip())


def _parse(data: bytes, at: int) -> tuple[int, dict[str, str], bytes]:
    """End, fields and block of the record that starts at a place of plain data; ValueError if a check fails."""
    version = _VERSION.match(data, at)
    if not version:
        raise ValueError("no version line")
    start, fields = _headers(data, version.end())
    if not fields.get("content-length", "").isdigit():
        raise ValueError("bad content length")
    end = start + int(fields["content-length"])
    tail = _TAIL.match(data, end) if end <= len(data) else None
    if not tail:
        raise ValueError("record does not end where its length says")
    block = data[start:end]
    if digest_differs(fields.get("warc-block-digest", ""), block):
        raise ValueError("block digest differs")
    return tail.end(), fields, block


def _member(data: memoryview, at: int) -> tuple[int, bytes]:
    """End and plain bytes of the gzip member that starts at a place; reads no further than a piece behind it."""
    unpack, parts = zlib.decompressobj(31), []
    while not unpack.eof and at < len(data):
        piece = data[at : at + (PIECE if parts else FIRST)]
        parts.append(unpack.decompress(piece))
        at += len(piece)
        if not parts[0] and not unpack.eof:
            raise ValueError("gzip header without data")  # so a false start costs a piece at most
    if not unpack.eof:
        raise ValueError("gzip member does not end")
    return at - len(unpack.unused_data), b"".join(parts)


def _inside(plain: bytes) -> list[tuple[dict[str, str] | None, bytes, str | None]]:
    """Records and gaps of a member; ValueError if it has no record."""
    found = [x[2:] for x in _plain(plain)]
    if not any(fields is not None for fields, _, _ in found):
        raise ValueError(found[0][2] if found else "empty member")
    return found


def _plain(data: bytes, members: bool = False) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str | None]]:
    at, gap, reason = 0, None, None
    view = memoryview(data)
    # The next member and version line that are known; each is looked for again only once it is passed.
    member = line = -1
    while at < len(data):
        try:
            if members and data.startswith(_MAGIC, at):
                end, plain = _member(view, at)
                found = _inside(plain)
            else:
                end, fields, block = _parse(data, at)
                found = [(fields, block, None)]
        except _BAD as e:
            if gap is None:
                gap, reason = at, str(e)
            # A record that lost its end is followed by the next one in the middle of a line; checks tell if it is one.
            if member <= at:
                member = data.find(_MAGIC, at + 1) if members else -1
                member = member if member >= 0 else len(data)
            if line <= at:
                hit = _VERSION.search(data, at + 1)
                line = hit.start() if hit else len(data)
            at = min(member, line)
            continue
        if gap is not None:
            yield gap, at - gap, None, b"", reason
            gap = None
        for k, x in enumerate(found):
            yield at, (end - at) * (k == 0), *x
        at = end
    if gap is not None:
        yield gap, len(data) - gap, None, b"", reason


def salvage(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str | None]]:
    """(offset, length, fields, block, None) of each record and (offset, length, None, b"", reason) of each gap.

    Of a gzip member with several records or gaps all have its offset, and the first has its length, the others 0.
    """
    return _plain(data, members=True)


RECORDS = (
    "offset bigint, length bigint, record_type string, record_id string, page_id bigint, url string, refers_to bigint,"
    " refers_to_record string, payload_digest string, payload_bytes bigint, payload binary, reason string"
)


def _number(text: str | None) -> int | None:
    """A number in the range of bigint."""
    found = int(text) if text and re.fullmatch(r"-?[0-9]{1,19}", text) else None
    return found if found is not None and -(1 << 63) <= found < 1 << 63 else None


def _row(offset: int, length: int, fields: dict[str, str] | None, block: bytes, reason: str | None) -> dict:
    row = {"offset": offset, "length": length, "reason": reason}
    if fields is None:
        return row
    head, empty, payload = block.partition(b"\r\n\r\n") if "application/http" in fields.get("content-type", "") else (b"", b"", block)
    stated = fields.get("warc-payload-digest", "")
    label, _, value = stated.partition(":")
    digest, size = value.lower() if label.lower() == "sha256" else stated or None, len(payload)
    if fields.get("warc-type") == "revisit":
        length = _LENGTH.search(head)
        payload, size = None, int(length[1]) if length else None
    else:
        if digest_differs(stated, payload):
            return row | {"reason": "payload digest differs"}
        digest = hashlib.sha256(payload).hexdigest()
    return row | {
        "record_type": fields.get("warc-type"),
        "record_id": fields.get("warc-record-id"),
        "page_id": _number(fields.get("x-page-id")),
        "url": fields.get("warc-target-uri"),
        "refers_to": _number(fields.get("x-refers-to-page-id")),
        "refers_to_record": fields.get("warc-refers-to"),
        "payload_digest": digest,
        "payload_bytes": size,
        "payload": payload,
    }


def read_archives(archives: DataFrame, name_col: str = "archive", content_col: str = "content") -> DataFrame:
    """One row per record and per gap of each archive: RECORDS; gaps have a reason and no record_type.

    Content is plain or a series of gzip members, and may change between the two. Null and empty content has no
    rows, and no archives give none; repeated archives are read each for itself, and other columns are ignored. Digests
    are checked where their label is known. The payload digest is the SHA-256 that was computed; a revisit has the one it
    states, and the payload's length that its HTTP head tells. A revisit of a foreign archive has refers_to_record, which a
    join with record_id resolves. An archive is one row, of 2 GB at most as Spark has it, and is read by one task.
    """
    kind = pa.schema(
        [("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
         ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()), ("refers_to_record", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
         ("payload", pa.binary()), ("reason", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, size = [], 0
                for found in salvage(content.as_py() or b""):
                    rows.append(_row(*found) | {"archive": name.as_py()})
                    size += len(found[3])
                    if size > ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kind)

    return archives.select(F.col(name_col).alias("archive"), F.col(content_col).alias("content")).mapInArrow(run, "archive string, " + RECORDS)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of .warc and .warc.gz files."""
    files = spark.read.format("binaryFile").load(path)
    return read_archives(files, "path", "content")


def plan_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to and refers_url of each row of pages (page_id, url, html).

    Of equal payloads of at least so many bytes, that of the smallest page_id is the response and the others
    revisit it; a null html is an empty payload. Rows that repeat the smallest id are responses too; if all ids
    are null, all are. Other columns are ignored; an empty table gives an empty result. First records are aggregated on
    the map side, and rows of hot payloads meet them by a broadcast.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    rows = rows.withColumn("key", F.when(F.octet_length("payload") >= least, F.unhex("digest")))
    known = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    first = rows.where("key is not null").groupBy("key").agg(F.min(known).alias("first"), F.count(F.lit(1)).alias("n"))
    first = cut(first.where("n > 1 and first is not null"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return join_hot(rows, first, "key", "n", ["first"]).select(
        "page_id",
        "url",
        "payload",
        "digest",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("first.page_id")).alias("refers_to"),
        F.when(revisit, F.col("first.url")).alias("refers_url"),
    )


def build_archives(records: DataFrame) -> DataFrame:
    """Archives (archive, content) of gzip members, one after the other, of about ARCHIVE_BYTES each.

    Every row of plan_records becomes a record, repeated ones too; null ids and URLs have no header. No records give no
    archives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, members, size = TaskContext.get().partitionId(), 0, [], 0

        def archive():
            name = f"part-{part:05d}-{number:05d}.warc.gz"
            return pa.RecordBatch.from_pydict({"archive": [name], "content": pa.array([b"".join(members)], pa.binary())})

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(batch.num_columns)), strict=True):
                page_id, url, payload, digest, kind, first, first_url = (x.as_py() for x in row)
                members.append(write_record(kind, page_id, url, payload, digest, first, first_url))
                size += len(members[-1])
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    number, members, size = number + 1, [], 0
        if members:
            yield archive()

    columns = records.select("page_id", "url", "payload", "digest", "record_type", "refers_to", "refers_url")
    return columns.mapInArrow(run, "archive string, content binary")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the archives to the shared folder and read them back; one row per page, those with nulls or repeated too."""
    folder = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4()}"
    build_archives(plan_records(table(spark, sf_dir, "pages"))).write.parquet(folder)
    found = read_archives(spark.read.parquet(folder)).where("record_type is not null")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = {
    "op6_warc": r"""
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
     f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by 1)
select p.page_id, p.payload_bytes, p.payload_digest,
       case when f.first <> p.page_id then 'revisit' else 'response' end as record_type,
       case when f.first <> p.page_id then f.first end as refers_to
from p left join f on p.payload_digest = f.payload_digest and p.payload_bytes >= 100
"""
}
