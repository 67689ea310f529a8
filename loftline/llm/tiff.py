"""TIFF columns: write 8-bit images, walk image directories, decode strips and tiles, undo predictors."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

# Fixed values of the format: tags, and bytes of each field type.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 317, 322, 323, 324, 325
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773

#: Layout of what is written: bytes of a row, rows of a page, of a strip, and the sides of a tile.
ROW, PAGE_ROWS, STRIP_ROWS, TILE = 64, 4096, 128, (32, 64)
#: No codec packs so many bytes into one: a page that says more is damaged.
MOST_RATIO = 4096

_RUN = re.compile(rb"(.)\1{2,127}", re.S)


def pack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literals(end: int) -> None:
        for a in range(at, end, 128):
            part = data[a : min(end, a + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    for run in _RUN.finditer(data):
        literals(run.start())
        out.append(257 - (run.end() - run.start()))
        out.append(data[run.start()])
        at = run.end()
    literals(len(data))
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 1 if n == 128 else 2
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first; the width grows one code early."""
    out, held, bits, width = bytearray(), 0, 0, 9
    codes: dict[bytes, int] = {bytes([i]): i for i in range(256)}

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    put(256)
    word, following = b"", 258
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in codes:
            word = longer
            continue
        put(codes[word])
        codes[longer] = following
        following += 1
        if following == 4095:
            put(256)
            codes = {bytes([j]): j for j in range(256)}
            following, width = 258, 9
        elif following >= 1 << width:
            width += 1
        word = data[i : i + 1]
    if word:
        put(codes[word])
        following += 1
        if following >= 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    out, held, bits, width, at = bytearray(), 0, 0, 9, 0
    words: list[bytes] = []
    last = b""
    while len(out) < size:
        while bits < width:
            if at >= len(data):
                return bytes(out)
            held, bits, at = held << 8 | data[at], bits + 8, at + 1
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            words, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not words:
            raise ValueError("LZW data without a clear code")
        if code < len(words):
            word = words[code]
        elif code == len(words) and last:
            word = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        out += word
        if last:
            words.append(last + word[:1])
        last = word
        if len(words) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def _inflate(data: bytes, size: int) -> bytes:
    return zlib.decompressobj().decompress(data, size)


ENCODE = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 1), PACKBITS: pack_bits}
DECODE = {NONE: lambda d, n: d[:n], LZW: lzw_decode, DEFLATE: _inflate, OLD_DEFLATE: _inflate, PACKBITS: unpack_bits}


def write_tiff(payload: bytes, compression: int, tiled: bool, predictor: bool, row: int = ROW) -> bytes:
    """Grey 8-bit pages of `row` columns; the payload's length is a positive multiple of it."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, row)
    pages = [image[a : a + PAGE_ROWS] for a in range(0, len(image), PAGE_ROWS)]
    out = bytearray(struct.pack("<2sHI", b"II", 42, 8))
    for number, page in enumerate(pages):
        height = len(page)
        if tiled:
            w, h = TILE
            padded = np.zeros((-(-height // h) * h, row), np.uint8)
            padded[:height] = page
            blocks = [padded[y : y + h, x : x + w] for y in range(0, len(padded), h) for x in range(0, row, w)]
        else:
            blocks = [page[y : y + STRIP_ROWS] for y in range(0, height, STRIP_ROWS)]
        if predictor:
            blocks = [np.concatenate([b[:, :1], np.diff(b, axis=1)], axis=1) for b in blocks]
        coded = [ENCODE[compression](b.tobytes()) for b in blocks]
        where = {True: (TILE_OFFSETS, TILE_BYTES), False: (STRIP_OFFSETS, STRIP_BYTES)}[tiled]
        tags = {WIDTH: [row], HEIGHT: [height], BITS: [8], COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [1], PLANAR: [1]}
        tags |= {TILE_WIDTH: [TILE[0]], TILE_HEIGHT: [TILE[1]]} if tiled else {ROWS_PER_STRIP: [STRIP_ROWS]}
        if predictor:
            tags[PREDICTOR] = [2]
        tags |= dict.fromkeys(where, [0] * len(coded))
        long = {WIDTH, HEIGHT, ROWS_PER_STRIP, TILE_WIDTH, TILE_HEIGHT, *where}
        # The directory comes first, then lists that do not fit an entry, then the blocks.
        start = len(out)
        lists = start + 2 + 12 * len(tags) + 4
        blocks_at = lists + (8 * len(coded) if len(coded) > 1 else 0)
        ends = np.cumsum([len(c) for c in coded]) + blocks_at
        tags[where[0]] = [blocks_at, *ends[:-1].tolist()]
        tags[where[1]] = [len(c) for c in coded]
        finish = int(ends[-1]) + int(ends[-1]) % 2
        entries, extra = b"", b""
        for tag, values in sorted(tags.items()):
            kind, code = (4, "I") if tag in long else (3, "H")
            raw = struct.pack(f"<{len(values)}{code}", *values)
            if len(raw) > 4:
                raw, extra = struct.pack("<I", lists + len(extra)), extra + raw
            entries += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        following = finish if number + 1 < len(pages) else 0
        out += struct.pack("<H", len(tags)) + entries + struct.pack("<I", following) + extra + b"".join(coded)
        out += b"\0" * (finish - len(out))
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, list[int]]]]:
    """Byte order and tags of each image directory, as the chain of offsets goes; a loop ends it."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind not in (1, 3, 4):
                continue
            size = TYPE_BYTES[kind] * count
            place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
            tags[tag] = list(struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind]}", data, place))
        yield order, tags
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def decode_page(data: bytes, order: str, tags: dict[int, list[int]]) -> np.ndarray:
    """Samples of one directory as (height, width, samples); 8 or 16 bits, chunky or planar."""
    one = lambda tag, other: tags.get(tag, [other])[0]
    width, height, bits, n = tags[WIDTH][0], tags[HEIGHT][0], one(BITS, 1), one(SAMPLES, 1)
    if bits not in (8, 16) or one(COMPRESSION, NONE) not in DECODE or one(PREDICTOR, 1) not in (1, 2):
        raise ValueError("samples, compression or predictor not supported")
    if width * height * n * bits // 8 > MOST_RATIO * len(data):
        raise ValueError("page larger than its data can be")
    kind = np.dtype(order + ("u1" if bits == 8 else "u2"))
    planes, per = (n, 1) if one(PLANAR, 1) == 2 else (1, n)
    tiled = TILE_OFFSETS in tags
    w, h = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (width, min(height, one(ROWS_PER_STRIP, height)))
    offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_BYTES])
    across, down = -(-width // w), -(-height // h)
    if len(offsets) < across * down * planes or len(sizes) < len(offsets):
        raise ValueError("blocks are missing")
    page = np.zeros((height, width, n), kind.newbyteorder("="))
    for i, (offset, size) in enumerate(zip(offsets, sizes, strict=False)):
        plane, place = divmod(i, across * down)
        y, x = place // across * h, place % across * w
        rows = h if tiled else min(h, height - y)
        want = rows * w * per * kind.itemsize
        raw = DECODE[one(COMPRESSION, NONE)](data[offset : offset + size], want)
        if len(raw) < want:
            raise ValueError("a block is too short")
        block = np.frombuffer(raw, kind, rows * w * per).reshape(rows, w, per).astype(page.dtype)
        if one(PREDICTOR, 1) == 2:
            block = np.cumsum(block, axis=1, dtype=page.dtype)
        part = page[y : y + rows, x : x + w, plane : plane + per] if planes > 1 else page[y : y + rows, x : x + w]
        part[...] = block[: part.shape[0], : part.shape[1]]
    return page


def read_tiff(data: bytes) -> list[dict]:
    """A row for each page, in order; a page that cannot be read has an error and no samples.

    Pages behind a broken directory are lost, and so say an error row of their own.
    """
    out: list[dict] = []

    def row(tags, samples=None, error=None):
        one = lambda tag: int(tags[tag][0]) if tags.get(tag) else None
        feature = None
        if samples is not None and samples.size:
            v = samples.astype(np.float64)
            steps = np.abs(np.diff(v, axis=1)).mean() if samples.shape[1] > 1 else 0.0
            feature = f"{samples.shape[1]}x{samples.shape[0]} mean={v.mean():.4f} sd={v.std():.4f} step={steps:.4f} values={len(np.unique(samples))}"
        return {
            "page": len(out), "width": one(WIDTH), "height": one(HEIGHT), "samples": one(SAMPLES) or 1, "bits": one(BITS),
            "compression": one(COMPRESSION), "predictor": one(PREDICTOR) or 1, "tiled": TILE_OFFSETS in tags,
            "data": None if samples is None else samples.tobytes(), "feature": feature, "error": error,
        }

    try:
        for order, tags in directories(data):
            try:
                out.append(row(tags, decode_page(data, order, tags)))
            except (ValueError, KeyError, IndexError, zlib.error, struct.error) as e:
                out.append(row(tags, error=f"{type(e).__name__}: {e}"))
    except (ValueError, struct.error) as e:
        out.append(row({}, error=f"{type(e).__name__}: {e}"))
    return out


PAGE = (
    "array<struct<page: int, width: bigint, height: bigint, samples: int, bits: int, compression: int,"
    " predictor: int, tiled: boolean, data: binary, feature: string, error: string>>"
)


def with_pages(files: DataFrame, content_col: str = "content") -> DataFrame:
    """files with an array `pages` of what each TIFF holds, in the place of its content; null content has no pages.

    Rows stay as they are otherwise, repeated ones too; an empty table gives an empty result.
    """
    kept = [c for c in files.columns if c not in ("pages", content_col)]
    files = files.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{content_col}`").cast("binary"))
    schema = files.limit(0).drop(content_col).withColumn("pages", F.lit(None).cast(PAGE)).schema
    kind = pa.list_(
        pa.struct(
            [("page", pa.int32()), ("width", pa.int64()), ("height", pa.int64()), ("samples", pa.int32()), ("bits", pa.int32()),
             ("compression", pa.int32()), ("predictor", pa.int32()), ("tiled", pa.bool_()), ("data", pa.binary()),
             ("feature", pa.string()), ("error", pa.string())]
        )
    )

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                pages = [[] if c is None else read_tiff(c) for c in part.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(pages, kind)], [*kept, "pages"])

    return files.mapInArrow(run, schema)


def pages(files: DataFrame, content_col: str = "content") -> DataFrame:
    """One row per page: the columns of files but the content, and those of the page, which replace columns of their names.

    Rows whose content is null have no pages and go; repeated rows give repeated pages.
    """
    names = {f.name for f in T._parse_datatype_string(PAGE).elementType.fields} | {"__page"}
    found = with_pages(files.drop(*[c for c in files.columns if c in names and c != content_col]), content_col)
    return found.select("*", F.explode("pages").alias("__page")).drop("pages").select("*", "__page.*").drop("__page")


def store(rows: DataFrame, payload_col: str, media_col: str = "media") -> DataFrame:
    """rows with the payload, filled up with bytes 0 to a positive multiple of 64, as a TIFF.

    Codec, layout and predictor are chosen by the crc32 of the payload, so equal payloads are stored alike. Null
    and empty payloads become 64 bytes 0.
    """
    kept = [c for c in rows.columns if c not in (payload_col, media_col)]
    rows = rows.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{payload_col}`").cast("binary"))
    schema = rows.limit(0).drop(payload_col).withColumn(media_col, F.lit(b"")).schema

    def image(payload: bytes | None) -> bytes:
        data = payload or b""
        data += b"\0" * (-len(data) % ROW or (0 if data else ROW))
        crc = zlib.crc32(data)
        codec = LZW if crc % 8 == 0 else PACKBITS if crc % 8 < 4 else DEFLATE
        return write_tiff(data, codec, tiled=bool(crc >> 8 & 1), predictor=bool(crc >> 9 & 1) and codec != PACKBITS)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                media = [image(p) for p in part.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(media, pa.binary())], [*kept, media_col])

    return rows.mapInArrow(run, schema)


def _payload(pages: Column) -> Column:
    """The samples of all pages, one after the other; joined as text, as a fold would copy what it has for each page."""
    joined = F.unhex(F.array_join(F.transform(pages, lambda p: F.hex(p["data"])), ""))
    return F.when(F.size(pages) == 1, F.get(pages, F.lit(0))["data"]).otherwise(joined)


def op4_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document, repeated ones too; a null text is an empty one, of 64 bytes 0. Texts of any length are stored whole."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("payload"))
    stored = store(docs, "payload").withColumns(
        {"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)}
    )
    read = with_pages(stored, "media").withColumn("payload", _payload(F.col("pages")))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.array_join(F.transform("pages", lambda p: p["feature"]), "; ").alias("feature"),
    )


SQL: dict[str, str] = {}
