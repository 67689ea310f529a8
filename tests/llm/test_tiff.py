import os
import struct

import pytest

from loftline.llm import tiff


@pytest.mark.parametrize("codec", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("tiled", [False, True])
@pytest.mark.parametrize("predictor", [False, True])
def test_round_trip(codec, tiled, predictor):
    for payload in (os.urandom(64), bytes(640), (b"hello world " * 3000)[: 64 * 500], os.urandom(64 * 200)):
        pages = tiff.read_tiff(tiff.write_tiff(payload, codec, tiled, predictor))
        assert [p["error"] for p in pages] == [None] * len(pages) and b"".join(p["data"] for p in pages) == payload


def test_pages_are_walked_in_order():
    payload = os.urandom(64 * (tiff.PAGE_ROWS * 2 + 5))
    pages = tiff.read_tiff(tiff.write_tiff(payload, tiff.DEFLATE, False, False))
    assert [(p["page"], p["height"]) for p in pages] == [(0, tiff.PAGE_ROWS), (1, tiff.PAGE_ROWS), (2, 5)]


def test_big_endian_sixteen_bits():
    samples = struct.pack(">4H", 1, 5, 1000, 65535)
    tags = [(256, 4, 2), (257, 4, 2), (258, 3, 16), (259, 3, 1), (262, 3, 1), (273, 4, 8 + 2 + 12 * 9 + 4), (277, 3, 1), (278, 4, 2), (279, 4, 8)]
    entries = b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">I", v) if k == 4 else struct.pack(">HH", v, 0)) for t, k, v in tags)
    page = tiff.read_tiff(struct.pack(">2sHI", b"MM", 42, 8) + struct.pack(">H", 9) + entries + bytes(4) + samples)[0]
    assert page["error"] is None and struct.unpack("=4H", page["data"]) == (1, 5, 1000, 65535)


def test_damage_gives_errors_not_crashes(spark):
    good = tiff.write_tiff(os.urandom(6400), tiff.DEFLATE, True, False)
    loop = bytearray(good)
    n = struct.unpack_from("<H", loop, 8)[0]
    struct.pack_into("<I", loop, 10 + 12 * n, 8)
    rows = [(1, good), (2, good[:-300]), (3, b"nothing"), (4, b""), (5, None), (6, bytes(loop)), (1, good)]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "id long, content binary, page string")
    got = {}
    for r in tiff.with_pages(df).collect():
        got.setdefault(r.id, []).append([p.error is None for p in r.pages])
    assert got[1] == [[True], [True]] and got[5] == [[]] and got[6] == [[True]]
    assert not any(any(x) for i in (2, 3, 4) for x in got[i])
    assert tiff.pages(df.drop("page")).where("id = 1").count() == 2 and tiff.with_pages(df.limit(0)).collect() == []


def test_store_pads_and_repeats(spark):
    df = spark.createDataFrame([(1, b"abc"), (2, None), (3, b""), (4, b"abc"), (5, b"x" * 64)], "id long, p binary")
    got = {r.id: bytes(r.media) for r in tiff.store(df, "p").collect()}
    data = {i: b"".join(p["data"] for p in tiff.read_tiff(m)) for i, m in got.items()}
    assert got[1] == got[4] and got[2] == got[3]
    assert data[1] == b"abc" + bytes(61) and data[2] == bytes(64) and data[5] == b"x" * 64
