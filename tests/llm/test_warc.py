import base64
import gzip
import hashlib
import time
import zlib

from loftline.llm import warc


def record(i, kind="response", payload=None):
    payload = payload if payload is not None else f"page {i} ".encode() * 40
    return warc.write_record(kind, i, f"http://h/{i}\r\nX: 1", payload, hashlib.sha256(payload).hexdigest(), 0)


def ids(data):
    return [(f and f.get("x-page-id"), bool(r)) for _, _, f, _, r in warc.salvage(data)]


def test_damaged_members_are_skipped_and_logged():
    parts = [record(i) for i in range(6)]
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 255
    data = b"".join([*parts[:2], bytes(broken), parts[3], b"noise", parts[4], parts[5][:-20]])
    found = list(warc.salvage(data))
    assert [f["x-page-id"] for _, _, f, _, _ in found if f] == ["0", "1", "3", "4"]
    gaps = [(o, n) for o, n, f, _, r in found if r]
    start = len(parts[0]) + len(parts[1])
    assert gaps == [(start, len(broken)), (start + len(broken) + len(parts[3]), 5), (len(data) - len(parts[5]) + 20, len(parts[5]) - 20)]
    assert sum(n for _, n, *_ in found) == len(data)


def test_plain_records_resume_at_a_version_line():
    parts = [zlib.decompress(record(i), 31) for i in range(4)]
    wrong = parts[1].replace(b"page 1 page", b"page X page", 1)
    assert ids(b"".join([parts[0], wrong, parts[2], b"???\r\n", parts[3]])) == [("0", False), (None, True), ("2", False), (None, True), ("3", False)]
    assert ids(b"") == [] and ids(b"only noise") == [(None, True)]


def test_pages_come_back(spark):
    same, short = "same text " * 30, "tiny"
    rows = [(3, "u3", same), (1, "u1", same), (2, None, same), (4, "u4", short), (5, "u5", short), (6, "u6", None), (7, "u7", ""),
            (None, "n", same), (8, "u8", "é" * 300_000), (1, "u1", same)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = warc.read_archives(warc.build_archives(warc.plan_records(df)))
    out = sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()], key=str)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = html == same and i != 1
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 1 if revisit else None))
    assert out == sorted(want, key=str)
    assert warc.read_archives(warc.build_archives(warc.plan_records(df.limit(0)))).collect() == []


def test_files(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(record(1) + record(2))
    (tmp_path / "b.warc").write_bytes(b"x\n" + zlib.decompress(record(3), 31))
    got = warc.read_files(spark, str(tmp_path)).collect()
    assert sorted(r.page_id for r in got if r.record_type) == [1, 2, 3] and [r.length for r in got if r.reason] == [2]


def test_a_record_right_behind_payload_bytes_is_found():
    parts = [zlib.decompress(record(i), 31) for i in range(3)]
    assert ids(b"".join([parts[0], parts[1][:-60], parts[2]])) == [("0", False), (None, True), ("2", False)]


def test_a_member_of_several_records():
    parts = [zlib.decompress(record(i), 31) for i in range(3)]
    whole = gzip.compress(b"".join([parts[0], parts[1][:-60], parts[2]]))
    data = record(7) + whole + record(8)
    assert ids(data) == [("7", False), ("0", False), (None, True), ("2", False), ("8", False)]
    assert sum(n for _, n, *_ in warc.salvage(data)) == len(data)


def test_numbers_of_the_whole_bigint_range():
    for n in (2**63 - 1, -(2**63), 0):
        assert warc._number(str(n)) == n
    assert warc._number(str(2**63)) is None and warc._number("x") is None


def foreign(kind, digest, block, extra=b""):
    head = b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <urn:uuid:a>\r\nWARC-Payload-Digest: " + digest + b"\r\n" + extra
    return head + b"Content-Type: application/http\r\nContent-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_digests_of_public_archives():
    payload = b"hello there " * 20
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 240\r\n\r\n" + payload
    sha1 = base64.b32encode(hashlib.sha1(payload).digest())
    rows = [warc._row(*x) for x in warc.salvage(foreign(b"response", b"sha1:" + sha1, block) + foreign(b"response", b"crc9:77", block))]
    assert [(r["record_type"], r["payload_digest"], r["payload_bytes"]) for r in rows] == [("response", hashlib.sha256(payload).hexdigest(), 240)] * 2
    (bad,) = [warc._row(*x) for x in warc.salvage(foreign(b"response", b"sha1:" + sha1, block[:-1] + b"?"))]
    assert bad["reason"] == "payload digest differs" and "record_type" not in bad
    revisit = foreign(b"revisit", b"sha1:" + sha1, block[: -len(payload)], b"WARC-Refers-To: <urn:uuid:b>\r\n")
    (got,) = [warc._row(*x) for x in warc.salvage(revisit)]
    assert (got["payload_bytes"], got["refers_to_record"], got["payload_digest"]) == (240, "<urn:uuid:b>", "sha1:" + sha1.decode())


def test_revisits_name_their_record_as_the_format_says():
    data = warc.write_record("revisit", 5, "u5", b"x" * 200, "00", 1, "u1")
    (fields,) = [f for _, _, f, _, _ in warc.salvage(data)]
    assert fields["warc-refers-to"] == warc.record_id(1, "u1") and fields["warc-refers-to-target-uri"] == "u1" and fields["warc-refers-to-date"]


def test_junk_is_searched_once():
    for junk in (b"\x1f\x8b\x08" * 60_000, b"WARC/1.0\r\n" * 20_000, b"WARC/1.0\r\nno colon\r\n" * 10_000):
        start = time.perf_counter()
        assert ids(junk + record(1)) == [(None, True), ("1", False)]
        assert time.perf_counter() - start < 2
