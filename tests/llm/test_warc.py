import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from nodalis.llm import warc
from nodalis.llm.common import fresh_path

SCHEMA = "page_id long, url string, html string, payload string, record_type int"


def rows():
    draw = random.Random(6)
    out = [(i, f"http://x/{i}\r\nbad", "".join(draw.choice("<p>é \n\U0001f600abc") for _ in range(draw.choice([0, 10, 999, 1000, 3000]))), "clash", 7) for i in range(60)]
    same = "é" * 700
    out += [(100 + i, None, same, "clash", 7) for i in range(25)] + [(200, "u", None, "x", 7), (201, "u", "", "x", 7), (202, "u", "short", "x", 7), (203, "u", "short", "x", 7)]
    out += [(None, "u", same, "x", 7), (124, "u", same, "x", 7), (300, "u", "\x1f\x8b\x08WARC/1.1\r\n\r\n" * 5000, "x", 7)]
    return out


def brute(data):
    groups = {}
    for page_id, _, html, *_ in data:
        payload = (html or "").encode()
        if len(payload) >= 1000:
            groups.setdefault(payload, []).append(page_id)
    out = []
    for page_id, _, html, *_ in data:
        payload = (html or "").encode()
        ids = [i for i in groups.get(payload, []) if i is not None]
        revisit = len(groups.get(payload, [])) > 1 and ids and page_id != max(ids)
        out.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", max(ids) if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", [300, 5000, 1 << 24])
def test_round_trip_at_any_split(spark, split):
    data = rows()
    pages = spark.createDataFrame(data, SCHEMA).repartition(3)
    manifest = warc.write_warc(warc.classify(pages, "page_id", "html"), fresh_path(spark, "warc-test"))
    assert manifest.agg(F.sum("records")).first()[0] == len(data)
    got = warc.read_warc(manifest, split_bytes=split)
    back = got.select(warc.key_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "warc_type", warc.key_of("refers_to_id").alias("refers_to"), "payload").collect()
    assert sorted((tuple(r)[:5] for r in back), key=str) == brute(data)
    payloads = {d[0]: (d[2] or "").encode() for d in data}
    assert all(r.payload == payloads[r.page_id] for r in back if r.warc_type == "response")
    found = warc.archives(spark, manifest.first().path.rsplit("/", 1)[0] + "/*.warc.gz")
    assert found.agg(F.sum("bytes")).first()[0] == manifest.agg(F.sum("bytes")).first()[0]


def test_members_are_plain_gzip(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 2000, "c", 1)], SCHEMA)
    path = warc.write_warc(warc.classify(pages, "page_id", "html"), fresh_path(spark, "warc-test")).first().path
    text = gzip.open(path.removeprefix("file:")).read()
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(b"x\r\n\r\n")


def test_damage_and_empty(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", str(i) * 3000, "c", 1) for i in range(4)], SCHEMA).coalesce(1)
    row = warc.write_warc(warc.classify(pages, "page_id", "html"), fresh_path(spark, "warc-test")).first()
    data = bytearray(open(row.path.removeprefix("file:"), "rb").read())
    junk = tmp_path / "junk.warc.gz"
    junk.write_bytes(b"\x1f\x8b\x08 no member" + bytes(data) + b"\x1f\x8b\x08")
    assert len(list(warc.records_in_range(str(junk), junk.stat().st_size, 0, junk.stat().st_size, True))) == 4
    data[-6] ^= 1  # the last member's checksum
    junk.write_bytes(data)
    with pytest.raises(Exception):
        list(warc.records_in_range(str(junk), len(data), 0, len(data), True))
    empty = warc.write_warc(warc.classify(pages.limit(0), "page_id", "html"), fresh_path(spark, "warc-test"))
    assert warc.read_warc(empty).count() == 0


def test_very_long_urls(spark):
    draw = random.Random(3)
    urls = ["u", *("http://x/" + "".join(draw.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n)) for n in (70_000, 1_500_000, 2_500_000)), "v"]
    pages = spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(urls)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_warc(warc.classify(pages, "page_id", "html"), fresh_path(spark, "long-urls"))
    got = warc.read_warc(manifest, split_bytes=500_000).select(warc.key_of("record_id").alias("id"), "target_uri", "payload").collect()
    assert sorted((r.id, r.target_uri, bytes(r.payload).decode()) for r in got) == [(i, u, f"page {i}") for i, u in enumerate(urls)]


def foreign(name, head, block):
    lines = [b"WARC/1.0", *head, b"Content-Length: %d" % len(block)] if head is not None else [b"WARC/1.0"]
    return name, gzip.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n")


def digest(kind, data, base32=True):
    found = hashlib.new(kind, data).digest()
    return f"{kind}:{base64.b32encode(found).decode() if base32 else found.hex()}".encode()


BODY = b"<p>" + bytes(range(256)) * 9
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-Long: " + b"y" * 5000 + b"\r\n\r\n"
FOREIGN = [
    foreign("http", [b"WARC-Type: response", b"WARC-Record-ID: <http>", b"Content-Type: application/http; msgtype=response", b"WARC-Payload-Digest: " + digest("sha1", BODY)], HTTP + BODY),
    foreign("sha256", [b"WARC-Type: resource", b"WARC-Record-ID: <sha256>", b"WARC-Payload-Digest: " + digest("sha256", BODY, False)], BODY),
    foreign("base32", [b"WARC-Type: resource", b"WARC-Record-ID: <base32>", b"WARC-Payload-Digest: " + digest("sha256", BODY).rstrip(b"=")], BODY),
    foreign("folded", [b"WARC-Type: metadata", b"WARC-Record-ID:", b"\t<folded>", b"WARC-Target-URI: http://a/", b" b"], b""),
    foreign("unknown", [b"WARC-Type: resource", b"WARC-Record-ID: <unknown>", b"WARC-Payload-Digest: blake3:ABC"], b"x"),
    foreign("chunked", [b"WARC-Type: response", b"WARC-Record-ID: <chunked>", b"Content-Type: application/http", b"WARC-Payload-Digest: " + digest("sha1", b"abc")], b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n"),
    foreign("bare", [b"WARC-Type: request", b"WARC-Record-ID: <bare>", b"Content-Type: application/http"], b"GET / HTTP/1.1"),
    foreign("revisit", [b"WARC-Type: revisit", b"WARC-Record-ID: <revisit>", b"WARC-Payload-Digest: " + digest("sha1", BODY)], b""),
]


@pytest.mark.parametrize("split", [70, 1000, 1 << 24])
def test_archives_of_others(spark, tmp_path, split, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 512)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(data for _, data in FOREIGN))
    manifest = warc.manifest_of(spark, [f"file://{path}"])
    got = {r.record_id.strip("<>"): r for r in warc.read_warc(manifest, split).collect()}
    assert got.keys() == {name for name, _ in FOREIGN}
    assert all(bytes(got[n].payload) == BODY and got[n].payload_digest == hashlib.sha1(BODY).hexdigest() for n in ("http", "sha256", "base32"))
    assert got["folded"].target_uri == "http://a/ b" and bytes(got["bare"].payload) == b""
    assert got["revisit"].payload_digest == hashlib.sha1(BODY).hexdigest() and bytes(got["chunked"].payload).startswith(b"3\r\nabc")


@pytest.mark.parametrize("bad", [
    foreign("length", None, b"x")[1], foreign("line", [b"WARC-Type: resource", b"no colon"], b"x")[1],
    foreign("digest", [b"WARC-Type: resource", b"WARC-Payload-Digest: " + digest("sha1", b"y")], b"x")[1],
    foreign("http", [b"WARC-Type: response", b"Content-Type: application/http", b"WARC-Payload-Digest: " + digest("md5", HTTP + b"x")], HTTP + b"x")[1],
])
def test_unsound_records_of_others_raise(spark, tmp_path, bad):
    path = tmp_path / "a.warc.gz"
    path.write_bytes(FOREIGN[1][1] + bad + FOREIGN[3][1])
    with pytest.raises(Exception, match="WARC record at"):
        warc.read_warc(warc.manifest_of(spark, [f"file://{path}"]), 200).collect()


def test_manifest_tells_of_missing_records(spark):
    pages = spark.createDataFrame(rows(), SCHEMA)
    manifest = warc.write_warc(warc.classify(pages, "page_id", "html"), fresh_path(spark, "warc-manifest"))
    records = warc.read_warc(manifest, with_payload=False)
    assert warc.incomplete(manifest, records).count() == 0
    lost = warc.incomplete(manifest, records.where("record_id NOT LIKE '%200%'")).collect()
    assert len(lost) == 1 and lost[0].found == lost[0].records - 1
