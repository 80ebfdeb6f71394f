"""WARC archives: a writer with payload deduplication and a splittable reader.

Writer. Every row becomes one gzip member holding one WARC/1.1 record. Among rows with equal
payloads of at least ``min_dedup_bytes`` bytes the row with the largest id is a ``response``; the
others are ``revisit`` records without a body that refer to it. Each task writes one archive under a
name of its own attempt and reports it in a manifest, so the file of a lost or speculative attempt
is never read.

Reader. A task owns a byte range of an archive. It looks for the gzip magic, takes a place for a
member only if what it decodes to begins with a WARC header, and owns the records that start inside
its range, reading past the end of the range to finish the last one. Nothing else has to be known
about record boundaries, so one archive can be read by many tasks.

Defined cases: a null payload is an empty one; a null id is kept as null and never serves as a
target of a revisit unless all ids of its group are null; rows that repeat an id and a payload are
all responses when that id is the group's largest; payloads and urls of any length are written whole
and read back, line breaks and unprintable characters of a url as %XX; columns other than id, payload and
url are ignored, whatever their names; an empty table gives no archives and no records;
a member whose body fails its checksum raises.

Archives of others are read too: digests in hex or base 32 of any kind in DIGESTS, HTTP messages, whose
payload is their body, and folded header lines. A member that begins as a WARC record but has a malformed
header, or none that says its length, raises; ``incomplete`` compares what was read with the manifest.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodalis.llm.common import bitmap, fresh_path, staged, table, with_membership

MAGIC = b"\x1f\x8b\x08"
BLOCK = 1 << 20
HEADER_LIMIT = 1 << 16
MIN_DEDUP_BYTES = 1000
SPLIT_BYTES = 16 << 20
#: Digests that are compared with payloads.
DIGESTS = ("md5", "sha1", "sha256", "sha512")

_MANIFEST = "path string, bytes long, records long"
_RECORDS = "warc_type string, record_id string, target_uri string, refers_to_id string, payload_digest string, payload_bytes long, payload binary, archive string, offset long"


def classify(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int = MIN_DEDUP_BYTES) -> DataFrame:
    """Add payload, payload_digest, payload_bytes, record_type and refers_to to ``pages``.

    Groups with more than one member, of which there are digest and largest id only, are staged. A bitmap
    of their digests clears most rows where they lie; the others meet the groups in a join of plain
    exchanges, which Spark can split where one payload holds a large part of the rows.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    base = pages.select(
        F.col(id_col).alias("record_key"),
        (F.col("url") if "url" in pages.columns else F.lit(None).cast("string")).alias("target_uri"),
        payload.alias("payload"),
        F.sha1(payload).alias("payload_digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
    )
    keepers = staged(
        base.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.max("record_key").alias("keeper"), F.count(F.lit(1)).alias("members"))
        .where(F.col("members") > 1)
        .select("payload_digest", "keeper"),
        "warc-keepers",
    )
    revisit = F.col("keeper").isNotNull() & ~F.col("record_key").eqNullSafe(F.col("keeper"))
    told = with_membership(base, "payload_digest", {"repeats": staged(bitmap(keepers, "payload_digest"), "warc-repeats")})
    lone = told.where("NOT repeats").withColumn("keeper", F.lit(None).cast(keepers.schema["keeper"].dataType))
    return lone.unionByName(told.where("repeats").join(keepers, "payload_digest", "left").select(lone.columns)).select(
        "record_key",
        "target_uri",
        F.when(~revisit, F.col("payload")).alias("payload"),
        "payload_digest",
        "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("keeper")).alias("refers_to"),
    )


def _urn(key: object) -> str:
    return f"<urn:page:{'' if key is None else key}>"


def key_of(urn):
    """The row's id from a record id, as a column."""
    return F.expr(f"try_cast(nullif(regexp_extract({urn}, '^<urn:page:(.*)>$', 1), '') as bigint)")


def _one_line(text: str) -> str:
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in text)


def _member(row: dict) -> bytes:
    payload = (row["payload"] or "").encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {_urn(row['record_key'])}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        f"X-Payload-Length: {row['payload_bytes']}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(payload)}",
    ]
    if row["target_uri"] is not None:
        head.append(f"WARC-Target-URI: {_one_line(row['target_uri'])}")
    if row["record_type"] == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {_urn(row['refers_to'])}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n") + packer.flush()


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        path = f"{base}/part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        out, size, records = None, 0, 0
        for batch in batches:
            columns = batch.to_pydict()
            for row in (dict(zip(columns, values, strict=True)) for values in zip(*columns.values(), strict=True)):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(path, compression=None)
                member = _member(row)
                out.write(member)
                size, records = size + len(member), records + 1
        if out is not None:
            out.close()
            name = f"{folder}/{path.rsplit('/', 1)[1]}"
            yield pa.RecordBatch.from_pydict({"path": [name], "bytes": [size], "records": [records]})

    return write


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Write classified records as archives in ``folder``; the manifest (path, bytes, records)."""
    return staged(records.mapInArrow(_writer(folder), _MANIFEST), "warc-manifest")


def archives(spark: SparkSession, glob: str) -> DataFrame:
    """A manifest of existing archives; the content column is pruned, so only the listing is read."""
    return spark.read.format("binaryFile").load(glob).select("path", F.col("length").alias("bytes"))


class _Range:
    """Buffered reads from one archive."""

    def __init__(self, store: pafs.FileSystem, path: str, size: int):
        self.file, self.size, self.at, self.data = store.open_input_file(path), size, 0, b""

    def block(self, offset: int) -> bytes:
        if not (self.at <= offset < self.at + len(self.data)):
            self.at, self.data = offset, self.file.read_at(min(BLOCK, max(0, self.size - offset)), offset)
        return self.data[offset - self.at :] if offset > self.at else self.data

    def find(self, offset: int, stop: int) -> int:
        """The first gzip magic that begins in [offset, stop), or -1."""
        while offset < stop:
            data = self.block(offset)
            if len(data) < len(MAGIC) and offset + len(data) < self.size:
                self.at, self.data = offset, self.file.read_at(min(BLOCK, self.size - offset), offset)
                data = self.data
            hit = data.find(MAGIC)
            if hit >= 0:
                return offset + hit if offset + hit < stop else -1
            if offset + len(data) >= self.size:
                return -1
            offset += max(1, len(data) - len(MAGIC) + 1)
        return -1


def _headers(decoded: bytes, start: int) -> dict[str, str] | None:
    """The header fields of a record, folded lines put together; None if no WARC record begins here."""
    if not decoded.startswith(b"WARC/1."):
        return None
    fields: list[str] = []
    for line in decoded.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and fields:
            fields[-1] += " " + line.strip()
        elif ":" in line:
            fields.append(line)
        else:
            raise ValueError(f"malformed header of the WARC record at {start}: {line[:80]!r}")
    found = {k.strip().lower(): v.strip() for k, v in (f.split(":", 1) for f in fields)}
    if not found.get("content-length", "").isdigit():
        raise ValueError(f"the WARC record at {start} has no Content-Length")
    return found


def _named_digest(value: str) -> tuple[str, str]:
    """(algorithm, lower-case hex) of a digest in hex or base 32; ("", value) if it is in neither."""
    name, _, text = value.rstrip("=").rpartition(":")
    name = name.lower().replace("-", "") or "sha1"
    if name not in DIGESTS:
        return "", text
    size = hashlib.new(name).digest_size
    try:
        found = bytes.fromhex(text) if len(text) == 2 * size else base64.b32decode(text.upper() + "=" * (-len(text) % 8))
    except ValueError:
        return "", text
    return (name, found.hex()) if len(found) == size else ("", text)


def _begins_warc(data: bytes) -> bool:
    """Whether a damaged member (with the ten-byte gzip header) still starts like a WARC record."""
    try:
        return zlib.decompressobj(-15).decompress(data[10:], HEADER_LIMIT).startswith(b"WARC/1.")
    except zlib.error:
        return False


def _record(source: _Range, start: int, with_payload: bool) -> tuple[dict, int] | None:
    """The record of the member at ``start`` and the offset behind it; None if no WARC member is there."""
    inflate = zlib.decompressobj(31)
    head, offset, headers = b"", start, None
    digest, stated, length, kept, tail = hashlib.sha1(), None, 0, [], b""
    lead: bytes | None = None  # what has been read of an HTTP header, while it has not ended
    coded = False
    while not inflate.eof:
        data = inflate.unconsumed_tail
        if not data:
            data = source.block(offset)
            offset += len(data)
            if not data:
                if headers is None:
                    return None
                raise ValueError(f"truncated WARC member at {start}")
        try:
            out = inflate.decompress(data, BLOCK)
        except zlib.error:
            if headers is None and not _begins_warc(source.block(start)):
                return None
            raise
        if headers is None:
            head += out
            end = head.find(b"\r\n\r\n")
            if end < 0:
                if not head.startswith(b"WARC/1."[: len(head)]):
                    return None
                continue
            headers = _headers(head[:end], start)
            if headers is None:
                return None
            left, out = int(headers["content-length"]), head[end + 4 :]
            lead = b"" if headers.get("content-type", "").lower().startswith("application/http") else None
            algorithm, named = _named_digest(headers.get("warc-payload-digest", ""))
            stated = hashlib.new(algorithm) if algorithm not in ("", "sha1") else digest
        body = out[:left]
        left -= len(body)
        tail += out[len(body) :]
        if lead is not None:  # the payload of an HTTP message is its body
            lead += body
            ended = lead.find(b"\r\n\r\n", max(0, len(lead) - len(body) - 3))
            if ended < 0:
                continue
            coded = b"transfer-encoding:" in lead[:ended].lower()
            body, lead = lead[ended + 4 :], None
        digest.update(body)
        if stated is not digest:
            stated.update(body)
        length += len(body)
        if with_payload:
            kept.append(body)
    if headers is None:
        return None
    if left or tail.strip(b"\r\n"):
        raise ValueError(f"WARC record at {start} does not match its Content-Length")
    revisit = headers.get("warc-type") == "revisit"
    # Payloads in a transfer encoding may be digested decoded; digests of unknown kinds are not compared.
    if not revisit and algorithm and not coded and named != stated.hexdigest():
        raise ValueError(f"payload digest of the WARC record at {start} does not match")
    record = {
        "warc_type": headers.get("warc-type"),
        "record_id": headers.get("warc-record-id"),
        "target_uri": headers.get("warc-target-uri"),
        "refers_to_id": headers.get("warc-refers-to"),
        "payload_digest": named if revisit else digest.hexdigest(),
        "payload_bytes": int(headers.get("x-payload-length", length)) if revisit else length,
        "payload": None if revisit or not with_payload else b"".join(kept),
        "offset": start,
    }
    return record, offset - len(inflate.unused_data) - len(inflate.unconsumed_tail)


def records_in_range(uri: str, size: int, start: int, end: int, with_payload: bool) -> Iterator[dict]:
    """The records of an archive that begin in [start, end)."""
    store, path = pafs.FileSystem.from_uri(uri)
    source, at = _Range(store, path, size), start
    while (at := source.find(at, end)) >= 0:
        found = _record(source, at, with_payload)
        if found is None:
            at += 1
            continue
        record, behind = found
        yield record | {"archive": uri}
        at = behind


def manifest_of(spark: SparkSession, uris: list[str]) -> DataFrame:
    """A manifest of archives from elsewhere; how many records they hold is not known."""
    rows = []
    for uri in uris:
        store, path = pafs.FileSystem.from_uri(uri)
        rows.append((uri, store.get_file_info(path).size, None))
    return spark.createDataFrame(rows, _MANIFEST)


def incomplete(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """(path, records, found): the archives of which not as many records were read as the manifest says."""
    found = records.groupBy(F.col("archive").alias("path")).agg(F.count(F.lit(1)).alias("found"))
    both = manifest.select("path", "records").join(found, "path", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return both.where("records <> found")


def _reader(with_payload: bool, rows: int = 256):
    schema = pa.schema([(n, pa.binary() if t == "binary" else pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in _RECORDS.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for split in batch.to_pylist():
                pending: list[dict] = []
                for record in records_in_range(split["path"], split["bytes"], split["start"], split["end"], with_payload):
                    pending.append(record)
                    if len(pending) == rows:
                        yield pa.RecordBatch.from_pylist(pending, schema=schema)
                        pending = []
                if pending:
                    yield pa.RecordBatch.from_pylist(pending, schema=schema)

    return read


def read_warc(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """Records of all archives of a manifest; each split of ``split_bytes`` is dealt to one task."""
    ranges = manifest.select("path", "bytes", F.explode(F.expr(f"sequence(0L, greatest(bytes - 1, 0L), {split_bytes}L)")).alias("start"))
    ranges = ranges.withColumn("end", F.least(F.col("start") + split_bytes, F.col("bytes")))
    splits = max(1, ranges.count())
    return ranges.repartition(splits).mapInArrow(_reader(with_payload), _RECORDS)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    manifest = write_warc(classify(table(spark, sf_dir, "pages"), "page_id", "html"), folder)
    records = read_warc(manifest, with_payload=False)
    return records.select(
        key_of("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("warc_type").alias("record_type"),
        key_of("refers_to_id").alias("refers_to"),
    )


OP1_SQL = """
WITH b AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT page_id, n, h, max(page_id) OVER (PARTITION BY h) AS keeper FROM b)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM k
"""
