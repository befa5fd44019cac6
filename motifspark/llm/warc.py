"""WARC archives (operator 10) in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames, frames into bundles. A bundle ends with the
seek table of the public seekable format; an index maps record identifiers to (frame, offset in the
frame). Bundles are bounded rows of a table that Spark writes, so any store that Spark can write
holds them and a lost executor costs no more than its task. `data` of a row is a complete .warc.zst
file.
"""

from __future__ import annotations

import hashlib
import struct
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifspark.llm.common import cut, lookup, small_batches, table

#: Uncompressed bytes after which a frame or a bundle is closed.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 8 << 20
#: Payloads of at least this many bytes are deduplicated.
DEDUP_BYTES = 100
#: Fixed values of the seekable format: skippable frame magic, footer magic.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

BUNDLES = "bundle string, data binary, index array<struct<id:string,frame:int,offset:long>>"


def _quoted(text: str) -> str:
    """Blanks, control characters, % and > as their bytes in hexadecimal, so that no identifier breaks a header."""
    return "".join(c if c > " " and c not in "%>\x7f\x85\u2028\u2029" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record(page, url, payload: bytes, digest: str, refers) -> bytes:
    """One WARC record. A revisit has the digest and size of the payload but not the payload."""
    block = HTTP if refers is not None else HTTP + payload
    # Control characters would break the header.
    uri = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else _quoted(str(page))}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {uri}"] if uri else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        *([] if refers is None else [f"WARC-Refers-To: <urn:page:{_quoted(str(refers))}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header fields, payload and end of the record at `at`."""
    end = data.index(b"\r\n\r\n", at)
    fields = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
    stop = end + 4 + int(fields["Content-Length"])
    return fields, data[end + 4 + len(HTTP) : stop], stop + 4


class BundleWriter:
    def __init__(self):
        import zstandard

        self.zstd = zstandard.ZstdCompressor(level=3)
        self.frames, self.index, self.open, self.size, self.total = [], [], [], 0, 0

    def add(self, name: str, data: bytes) -> None:
        self.index.append({"id": name, "frame": len(self.frames), "offset": self.size})
        self.open.append(data)
        self.size += len(data)
        self.total += len(data)
        if self.size >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            self.frames.append((self.zstd.compress(b"".join(self.open)), self.size))
            self.open, self.size = [], 0

    def finish(self) -> bytes:
        self.close_frame()
        body = b"".join(struct.pack("<II", len(c), n) for c, n in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        return b"".join(c for c, _ in self.frames) + struct.pack("<II", SKIPPABLE, len(body)) + body


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed, uncompressed size) of each frame, from the footer."""
    count, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    out, at = [], 0
    for compressed, plain in struct.iter_unpack("<II", data[len(data) - 9 - 8 * count : len(data) - 9]):
        out.append((at, compressed, plain))
        at += compressed
    return out


def frame(data: bytes, number: int) -> bytes:
    """One frame, without reading the others."""
    import zstandard

    at, compressed, plain = seek_table(data)[number]
    return zstandard.ZstdDecompressor().decompress(data[at : at + compressed], max_output_size=plain)


def write_bundles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", dedup_bytes: int = DEDUP_BYTES) -> DataFrame:
    """Bundles (bundle, data, index) that hold one record per input row.

    The payload is the html in UTF-8; null is empty. Of equal payloads of dedup_bytes or more, rows
    with the smallest id are responses (all of them, if that id repeats), others revisit it; rows of
    null ids revisit too, unless all ids are null, when all are responses. Other columns are
    ignored. An empty input gives no bundle.
    """
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), html.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    rows = rows.withColumn("key", F.when(F.length("payload") >= dedup_bytes, F.col("digest")))
    groups = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1")
    rows = lookup(rows, groups, "key", "n", pages.count())
    rows = rows.select("page", "url", "payload", "digest", F.expr("CASE WHEN first IS NOT NULL AND NOT first <=> page THEN first END").alias("refers"))

    def write(batches):
        from pyspark import TaskContext

        def row():
            data = writer.finish()
            name = f"{TaskContext.get().partitionId():06d}-{hashlib.sha256(data).hexdigest()[:24]}"
            index = pa.array([writer.index], pa.list_(pa.struct([("id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64())])))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary()), index], ["bundle", "data", "index"])

        writer = BundleWriter()
        for batch in batches:
            for page, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                writer.add("" if page is None else str(page), record(page, url, payload, digest, refers))
                if writer.total >= BUNDLE_BYTES:
                    yield row()
                    writer = BundleWriter()
        if writer.index:
            yield row()

    return rows.mapInArrow(write, BUNDLES)


def read_bundles(bundles: DataFrame, id_type: str = "long") -> DataFrame:
    """Records (page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of
    bundles; of a response, size and digest are those of the payload read. A payload that differs
    from its recorded digest raises. id_type is the type of the identifiers that were written; an
    identifier without any characters is null."""

    def identifier(text):
        return unquote(text.removeprefix("<urn:page:").removesuffix(">")) or None

    def read(batches):
        kinds = [("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("payload", pa.binary())]
        for batch in batches:
            for data in batch.column(0):
                data = data.as_py()
                for number in range(len(seek_table(data))):
                    plain, at, rows = frame(data, number), 0, []
                    while at < len(plain):
                        fields, payload, at = parse(plain, at)
                        kind, digest, size = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
                        if kind == "response" and (digest, size) != (hashlib.sha256(payload).hexdigest(), len(payload)):
                            raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
                        refers = identifier(fields["WARC-Refers-To"]) if kind == "revisit" else None
                        rows.append((identifier(fields["WARC-Record-ID"]), size, digest, kind, refers, fields.get("WARC-Target-URI"), payload if kind == "response" else None))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], [n for n, _ in kinds])

    found = bundles.select("data").mapInArrow(read, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, payload binary")
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def read_record(bundles: DataFrame, name: str) -> DataFrame:
    """One row `payload` of each record `name`: the index finds bundle, frame and offset, and one frame is
    decompressed where its bundle stands. No bundle reaches the driver."""
    found = bundles.select("data", F.explode("index").alias("i")).where(F.col("i.id") == name).select("data", "i.frame", "i.offset")

    def read(batches):
        for batch in batches:
            for data, number, offset in zip(*batch.columns):
                payload = parse(frame(data.as_py(), number.as_py()), offset.as_py())[1]
                yield pa.RecordBatch.from_arrays([pa.array([payload], pa.binary())], ["payload"])

    return found.mapInArrow(read, "payload binary")


def op10_warc(spark, sf_dir):
    bundles = cut(write_bundles(table(spark, sf_dir, "pages")))
    return read_bundles(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f"""
