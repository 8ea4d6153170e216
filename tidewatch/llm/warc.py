"""WARC archives compressed with zstd: a frame per record, after a shared dictionary.

An archive starts with a skippable frame that holds the dictionary; every record is
a frame of its own, compressed with it. Archives are written by Spark's text sink,
so they commit and recover like any output and go to any store that Spark knows: the
"line separator" is an empty skippable frame, which every zstd reader steps over.

Reading walks the frames of a file, loads the dictionary from the first, decodes
one record at a time and checks what it says about itself.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.registry import query, table
from tidewatch.llm.tables import col
from tidewatch.session import scratch_path

FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
DICTIONARY_MAGIC = 0x184D2A5D
SEPARATOR = struct.pack("<II", 0x184D2A50, 0)   # an empty skippable frame, plain ASCII
DATE = "2024-01-01T00:00:00Z"                   # of all records: archives repeat exactly
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
SAMPLE_ROWS, SAMPLE_BYTES = 300, 65536          # the dictionary learns from so many payloads, each at most so long
DICTIONARY_BYTES = 32768
LEVEL = 3
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SCHEMA = ("archive string, record_type string, page_id long, url string, payload binary, payload_bytes long, "
          "payload_digest string, refers_to long, error string")


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, by expressions: 20 bits at a time."""
    digest = F.sha1(payload)
    out = []
    for i in range(8):
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), (F.shiftright(bits, s).bitwiseAND(31) + 1), F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def planned(pages: DataFrame, min_bytes: int, page_id: str, url: str, html: str) -> DataFrame:
    """Rows as records: type, digest and what a revisit refers to.

    Of equal payloads the row of the largest id is the response; groups meet as
    one aggregated row, never in one task.
    """
    body = F.encode(F.coalesce(col(html), F.lit("")), "UTF-8")
    rows = pages.select(col(page_id).cast("long").alias("page_id"), col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    first = rows.groupBy("digest").agg(F.max("page_id").alias("first"))
    own = F.col("page_id").eqNullSafe(F.col("first")) | (F.octet_length("payload") < min_bytes)
    return rows.join(first.hint("shuffle_hash"), "digest").select(
        "page_id", "url", "payload", "digest", F.when(own, F.lit(None)).otherwise(F.col("first")).alias("refers_to"),
        (~own).alias("revisit"))


def dictionary(records: DataFrame) -> bytes:
    """Trained on a bounded sample of payloads, the first by digest; raw content if they are too few.

    Tasks send digests to choose from; only the chosen payloads follow.
    """
    some = records.filter(f"octet_length(payload) BETWEEN 1 AND {SAMPLE_BYTES}").select("digest", "payload")
    chosen = [r["digest"] for r in some.select("digest").distinct().orderBy("digest").limit(SAMPLE_ROWS).collect()]
    found = some.filter(F.col("digest").isin(chosen)).dropDuplicates(["digest"]) if chosen else some.limit(0)
    samples = [bytes(r["payload"]) for r in found.orderBy("digest").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit: bool, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}",
            f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=';/?:@&=+$,#%[]!~*()' + chr(39))}")
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    if not (urn.startswith("<urn:page:") and urn.endswith(">")):
        raise ValueError(f"record id {urn[:80]!r}")
    number = urn[10:-1]
    return None if number == "null" else int(number)


def write_archives(pages: DataFrame, path: str, *, min_bytes: int = 0, page_id: str = "page_id", url: str = "url",
                   html: str = "html") -> None:
    """One archive per partition under ``path``; NULL html is an empty payload.

    Rows that repeat the largest id of their payload are responses as well; a group
    without any id has only responses. A NULL url has no target header.
    """
    records = planned(pages, min_bytes, page_id, url, html)
    shared = pages.sparkSession.sparkContext.broadcast(
        dictionary(pages.select(F.encode(F.coalesce(col(html), F.lit("")), "UTF-8").alias("payload"))
                   .withColumn("digest", F.sha1("payload"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        trained = zstandard.ZstdCompressionDict(words) if words else None
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True)
        started = False
        for batch in batches:
            frames = [press.compress(record(*row)) for row in zip(*(c.to_pylist() for c in batch.columns))]
            if frames and not started:
                frames.insert(0, struct.pack("<II", DICTIONARY_MAGIC, len(words)) + words)
                started = True
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])

    frames = records.select("page_id", "url", "payload", "digest", "revisit", "refers_to").mapInArrow(run, "frame binary")
    frames.select(F.col("frame").cast("string")).write.option("lineSep", SEPARATOR.decode()).text(path)


def frames_of(data: memoryview) -> Iterator[tuple[int, memoryview]]:
    """The frames of an archive, each with its magic; raises where the file is cut short."""
    at = 0
    while at < len(data):
        if len(data) - at < 8:
            raise ValueError(f"archive ends inside a frame at byte {at}")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            end = at + 8 + size
            if end > len(data):
                raise ValueError(f"archive ends inside a frame at byte {at}")
            yield magic, data[at + 8:end]
        elif data[at:at + 4] == FRAME_MAGIC:
            checksum = zstandard.get_frame_parameters(data[at:at + 18]).has_checksum
            end, last = at + zstandard.frame_header_size(data[at:at + 18]), False
            while not last:
                if end + 3 > len(data):
                    raise ValueError(f"archive ends inside a frame at byte {at}")
                head = int.from_bytes(data[end:end + 3], "little")
                last = bool(head & 1)
                end += 3 + (1 if (head >> 1) & 3 == 1 else head >> 3)
            end += 4 * checksum
            if end > len(data):
                raise ValueError(f"archive ends inside a frame at byte {at}")
            yield 0, data[at:end]
        else:
            raise ValueError(f"no frame at byte {at}")
        at = end


def parsed(raw: bytes) -> dict:
    """One record, its headers, lengths and digest checked."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC header")
    names = dict(line.partition(":")[::2] for line in lines[1:])
    names = {k: v.strip() for k, v in names.items()}
    lacking = [k for k in REQUIRED if k not in names]
    if lacking:
        raise ValueError(f"no {', '.join(lacking)}")
    size = int(names["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {size} of a block of {len(rest) - 4}")
    http, gap, payload = rest[:size].partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no HTTP header")
    sizes = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    digest = names.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    revisit = names["WARC-Type"] == "revisit"
    if revisit and (payload or "WARC-Refers-To" not in names):
        raise ValueError("revisit with a payload or without a reference")
    if not revisit:
        if sizes != [len(payload)]:
            raise ValueError(f"HTTP length {sizes} of a payload of {len(payload)}")
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError("payload does not match its digest")
    return {"record_type": names["WARC-Type"], "page_id": _page(names["WARC-Record-ID"]), "url": names.get("WARC-Target-URI"),
            "payload": None if revisit else payload, "payload_bytes": sizes[0], "payload_digest": digest,
            "refers_to": _page(names["WARC-Refers-To"]) if revisit else None, "error": None}


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record. A record that fails a check is a row with only ``error``; a file
    that is cut short ends with such a row."""
    wanted = [f.strip().split(" ")[0] for f in SCHEMA.split(",")]
    kinds = {"page_id": pa.int64(), "payload": pa.binary(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}

    def records(name: str, data: memoryview) -> Iterator[dict]:
        press = zstandard.ZstdDecompressor()
        try:
            for i, (magic, body) in enumerate(frames_of(data)):
                if magic:
                    if i == 0 and magic == DICTIONARY_MAGIC and len(body):
                        press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(body)))
                    continue
                try:
                    yield {"archive": name, **parsed(press.decompress(body))}
                except (ValueError, zstandard.ZstdError) as wrong:
                    yield {"archive": name, "error": str(wrong)}
        except (ValueError, zstandard.ZstdError) as wrong:
            yield {"archive": name, "error": str(wrong)}

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r.get(c) if payloads or c != "payload" else None for r in rows], kinds.get(c, pa.string())) for c in wanted],
            names=wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                for one in records(name, memoryview(content.as_buffer()).cast("B")):
                    rows.append(one)
                    size += len(one.get("payload") or b"") if payloads else 0
                    if len(rows) >= 2000 or size > 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
        if rows:
            yield batch_of(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, SCHEMA)


_DIGITS = " || ".join(f"substr('{BASE32}', (((('0x' || substr(h, {5 * i + 1}, 5))::BIGINT) >> {shift}) & 31) + 1, 1)"
                      for i in range(8) for shift in (15, 10, 5, 0))


@query("op4_warc_archives", f"""WITH p AS (SELECT page_id, coalesce(html, '') AS b FROM pages),
  d AS (SELECT page_id, b, sha1(b) AS h FROM p), g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM d)
SELECT page_id, CAST(strlen(b) AS BIGINT) AS payload_bytes, {_DIGITS} AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to FROM g""")
def op4_warc_archives(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    found = read_archives(spark, path, payloads=False)
    sound = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("string")).otherwise(F.col("record_type"))
    return found.select("page_id", "payload_bytes", "payload_digest", sound.alias("record_type"), "refers_to")
