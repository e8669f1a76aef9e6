"""WARC archives of pages, each record compressed on its own with a Zstandard dictionary.

A file starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself a
Zstandard frame; every record is one further frame, so any record can be read by its offset. A file's
first record is its warcinfo; each page is an HTTP response, of which a revisit has the headers only.
The dictionary is trained on a bounded sample of the records as they are archived, headers and all: those
of the ``sample`` pages of lowest hash, of each up to ``sample_bytes``. Both are parameters that bound
the driver's part and decide nothing but the compression. Too few records to train on serve as a raw
dictionary.

Of the records of equal payloads of at least ``min_bytes`` bytes, the one of the largest page_id is
a response, the others revisit it. Rows that repeat the largest page_id are responses all. Null html
is an empty payload. Records with a null page_id count as lower than any; if no other has the
payload, all are responses. Further columns are ignored. An empty table makes no files. A very long
page is one record. Pages have no time of their own: ``captured`` is every record's date, so that a
task that runs again writes the same bytes.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import storage
from lumenframe.llm.components import small

SKIPPABLE = 0x184D2A5D
DICTIONARY_BYTES = 64 * 1024
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of URLs (RFC 9562)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train(samples: list[bytes], size: int = DICTIONARY_BYTES):
    """A dictionary for ``samples``; their raw bytes if there are too few to train on."""
    import zstandard

    samples = [s for s in samples if s]
    if len(samples) >= 32:
        try:
            return zstandard.train_dictionary(size, samples, threads=0)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[:size] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def dictionary_frame(dictionary: bytes) -> bytes:
    import zstandard

    packed = zstandard.ZstdCompressor(level=9).compress(dictionary)
    return SKIPPABLE.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed


def record_id(page_id: int | None, uri: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id} {uri} {digest}')}>"


def uri_of(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A") or "about:blank"


def _record(fields: dict[str, str], body: bytes) -> bytes:
    head = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items()), f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def info(name: str, captured: str) -> bytes:
    """A file's first record."""
    fields = {"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(None, name, ""), "WARC-Date": captured, "WARC-Filename": name, "Content-Type": "application/warc-fields"}
    return _record(fields, b"software: lumenframe\r\nformat: WARC File Format 1.1\r\n")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: tuple[int, str | None] | None, captured: str) -> bytes:
    """The bytes of one WARC/1.1 record; ``refers_to``: page_id and url of the response that a revisit names."""
    uri = uri_of(url)
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id, uri, digest),
        "WARC-Date": captured,
        "WARC-Target-URI": uri,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "X-Payload-Length": str(len(payload)),
    }
    if page_id is not None:
        fields["X-Page-ID"] = str(page_id)
    if url is None:
        fields["X-No-URL"] = "1"
    if refers_to is not None:
        other, target = refers_to
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(other, uri_of(target), digest), "WARC-Refers-To-Target-URI": uri_of(target), "WARC-Refers-To-Date": captured, "X-Refers-To-Page-ID": str(other)}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _record(fields, http + payload if refers_to is None else http)


def parse(data: bytes) -> dict | None:
    """A page's record as a row; None for a warcinfo."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    if fields["WARC-Type"] == "warcinfo":
        return None
    _, _, body = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("X-Page-ID"),
        "url": None if "X-No-URL" in fields else fields["WARC-Target-URI"].replace("%0D", "\r").replace("%0A", "\n") if fields["WARC-Target-URI"] != "about:blank" else "",
        "payload_bytes": int(fields["X-Payload-Length"]) if revisit else len(body),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else digest_of(body),
        "record_type": fields["WARC-Type"],
        "refers_to": number("X-Refers-To-Page-ID"),
        "payload": None if revisit else body,
    }


def records_of(source) -> Iterator[dict]:
    """Every page's record of an open archive, one after another."""
    import zstandard

    magic, size = int.from_bytes(source.read(4), "little"), int.from_bytes(source.read(4), "little")
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    raw = zstandard.ZstdDecompressor().decompress(source.read(size))
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    rest = b""
    while True:
        frame, out = reader.decompressobj(), []
        while not frame.eof:
            rest = rest or source.read(1 << 20)
            if not rest:
                return
            out.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        row = parse(b"".join(out))
        if row:
            yield row


def _sample(source: DataFrame, size: int, most_bytes: int, captured: str) -> list[bytes]:
    """The records of ``size`` pages of lowest hash, cut at ``most_bytes``. Tasks send about twice as many in all, four times at most."""
    n = source.count()
    share = (2**63 - 1) * min(n, 2 * size) // max(n, 1)
    h = F.shiftrightunsigned(F.xxhash64("page_id", "url"), 1)
    rows = source.where(h <= F.lit(share)).select(h.alias("h"), "page_id", "url", F.substring(F.col("html").cast("binary"), 1, most_bytes).alias("t"), "sha1").limit(4 * size).collect()
    some = sorted(rows, key=lambda r: (r["h"], bytes(r["t"])))[:size]
    return [record(r["page_id"], r["url"], bytes(r["t"]), base64.b32encode(r["sha1"]).decode(), None, captured)[:most_bytes] for r in some]


def write(pages: DataFrame, folder: str, min_bytes: int = 0, sample: int = 500, file_bytes: int = 256 << 20, captured: str = "2024-01-01T00:00:00Z", sample_bytes: int = 32 << 10) -> list[dict]:
    """Archive ``pages`` (page_id, url, html) below ``folder``; a row per file: path, records.

    First the digests of payloads that occur more than once are found, from digests alone. The
    pages themselves stay in their partitions while those are few, else are joined with them. Files
    are named by partition and number, hold its records by page_id and are put in place whole, so a
    repeated task leaves the same.
    """
    import zstandard

    html = F.coalesce("html", F.lit(""))
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.unhex(F.sha1(html)).alias("sha1"))
    known = F.struct(F.col("page_id").isNotNull(), "page_id", "url")
    large = F.octet_length("html") >= min_bytes
    repeated = source.where(large).groupBy("sha1").agg(F.max(known).alias("last"), F.count("*").alias("n")).where("n > 1")
    winners = storage.cut(repeated.select("sha1", F.col("last.page_id").alias("winner"), F.col("last.url").alias("winner_url")))
    dictionary = train(_sample(source, sample, sample_bytes, captured)).as_bytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary))
        part, made, parts, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal made, parts, size
            name = f"pages-{part:06d}-{made:06d}.warc.zst"
            uri = f"{folder}/{name}"
            storage.put(uri, [dictionary_frame(dictionary), packer.compress(info(name, captured)), *parts])
            row = pa.RecordBatch.from_pylist([{"path": uri, "records": len(parts)}], pa.schema([("path", pa.string()), ("records", pa.int64())]))
            made, parts, size = made + 1, [], 0
            return row

        for batch in batches:
            for some in storage.by_size(batch, "html", 4_000_000):
                for page, url, text, sha1, winner, target in zip(*(some.column(k).to_pylist() for k in range(6)), strict=True):
                    parts.append(packer.compress(record(page, url, text, base64.b32encode(sha1).decode(), None if winner is None or winner == page else (winner, target), captured)))
                    size += len(parts[-1])
                if size >= file_bytes:
                    yield flush()
        if parts:
            yield flush()

    joined = source.join(small(winners), (source["sha1"] == winners["sha1"]) & large, "left")
    rows = joined.select("page_id", "url", F.col("html").cast("binary").alias("html"), source["sha1"].alias("sha1"), "winner", "winner_url")
    rows = rows.sortWithinPartitions("page_id", "url", "sha1")  # a task that runs again after a shuffle cuts its files alike
    out = storage.in_small_batches(rows).mapInArrow(work, "path string, records long")
    return [r.asDict() for r in out.collect()]


def read(spark: SparkSession, files: list[dict], payloads: bool = True) -> DataFrame:
    """Every record of the archives; ``payloads`` False leaves that column null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = storage.open_store(uri)
                with store.open_input_stream(path, compression=None) as source:
                    rows, size = [], 0
                    for r in records_of(source):
                        rows.append(r if payloads else r | {"payload": None})
                        size += r["payload_bytes"]
                        if size >= 4_000_000 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, kinds)

    names = spark.createDataFrame([(f["path"],) for f in files], "path string")
    return names.repartition(max(1, len(files))).mapInArrow(work, RECORDS)


#: What ``read`` tells of the archives of ``pages``, from the pages themselves; one row a page_id.
SQL = """
WITH digests AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, array_to_string(list_transform(string_split(sha1(coalesce(html, '')), ''),
        lambda c: lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0')), '') AS bits FROM pages
), named AS (
    SELECT page_id, payload_bytes, array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(generate_series(1, 5),
        lambda j: CASE WHEN substr(bits, CAST(5 * i + j AS INTEGER), 1) = '1' THEN 1 << CAST(5 - j AS INTEGER) ELSE 0 END))::INTEGER, 1)), '') AS payload_digest FROM digests
), last AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS winner FROM named
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> winner THEN winner END AS refers_to FROM last
"""
