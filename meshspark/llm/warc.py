"""Web archives: pages as WARC records, repeated payloads as revisits, large records in segments; and back."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialize, only, utf8

#: Bytes of a block that a record holds at most, before it goes on in continuation records; bytes of an HTTP chunk; of records written as one row; of an archive before compression.
SEGMENT, CHUNK, ROW, ARCHIVE = 1 << 14, 1 << 13, 1 << 22, 1 << 26
#: Repeated payloads that are broadcast at most; beyond, payloads meet by a shuffle, and only those with more than one in so many of all pages are broadcast.
FEW = 100_000
HOT_SHARE = 1000
#: Stands for the time of the crawl, which the table doesn't hold.
DATE = "2000-01-01T00:00:00Z"
END = b"\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends that close it; fields without a value are left out."""
    lines = [f"{k}: {v}" for k, v in [*fields, ("Content-Length", len(block))] if v is not None]
    return "\r\n".join(["WARC/1.1", *lines]).encode() + END + block


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    pieces = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in [*pieces, b""])


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunks; extensions of a size and trailers are passed over. A body that ends early is an error."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk's size is missing")
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        if body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk ends early")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def _uri(url: str | None) -> str | None:
    """Control characters can't stand in a header."""
    return None if url is None else re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def page_records(uid: str, page_id: int | None, url: str | None, payload: bytes, revisit: bool, head: int | None, head_url: str | None, segment: int) -> Iterator[bytes]:
    """The records of a page: a revisit without payload, or a response in chunks, cut into segments where it is longer than one."""
    name = lambda k: f"<urn:uuid:{hashlib.md5(f'{uid}/{k}'.encode(), usedforsecurity=False).hexdigest()}>"
    common = [("WARC-Date", DATE), ("WARC-Target-URI", _uri(url)), ("Page-Id", page_id), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http;msgtype=response")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisit:
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Target-URI", _uri(head_url)), ("WARC-Refers-To-Date", DATE), ("Refers-To-Page-Id", head)]
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", name(1)), *common, *more], http + b"Content-Length: %d" % len(payload) + END)
        return
    block = http + b"Transfer-Encoding: chunked" + END + chunked(payload)
    cuts = range(0, len(block), segment)
    for k, at in enumerate(cuts, 1):
        numbered = [("WARC-Segment-Number", k)] if len(cuts) > 1 else []
        if k == 1:
            yield record([("WARC-Type", "response"), ("WARC-Record-ID", name(1)), *common, *numbered], block[:segment])
        else:
            total = len(block) if k == len(cuts) else None
            yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", name(k)), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name(1)), *numbered, ("WARC-Segment-Total-Length", total)], block[at : at + segment])


def with_heads(pages: DataFrame, min_bytes: int, few: int) -> DataFrame:
    """pages(page_id, url, html) with _many (its payload repeats), _head and _head_url, of the smallest page_id with that payload.

    Only repeated payloads travel. They are broadcast if they are at most `few`; else pages and payloads
    meet by a shuffle on the payload's digest, but those that more than one page in HOT_SHARE has, of
    which there are fewer than HOT_SHARE, are broadcast, so that no key has more rows than that.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.withColumn("_key", F.when(F.octet_length(html) >= min_bytes, F.sha2(html, 256)))
    found = keyed.filter(F.col("_key").isNotNull()).groupBy("_key").agg(F.min("page_id").alias("_head"), F.min_by("url", "page_id").alias("_head_url"), F.count("*").alias("_many"))
    repeats = materialize(found.filter("_many > 1"), "repeats")
    if repeats.count() <= few:
        return keyed.join(F.broadcast(repeats), "_key", "left").drop("_key")
    total = pages.count()
    hot = repeats.filter(F.col("_many") * HOT_SHARE > total)
    out = keyed.join(F.broadcast(hot), "_key", "left").select(*pages.columns, F.col("_head").alias("_h"), F.col("_head_url").alias("_u"), F.col("_many").alias("_m"), "_key")
    own = F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string"))  # meets nothing and spreads
    out = out.withColumn("_key", F.when(F.col("_m").isNull() & F.col("_key").isNotNull(), F.col("_key")).otherwise(own))
    out = out.join(repeats.filter(F.col("_many") * HOT_SHARE <= total), "_key", "left")
    return out.select(*pages.columns, *(F.coalesce(a, b).alias(a) for a, b in (("_head", "_h"), ("_head_url", "_u"), ("_many", "_m"))))


def write_archives(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, segment: int = SEGMENT, few: int = FEW) -> None:
    """Write a record for each page to archives at path, as gzipped files of the text sink.

    The payload is the html in UTF-8 (null: empty). Of pages with equal payloads of min_bytes bytes or
    more, that with the smallest page_id is a response (each row, where one repeats it) and the others
    are revisits that refer to it; shorter ones are all responses. A null page_id is larger than any
    other; if no page of a payload has an id, all are responses. A null url is left out, control
    characters of one are percent-encoded. Other columns are ignored; no pages give archives without
    records. Payloads move only if more than `few` of them repeat, and no record is longer than
    `segment` bytes and its header.
    """
    p = with_heads(only(pages, page_id=page_id, url=url, html=html), min_bytes, few)
    revisit = F.col("_many").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_head"))
    p = p.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), "url", "html", revisit.alias("revisit"), "_head", "_head_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            row, page, link, _, again, head, head_link = (c.to_pylist() if i != 3 else None for i, c in enumerate(batch.columns))
            for i, payload in enumerate(utf8(batch.column(3))):
                for x in page_records(f"{page[i]}/{link[i]}/{row[i]}", page[i], link[i], payload, again[i], head[i], head_link[i], segment):
                    held.append(x)
                    size += len(x)
                    if size >= ROW:
                        yield pa.RecordBatch.from_pydict({"records": pa.array([END.join(held)], pa.binary())})
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"records": pa.array([END.join(held)], pa.binary())})

    written = p.mapInArrow(run, "records binary").select(F.col("records").cast("string").alias("value"))
    written.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", max(1, ARCHIVE // ROW)).text(path)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header by lower-case name, block) of each record of an archive, gzipped (in one member or many) or not; only one record is held."""
    f = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while line := f.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := f.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode(errors="replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        n = int(fields["content-length"])
        block = f.read(n)
        if len(block) < n:
            raise ValueError("an archive ends inside a record")
        yield fields, block


RAW = "origin string, number int, total long, record_type string, page_id long, url string, refers_to long, digest string, block binary"


def raw_records(files: DataFrame, segmented: bool) -> DataFrame:
    """The responses, revisits and continuations of files(content): those in segments, or those in one piece; other types are passed over."""
    names = [x.split()[0] for x in RAW.split(", ")]
    types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    whole = lambda h, k: int(h[k]) if k in h else None

    def rows(content: bytes) -> Iterator[tuple]:
        for h, block in parse(content):
            kind, number = h.get("warc-type"), whole(h, "warc-segment-number")
            if kind not in ("response", "revisit", "continuation") or (number is not None) != segmented:
                continue
            origin = h.get("warc-segment-origin-id") if kind == "continuation" else h.get("warc-record-id")
            yield origin, number, whole(h, "warc-segment-total-length"), kind, whole(h, "page-id"), h.get("warc-target-uri"), whole(h, "refers-to-page-id"), h.get("warc-payload-digest"), block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        table = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
        for batch in batches:
            for i in range(batch.num_rows):
                for row in rows(batch.column(0)[i].as_py()):
                    held.append(row)
                    size += len(row[-1]) + 200
                    if size >= ROW:
                        yield table()
                        held, size = [], 0
        if held:
            yield table()

    return files.select("content").mapInArrow(run, RAW)


def reassembled(segments: DataFrame) -> DataFrame:
    """The records that were cut into segments: header fields of the first, numbers and blocks by number, total length of the last."""
    of_first = lambda c: F.max(F.when(F.col("record_type") != "continuation", F.col(c))).alias(c)
    parts = F.array_sort(F.collect_list(F.struct("number", "block")))  # of one record
    out = segments.groupBy("origin").agg(*(of_first(c) for c in ("record_type", "page_id", "url", "refers_to", "digest")), F.max("total").alias("total"), parts.alias("parts"))
    return out.select("origin", "record_type", "page_id", "url", "refers_to", "digest", "total", F.col("parts.number").alias("numbers"), F.col("parts.block").alias("blocks"))


def decoded(kind: str | None, stated: str | None, numbers: list[int] | None, total: int | None, blocks: list[bytes]) -> tuple[bytes | None, int, str]:
    """(payload, its length, its digest) of a record; a revisit has no payload and its header speaks. Raises where segments, lengths or digests don't fit."""
    if kind is None:
        raise ValueError("the first segment is missing")
    block = b"".join(blocks)
    if numbers is not None:
        if numbers != [*range(1, len(numbers) + 1)]:
            raise ValueError(f"segments {numbers}")
        if total != len(block):
            raise ValueError(f"{len(block)} bytes instead of {total}")
    head, found, body = block.partition(END)
    if not found:
        raise ValueError("no HTTP header")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    stated = (stated or "").rpartition(":")[2] or None
    if kind == "revisit":
        return None, int(http[b"content-length"]), stated or ""
    coding = http.get(b"transfer-encoding", b"").lower()
    payload = unchunked(body) if coding == b"chunked" else body
    if (is_digest := digest(payload)) != (stated or is_digest):
        raise ValueError(f"digest {is_digest} instead of {stated}")
    return payload, len(payload), is_digest


READ = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, problem string"


def read_archives(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest, problem of every record of the archives at path.

    Continuations are grouped with their first segment by its id, wherever they lie, ordered by
    number and joined; the stated total length is verified, chunked transfer framing is decoded, and the
    digest of the payload is compared with the header's. Records in one piece don't move. A revisit has a
    null payload, and length and digest of its header. A record whose segments, lengths or digest don't fit is an
    error, or without `strict` a row with a problem and a null payload, length and digest. Each archive is read in one
    task, a record at a time. Archives without records give no rows.
    """
    files = spark.read.format("binaryFile").load(path)
    segments = reassembled(raw_records(files, True))
    no_numbers = F.lit(None).cast("array<int>")
    whole = raw_records(files, False).select("origin", "record_type", "page_id", "url", "refers_to", "digest", "total", no_numbers.alias("numbers"), F.array("block").alias("blocks"))
    names = [x.split()[0] for x in READ.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for r in batch.slice(at, 256).to_pylist():
                    try:
                        payload, n, name = decoded(r["record_type"], r["digest"], r["numbers"], r["total"], r["blocks"])
                        problem = None
                    except (ValueError, KeyError) as e:
                        if strict:
                            raise ValueError(f"record {r['origin']}: {e}") from e
                        payload, n, name, problem = None, None, None, str(e)
                    rows.append((r["page_id"], r["url"], r["record_type"], r["refers_to"], payload, n, name, problem))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return whole.unionByName(segments).mapInArrow(run, READ)
