"""WARC archives: writing captures, reading records back, and assembling the transactions they belong to."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, small, staged, unstage

#: Payloads at least so long are written once; later captures of the same bytes refer to that one.
REVISIT_BYTES = 1000
FILE_BYTES = 8 << 20
#: Archives are read so many bytes at a time, and records handed on when they have about so many.
PIECE_BYTES, BATCH_BYTES = 1 << 16, 2 << 20
EOL = "\r\n"
PRIMARY = ("response", "revisit", "resource")
RECORDS = "record_id string, type string, concurrent_to string, refers_to string, uri string, date string, payload_digest string, payload_bytes long, block string, payload binary, file string"


def _header(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value)


def _record(kind: Column | str, id_: Column, uri: Column, more: list[Column], content_type: str, block: Column) -> Column:
    """One record without the two line ends that close it; null headers are left out."""
    lines = [F.lit("WARC/1.0"), _header("WARC-Type", kind), _header("WARC-Record-ID", id_), _header("WARC-Date", "2020-01-01T00:00:00Z"), _header("WARC-Target-URI", uri), *more]
    return F.concat(F.concat_ws(EOL, *lines, _header("Content-Type", content_type), _header("Content-Length", F.octet_length(block).cast("string"))), F.lit(EOL * 2), block)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def write_warc(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Writes a request, a response or revisit, and a metadata record for every row (page_id, url, html) of pages.

    The payload is the html in UTF-8; null html is an empty payload. Of rows with equal payloads of at least
    ``revisit_bytes`` bytes, those with the largest page_id are responses and the others revisits that refer to
    one; if all their page_ids are null, all are responses. Request and metadata name the response or revisit in
    WARC-Concurrent-To. Files are gzipped, of about FILE_BYTES of records each. Control characters and spaces of
    URLs are percent-encoded in headers; the metadata record keeps page_id and url exactly. Rows may repeat.
    """
    body = F.coalesce("html", F.lit(""))
    base = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("page_id").cast("long").alias("n"), "url", body.alias("body"))
    base = base.withColumns({"bytes": F.octet_length("body").cast("long"), "digest": F.sha1("body")})
    digests = staged(base.select("n", "digest", "bytes"), "digests")
    mean = digests.agg(F.coalesce(F.avg("bytes"), F.lit(0.0))).first()[0]
    alike = staged(digests.where(F.col("bytes") >= revisit_bytes).groupBy("digest", "bytes").agg(F.max("n").alias("last"), F.count("*").alias("rows")).where("rows > 1 and last is not null").drop("rows"), "alike")
    out = base.join(small(alike), ["digest", "bytes"], "left")
    twice = staged(digests.groupBy("n", "digest").agg(F.count("*").alias("rows")).where("rows > 1").drop("rows"), "twice")
    if twice.isEmpty():
        out = out.withColumn("nth", F.lit(1))
    else:  # repeated rows need record ids of their own
        same = [out["n"].eqNullSafe(twice["n"]), out["digest"] == twice["digest"]]
        again = out.join(small(twice), same, "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("n", "digest").orderBy("url")))
        out = out.join(small(twice), same, "left_anti").withColumn("nth", F.lit(1)).unionByName(again)
    revisit = F.col("last").isNotNull() & ~F.col("n").eqNullSafe(F.col("last"))
    own = [F.coalesce("page_id", F.lit("null")), F.col("digest"), F.col("nth").cast("string")]
    main, ask, about = (_urn(F.lit(k), *own) for k in ("main", "request", "metadata"))
    first = _urn(F.lit("main"), F.col("last").cast("string"), F.col("digest"), F.lit("1"))
    uri = F.coalesce("url", F.lit(""))
    for code in [*range(33), 127]:
        uri = F.replace(uri, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    sha = _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    status = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("bytes").cast("string"), F.lit(EOL * 2))
    told = F.to_json(F.struct("page_id", "url"))
    with_main = [_header("WARC-Concurrent-To", main)]
    profile = [F.when(revisit, _header("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), F.when(revisit, _header("WARC-Refers-To", first))]
    records = F.array(
        _record("request", ask, uri, with_main, "application/http; msgtype=request", F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{EOL}{EOL}"))),
        _record(F.when(revisit, "revisit").otherwise("response"), main, uri, [sha, *profile], "application/http; msgtype=response", F.concat(status, F.when(revisit, "").otherwise(F.col("body")))),
        _record("metadata", about, uri, with_main, "application/json", told),
    )
    per_file = max(3, int(3 * FILE_BYTES / (mean + 1500)))
    out.select(F.explode(records).alias("value")).write.option("lineSep", EOL * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def _inflate(data: bytes) -> Iterator[bytes]:
    """The contents of an archive, piece by piece: gzip members one after another, or plain records from where there is no member."""
    view, at = memoryview(data), 0
    while at < len(data):
        if data[at : at + 2] != b"\x1f\x8b":
            for lo in range(at, len(data), PIECE_BYTES):
                yield bytes(view[lo : lo + PIECE_BYTES])
            return
        z = zlib.decompressobj(31)
        while not z.eof:
            if at >= len(data):
                raise ValueError("a gzip member is cut short")
            chunk = view[at : at + PIECE_BYTES]
            at += len(chunk)
            if part := z.decompress(chunk):
                yield part
        at -= len(z.unused_data)


class _Reader:
    """Takes bytes off a stream of pieces, of which it holds no more than it must."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.held, self.at, self.done = pieces, bytearray(), 0, 0

    def _more(self) -> bool:
        part = next(self.pieces, None)
        if part is None:
            return False
        if self.at > PIECE_BYTES:
            del self.held[: self.at]
            self.at = 0
        self.held += part
        return True

    def upto(self, mark: bytes) -> bytes | None:
        """What stands before mark, which is taken, too; None if it does not come."""
        look = self.at
        while (end := self.held.find(mark, look)) < 0:
            behind = len(self.held) - self.at
            if not self._more():
                return None
            look = max(self.at, self.at + behind - len(mark))
        out = bytes(self.held[self.at : end])
        self.done += end + len(mark) - self.at
        self.at = end + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n and self._more():
            pass
        out = bytes(self.held[self.at : self.at + n])
        self.at += len(out)
        self.done += len(out)
        return out

    def rest(self) -> bool:
        return len(self.held) > self.at or self._more()


def _parse(pieces: Iterator[bytes], name: str, payloads: bool) -> Iterator[tuple]:
    source = _Reader(pieces)
    while source.rest():
        at = source.done
        head = source.upto(b"\r\n\r\n")
        lines = (head or b"").split(b"\r\n")
        if head is None or not lines[0].startswith(b"WARC/"):
            raise ValueError(f"{name}: no record at byte {at}")
        h = {k.strip().lower(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:])}
        n = int(h[b"content-length"])
        block = source.take(n)
        if len(block) < n or source.take(4) != b"\r\n\r\n":
            raise ValueError(f"{name}: record at byte {at} is cut short")
        kind, digest, size, payload, text = h.get(b"warc-type"), None, None, None, None
        if kind in PRIMARY:
            http, _, rest = block.partition(b"\r\n\r\n")
            text = http.decode("utf-8", "replace")
            if kind == "revisit":
                said = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])}
                digest, size = h.get(b"warc-payload-digest", "").rpartition(":")[2] or None, int(said.get(b"content-length", b"0"))
            else:
                digest, size, payload = hashlib.sha1(rest).hexdigest(), len(rest), rest if payloads else None
                if h.get(b"warc-payload-digest", f"sha1:{digest}") != f"sha1:{digest}":
                    raise ValueError(f"{name}: payload of {h.get(b'warc-record-id')} is damaged")
        else:
            text = block.decode("utf-8", "replace")
        yield h.get(b"warc-record-id"), kind, h.get(b"warc-concurrent-to"), h.get(b"warc-refers-to"), h.get(b"warc-target-uri"), h.get(b"warc-date"), digest, size, text, payload, name


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of plain or gzipped archives under path: a row each, payload null unless payloads are asked for.

    Members are inflated piece by piece and records handed on as they come, so that a task holds an archive as it is
    stored, and a few records. payload_digest is the hex SHA-1 of a response's payload as read (checked against its
    header) or, of a revisit, what its header says; payload_bytes of a revisit is what its HTTP header says. A damaged archive is an error.
    """
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                rows, held = [], 0
                for row in _parse(_inflate(data), name, payloads):
                    rows.append(row)
                    held += 500 + len(row[8] or "") + len(row[9] or b"")
                    if held > BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(parse, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, request, response (or revisit, or resource) and metadata.

    A request or metadata record belongs to the record its WARC-Concurrent-To names, also by way of any number of
    other requests or metadata records; a response that itself names a request draws that request to it. Records that
    name nothing stand alone, as do those that name one another in a circle. request and response are structs (null
    if missing; of several the one with the largest record_id), metadata an array of structs ordered by record_id.
    Records without a type or id are left out.
    """
    known = records.where("type is not null and record_id is not null")
    primary = F.col("type").isin(*PRIMARY)
    up = known.where("concurrent_to is not null").select(F.when(primary, F.col("concurrent_to")).otherwise(F.col("record_id")).alias("id"), F.when(primary, F.col("record_id")).otherwise(F.col("concurrent_to")).alias("up"))
    up = staged(up.groupBy("id").agg(F.min("up").alias("up")), "up")
    open_ = before = None
    while True:  # each round a record names what the one that it names does
        on = staged(up.join(up.select(F.col("id").alias("up"), F.col("up").alias("next")), "up"), "chains")
        n = on.count()
        if not n or n == open_ and n == before:
            break
        before, open_ = open_, n
        further = staged(up.join(on.select("id", "next"), "id", "left").select("id", F.coalesce("next", "up").alias("up")), "up")
        unstage(up, on)
        up = further
    circles = on.select("id")
    rest = known.where(~primary).withColumn("id", F.col("record_id")).join(up, "id", "left").join(circles.withColumn("circle", F.lit(True)), "id", "left")
    rest = rest.withColumn("root", F.when(F.col("circle"), F.col("record_id")).otherwise(F.coalesce("up", "record_id"))).select(*known.columns, "root")
    every = known.where(primary).withColumn("root", F.col("record_id")).unionByName(rest)
    one = F.struct("record_id", *[c for c in records.columns if c != "record_id"])
    return every.groupBy(F.col("root").alias("capture_id")).agg(
        F.max(F.when(F.col("type") == "request", one)).alias("request"),
        F.max(F.when(F.col("type").isin(*PRIMARY), one)).alias("response"),
        F.array_sort(F.collect_list(F.when(~F.col("type").isin("request", *PRIMARY), one))).alias("metadata"),
    )


def archive_pages(pages: DataFrame, path: str | None = None, payloads: bool = False) -> DataFrame:
    """Writes pages to archives under path (default: a new folder in the shared one), reads them back and assembles the captures.

    Adds to assemble()'s columns page_id and url, from the capture's metadata record, and refers_to, the page_id of
    the response a revisit refers to. An empty table gives no captures.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_warc(pages, path)
    records = staged(read_warc(spark, path, payloads), "records")
    told = F.from_json(F.col("metadata")[0]["block"], "page_id string, url string")
    captures = staged(assemble(records).withColumn("told", told).withColumns({"page_id": F.col("told.page_id"), "url": F.col("told.url")}).drop("told"), "captures")
    wanted = captures.select(F.col("response.refers_to").alias("id")).where("id is not null").distinct()
    named = staged(captures.select(F.col("capture_id").alias("id"), F.col("page_id").alias("refers_to")).join(wanted, "id", "left_semi"), "named")
    return captures.withColumn("id", F.col("response.refers_to")).join(small(named), "id", "left").drop("id")
