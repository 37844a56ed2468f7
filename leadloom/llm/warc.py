"""WARC archives of pages: chunked transfer framing, segments, revisits, and their reassembly.

Writing. A record is one row of bytes, and the text writer with the record separator as its line separator puts rows into
gzip files that hold nothing but WARC records, through Spark's committer: a lost task writes its file again, any file system will do.
The block of a response is an HTTP message whose body is framed in chunks. A block longer than ``SEGMENT`` bytes is cut: the first segment
stays in the response record, the others are continuation records with the origin's id and a segment number, the last with the total length.
Of equal payloads of at least ``REVISIT`` bytes, the row with the largest page_id is a response and the others are revisit records that refer to it.

Reading. A gzip file is one task, which streams its lines through a parser that holds one record at a time. Whole records are decoded at once.
Segments are grouped by origin, ordered by number, checked (numbers without gaps, one total, and the sum of the lengths equals it) and joined; then
chunks are decoded and the payload is held against its digest. Only segments, and what a revisit needs of its response (id, page, length), travel.
A file of any other archive can be read as well, as long as it is gzip and its records end as they should.

Defined cases: null html is the empty payload; a null page_id or url has no header, and stays null; rows with one page_id and equal payloads are
repeats: if they have the largest id of their payload, all are responses, and revisits then name the page but no record; page ids that are not integers are
not supported; an empty table gives an archive without pages; other columns are ignored. Damage (missing or doubled segments, wrong length or
digest, broken chunks) leaves the row, with ``error`` set and a null payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import materialise, new_path

SEGMENT, CHUNK, REVISIT, FILE_BYTES = 32 << 10, 8 << 10, 1000, 256 << 20
#: When pages were fetched, as they do not say it.
FETCHED = datetime(2024, 1, 1, tzinfo=UTC)
#: Fixed values of the format.
VERSION, END = b"WARC/1.1", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


# ---- records


def frame(payload: bytes, chunk: int = CHUNK) -> bytes:
    """The body in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(part), part) for part in (payload[lo : lo + chunk] for lo in range(0, len(payload), chunk))]
    return b"".join([*parts, b"0\r\n\r\n"])


SIZE = re.compile(rb"([0-9A-Fa-f]+)[ \t]*(?:;[^\r\n]*)?\r\n")


def unframe(body: bytes) -> bytes:
    """The payload of chunks; extensions and trailers are dropped. ValueError if a chunk is broken or the last one is missing."""
    parts, at = [], 0
    while True:
        size = SIZE.match(body, at)
        if not size:
            raise ValueError("chunk")
        n, at = int(size[1], 16), size.end()
        if n == 0:
            return b"".join(parts)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk")
        parts.append(body[at : at + n])
        at += n + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP message."""
    head, gap, body = block.partition(END)
    if not gap:
        raise ValueError("http")
    fields = dict(_fields(head.split(b"\r\n")[1:]))
    if fields.get("transfer-encoding", "").lower() == "chunked":
        return unframe(body)
    length = fields.get("content-length")
    return body if length is None else body[: int(length)]


def _fields(lines: Iterable[bytes]) -> Iterator[tuple[str, str]]:
    for line in lines:
        name, _, value = line.partition(b":")
        yield name.strip().lower().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace")


def record(fields: dict[str, object], block: bytes) -> bytes:
    """A record without the two line ends behind it. Fields that are None are left out; line ends in values become spaces."""
    lines = [VERSION, *(f"{k}: {re.sub(r'[\r\n]+', ' ', str(v))}".encode() for k, v in fields.items() if v is not None)]
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(block), b"", block])


def record_id(*parts: object) -> str:
    """An id that is the same whenever a task runs again."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(parts).encode()).digest()[:16], version=5)}>"


def sha1_name(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def page_records(page_id: int | None, url: str | None, payload: bytes, sha256: str, keep_id: int | None, revisit: bool, named: bool, number: int | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of a row. number: what tells repeats apart, if there are any; named: the response that a revisit refers to has an id of its own."""
    own = record_id(page_id, sha256, number)
    date = FETCHED.strftime("%Y-%m-%dT%H:%M:%SZ")
    fields = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": own, "WARC-Date": date, "WARC-Target-URI": url, "WARC-Page": page_id,
        "WARC-Payload-Digest": sha1_name(hashlib.sha1(payload).digest()), "Content-Type": "application/http;msgtype=response",
    }
    if revisit:
        more = {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(keep_id, sha256, None) if named else None, "WARC-Refers-To-Date": date, "WARC-Refers-To-Page": keep_id}
        yield record(fields | more, HTTP)
        return
    block = HTTP + frame(payload)
    fields["WARC-Block-Digest"] = sha1_name(hashlib.sha1(block[:segment]).digest())
    if len(block) <= segment:
        yield record(fields, block)
        return
    yield record(fields | {"WARC-Segment-Number": 1}, block[:segment])
    cuts = range(segment, len(block), segment)
    for k, lo in enumerate(cuts, 2):
        part = block[lo : lo + segment]
        last = lo + segment >= len(block)
        yield record({
            "WARC-Type": "continuation", "WARC-Record-ID": record_id(own, k), "WARC-Date": date, "WARC-Target-URI": url, "WARC-Segment-Origin-ID": own, "WARC-Segment-Number": k,
            "WARC-Block-Digest": sha1_name(hashlib.sha1(part).digest()), "WARC-Segment-Total-Length": len(block) if last else None,
        }, part)


# ---- writing


def _payload():
    return F.coalesce("html", F.lit(""))


def revisit_plan(pages: DataFrame, least: int = REVISIT) -> DataFrame:
    """page_id, sha256 of the rows that share their payload: keep_id (the response's), revisit, repeated (the row itself), named (the response is not)."""
    bytes_ = F.octet_length(_payload()).cast("long")
    rows = pages.select("page_id", F.sha2(_payload(), 256).alias("sha256"), bytes_.alias("bytes")).groupBy("sha256", "bytes", "page_id").agg(F.count("*").alias("n"))
    rows = materialise(rows, "payloads")
    shared = rows.groupBy("sha256").agg(F.max(F.struct("page_id", "n")).alias("keep"), F.sum("n").alias("all")).where("all > 1").select("sha256", "keep")
    found = rows.join(shared, "sha256")
    keep = F.when(F.col("bytes") >= least, F.col("keep.page_id"))
    revisit = (F.col("bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("keep.page_id"))
    marks = found.select("page_id", "sha256", keep.alias("keep_id"), revisit.alias("revisit"), (F.col("n") > 1).alias("repeated"), (F.col("keep.n") == 1).alias("named"))
    return materialise(marks.where("revisit or repeated"), "revisits")


def write_archive(pages: DataFrame, segment: int = SEGMENT, least: int = REVISIT, file_bytes: int = FILE_BYTES) -> str:
    """Write a record for each row of pages (page_id, url, html), as gzip files of about file_bytes each; the folder."""
    marks = revisit_plan(pages, least).select(F.col("page_id").alias("of_page"), F.col("sha256").alias("of_sha"), "keep_id", "revisit", "repeated", "named")
    sha = F.sha2(_payload(), 256)
    numbered = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), _payload().cast("binary").alias("payload"), sha.alias("sha256"), F.monotonically_increasing_id().alias("number"))
    rows = numbered.join(marks, (F.col("sha256") == F.col("of_sha")) & F.col("page_id").eqNullSafe(F.col("of_page")), "left").select(
        "page_id", "url", "payload", "sha256", "number", "keep_id", F.coalesce("revisit", F.lit(False)), F.coalesce("repeated", F.lit(False)), F.coalesce("named", F.lit(True))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size = [], 0
        for batch in batches:
            for page_id, url, payload, sha256, number, keep_id, revisit, repeated, named in zip(*batch.columns, strict=True):
                number = number.as_py() if repeated.as_py() else None
                for one in page_records(page_id.as_py(), url.as_py(), payload.as_py(), sha256.as_py(), keep_id.as_py(), revisit.as_py(), named.as_py(), number, segment):
                    made.append(one)
                    size += len(one)
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])
                    made, size = [], 0
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    path = new_path(pages.sparkSession, "warc")
    records = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    records.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", max(1, file_bytes // segment)).text(path)
    return path


# ---- reading


class Parser:
    """Records of a stream of lines; it holds one record at a time."""

    def __init__(self):
        self.fields: dict[str, str] | None = None
        self.head: list[bytes] | None = None
        self.block: list[bytes] = []
        self.left = 0

    def feed(self, line: bytes) -> Iterator[tuple[dict[str, str], bytes | None]]:
        """line: with its line end. Yields (fields, block); a block of None is a record that ended early."""
        if self.fields is not None:
            take = line[: self.left]
            self.block.append(take)
            self.left -= len(take)
            if not self.left:
                yield self._done()
        elif self.head is not None:
            if line.rstrip(b"\r\n"):
                self.head.append(line.rstrip(b"\r\n"))
            else:
                self.fields, self.head = dict(_fields(self.head)), None
                length = self.fields.get("content-length", "")
                self.left = int(length) if length.isdigit() else 0
                if not self.left:
                    yield self._done()
        elif line.startswith(b"WARC/"):
            self.head = []

    def end(self) -> Iterator[tuple[dict[str, str], bytes | None]]:
        if self.fields is not None:
            yield self.fields, None
        self.__init__()

    def _done(self) -> tuple[dict[str, str], bytes]:
        out = self.fields, b"".join(self.block)
        self.__init__()
        return out


RECORDS = (
    "type string, id string, page_id long, url string, digest string, refers_to string, refers_page long, origin string, number int, total long, "
    "block binary, payload binary, payload_bytes long, payload_digest string, error string"
)
TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, TYPES[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def _hex(digest: str | None) -> str | None:
    """A labelled SHA-1, in base 32 or 16, as bare hex; None for other digests."""
    label, _, value = (digest or "").partition(":")
    if label.lower() != "sha1":
        return None
    return base64.b32decode(value).hex() if re.fullmatch("[A-Z2-7]{32}", value) else value.lower()


def _decoded(block: bytes, digest: str | None) -> tuple:
    """payload, payload_bytes, payload_digest, error of the block of a response."""
    try:
        payload = payload_of(block)
    except ValueError as e:
        return None, None, None, str(e)
    found = hashlib.sha1(payload).hexdigest()
    return (None, None, None, "payload digest") if digest and digest != found else (payload, len(payload), found, None)


def _record_row(fields: dict[str, str], block: bytes | None, payloads: bool) -> tuple:
    """A row of ``RECORDS``: whole responses are decoded, segments keep their block."""

    def number(name: str) -> int | None:
        value = fields.get(name, "")
        return int(value) if re.fullmatch(r"-?\d{1,18}", value) else None

    kind, segment, digest = fields.get("warc-type"), number("warc-segment-number"), _hex(fields.get("warc-payload-digest"))
    named, done, error = _hex(fields.get("warc-block-digest")), (None, None, None), None
    if block is None:
        error = "record cut short"
    elif named and named != hashlib.sha1(block).hexdigest():
        error = "block digest"
    elif kind == "response" and segment is None:
        *done, error = _decoded(block, digest)
        done[0] = done[0] if payloads else None
    held = block if segment is not None or kind == "continuation" else None
    return (
        kind, fields.get("warc-record-id"), number("warc-page"), fields.get("warc-target-uri"), digest, fields.get("warc-refers-to"), number("warc-refers-to-page"),
        fields.get("warc-segment-origin-id"), segment, number("warc-segment-total-length"), held, *done, error,
    )


def read_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row a record (``RECORDS``). Payloads of whole responses are left out unless asked for; their lengths and digests are there."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.xxhash64(F.input_file_name()).alias("file"), F.col("value").cast("binary").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, file, rows, size = Parser(), None, [], 0
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != file:
                    rows.extend(_record_row(*x, payloads) for x in parser.end())
                    file = name
                for fields, block in parser.feed(value + b"\n"):
                    rows.append(_record_row(fields, block, payloads))
                    size += len(block or b"") + 500
                if size > 1 << 20:
                    yield _batch(rows, RECORDS)
                    rows, size = [], 0
        rows.extend(_record_row(*x, payloads) for x in parser.end())
        if rows:
            yield _batch(rows, RECORDS)

    return lines.mapInArrow(run, RECORDS)


RESPONSES = "id string, page_id long, url string, payload binary, payload_bytes long, payload_digest string, error string"


def joined(parts: list[dict]) -> bytes:
    """The block of segments in the order of their numbers. ValueError if one is missing, doubled or damaged or the total is another."""
    for p in parts:
        if p["error"]:
            raise ValueError(p["error"])
    if [p["number"] for p in parts] != list(range(1, len(parts) + 1)):
        raise ValueError("segment numbers")
    block = b"".join(p["block"] for p in parts)
    if [p["total"] for p in parts] != [None] * (len(parts) - 1) + [len(block)]:
        raise ValueError("total length")
    return block


def reassemble(records: DataFrame, payloads: bool = False) -> DataFrame:
    """Responses (``RESPONSES``) that came in segments, in any order and from any file."""
    first = F.col("type") == "response"
    head = F.max(F.when(first, F.struct("page_id", "url", "digest"))).alias("head")
    parts = F.sort_array(F.collect_list(F.struct("number", "total", "block", "error"))).alias("parts")
    # a group is the segments of one record, which one row of pages brings
    segments = records.where("type = 'continuation' or (type = 'response' and number is not null)")
    groups = segments.groupBy(F.when(first, F.col("id")).otherwise(F.col("origin")).alias("id")).agg(head, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, head, parts in zip(*batch.columns, strict=True):
                head = head.as_py() or {"page_id": None, "url": None, "digest": None}
                try:
                    payload, *rest = _decoded(joined(parts.as_py()), head["digest"])
                except ValueError as e:
                    payload, *rest = None, None, None, str(e)
                yield _batch([(id_.as_py(), head["page_id"], head["url"], payload if payloads else None, *rest)], RESPONSES)

    return groups.mapInArrow(run, RESPONSES)


def read_archive(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row a response or revisit: page_id, url, record_type, refers_to (a page), payload (null unless asked for), payload_bytes, payload_digest, error.

    A revisit gets length and payload from the response that it names by record id, or else by digest."""
    records = materialise(read_records(spark, path, payloads), "records")
    fields = [c.split()[0] for c in RESPONSES.split(", ")]
    whole = records.where("type = 'response' and number is null").select(fields)
    found = materialise(whole.unionByName(reassemble(records, payloads)), "responses")
    out = ["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest", "error"]
    answers = found.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")}).select(out)

    revisits = records.where("type = 'revisit'").select("page_id", "url", "digest", F.col("refers_to").alias("of_id"), "refers_page", F.col("error").alias("own_error"))
    original = found.where("error is null").select(
        F.col("id").alias("of_id"), F.col("page_id").alias("of_page"), F.col("payload_digest").alias("of_digest"), "payload", "payload_bytes"
    )
    by_id = revisits.where("of_id is not null").join(original.drop("of_digest"), "of_id", "left")
    any_of = original.groupBy("of_digest").agg(F.max("of_page").alias("of_page"), F.first("payload").alias("payload"), F.first("payload_bytes").alias("payload_bytes"))
    nameless = revisits.where("of_id is null")
    by_digest = nameless.join(any_of, nameless["digest"] == any_of["of_digest"], "left").drop("of_digest")
    again = by_id.unionByName(by_digest).select(
        "page_id", "url", F.lit("revisit").alias("record_type"), F.coalesce("of_page", "refers_page").alias("refers_to"), "payload", "payload_bytes",
        F.col("digest").alias("payload_digest"), F.coalesce("own_error", F.when(F.isnull("payload_bytes"), F.lit("no response"))).alias("error"),
    )
    return answers.unionByName(again.select(out))


def round_trip(pages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: pages written to archives and read back."""
    pages = pages.select("page_id", "url", "html")
    found = read_archive(pages.sparkSession, write_archive(pages, segment))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
