"""Legacy archive converter: ARC files of version 1 and 2 into WARC records, and readers for both.

Archives are gzip text files whose records Spark writes and reads by lines. A gzip file is one split, so a task sees its
lines in order and holds one record at a time, however large the file. A record ends where its declared length says, not
at a separator, so payloads may hold any bytes.

Defined cases: a null payload is empty; a null or blank address becomes ``unknown:``; blanks and control characters in an
address are percent-encoded; a null id leaves the id header away; a record cut off by the end of its file and a line that
is no header are reported in ``problem`` and not converted; an empty table gives archives without records. Repeated rows
are separate records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratespark.llm.text import stored

#: Header fields of an ARC record by version of the file (fixed values of the format).
ARC_FIELDS = {
    1: ["url", "ip", "date", "mime", "length"],
    2: ["url", "ip", "date", "mime", "status", "checksum", "location", "offset", "file", "length"],
}
ARC_FIELD_NAMES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_HEADER = "X-Page-Id"
LENGTH_HEADER = "WARC-X-Payload-Length"
RECORD_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of addresses
DATE = re.compile(rb"\d{4,14}")

ARC_SCHEMA = (
    "file string, position long, version int, url string, ip string, date string, mime string, status string, "
    "content binary, problem string"
)
CONVERTED_SCHEMA = (
    "record_id string, record_type string, url string, ip string, date string, mime string, head binary, payload binary, "
    "payload_digest string, payload_bytes long, page_id long, problem string"
)
WARC_SCHEMA = (
    "record_id string, record_type string, url string, date string, page_id long, payload_digest string, "
    "declared_bytes long, refers_to_id string, payload binary, problem string"
)


# ---- writing ARC ------------------------------------------------------------------------------------------------

def write_arc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write each row as an ARC record, every other file by version 1 and 2 of the format."""
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    address = F.col(url)
    for code in [*range(33), 127]:
        address = F.replace(address, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    address = F.when(F.length(address) > 0, address).otherwise(F.lit("unknown:"))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.coalesce(F.concat(F.lit(f"\r\n{ID_HEADER}: "), F.col(page_id).cast("string")), F.lit("")),
        F.lit("\r\n\r\n"),
    )
    content = F.concat(F.encode(head, "UTF-8"), body)
    even = F.pmod(F.spark_partition_id(), F.lit(2)) == 0
    fields = F.concat_ws(" ", address, F.lit("0.0.0.0"), F.lit("20240101000000"), F.lit("text/html"))
    extra = F.when(even, "").otherwise(" 200 - - 0 pages.arc")
    line = F.concat(fields, extra, F.lit(" "), F.octet_length(content).cast("string"), F.lit("\n"))
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    lead = F.when(first, F.when(even, _arc_lead(1)).otherwise(_arc_lead(2))).otherwise("")
    record = F.concat(F.encode(F.concat(lead, line), "UTF-8"), content)
    pages.select(record.cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "gzip").text(path)


def _arc_lead(version: int) -> str:
    block = f"{version} 0 crawl\n{ARC_FIELD_NAMES[version]}\n"
    extra = "" if version == 1 else " 200 - - 0 pages.arc"
    return f"filedesc://pages.arc 0.0.0.0 20240101000000 text/plain{extra} {len(block)}\n{block}\n"


# ---- reading by lines -------------------------------------------------------------------------------------------

class Lines:
    """The bytes of one file after another, from Arrow batches of lines."""

    def __init__(self, batches: Iterator[pa.RecordBatch]) -> None:
        self.rows = (pair for batch in batches for pair in zip(batch["file"], batch["line"]))
        self.ahead: tuple[str, bytes] | None = None
        self.file: str | None = None

    def _peek(self) -> tuple[str, bytes] | None:
        if self.ahead is None and (pair := next(self.rows, None)) is not None:
            self.ahead = (pair[0].as_py(), pair[1].as_py())
        return self.ahead

    def next_file(self) -> str | None:
        """Name of the file that the next line belongs to; what is left of the former one is skipped."""
        while (pair := self._peek()) is not None and pair[0] == self.file:
            self.ahead = None
        self.file = pair[0] if pair else None
        return self.file

    def line(self) -> bytes | None:
        """The next line of this file, without its end."""
        pair = self._peek()
        if pair is None or pair[0] != self.file:
            return None
        self.ahead = None
        return pair[1]

    def block(self, length: int) -> tuple[bytes, bool]:
        """The next ``length`` bytes, and whether the file has them. What follows on the last line stays for ``line``."""
        parts, have = [], 0
        while have < length:
            line = self.line()
            if line is None:
                return b"".join(parts), have >= length
            parts += [line, b"\n"]
            have += len(line) + 1
        data = b"".join(parts)
        if have > length:
            self.ahead = (self.file, data[length:-1])
        return data[:length], True


def _lines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))


def _batches(records: Iterator[dict], schema: pa.Schema, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for record in records:
        rows.append(record)
        size += 500 + sum(len(v) for v in record.values() if isinstance(v, bytes))
        if size > limit:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


# ---- ARC to WARC ------------------------------------------------------------------------------------------------

def parse_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Records of ARC files: each file's version block tells how its header lines read."""
    lines = Lines(batches)
    while (file := lines.next_file()) is not None:
        version, position = 1, 0
        while (line := lines.line()) is not None:
            if not line:
                continue
            record = _arc_header(line, version)
            if record is None:
                yield {"file": file, "position": position, "version": version, "problem": "not a header line"}
                position += 1
                continue
            length = record.pop("length")
            content, whole = lines.block(length)
            if record["url"].startswith("filedesc:"):
                said = content.split(b" ", 1)[0]
                version = int(said) if said in (b"1", b"2") else version
            yield record | {
                "file": file, "position": position, "version": version, "content": content,
                "problem": None if whole else "cut off",
            }
            position += 1


def _arc_header(line: bytes, version: int) -> dict | None:
    """The fields of a header line; they are counted from the right, as old addresses may hold blanks.

    A version block precedes the knowledge of its own version, so a ``filedesc`` line is read by its number of fields.
    """
    text = line.decode("utf-8", "replace").rstrip("\r")
    if text.startswith("filedesc:"):
        version = 2 if len(text.split(" ")) >= len(ARC_FIELDS[2]) else 1
    names = ARC_FIELDS[version]
    values = text.rsplit(" ", len(names) - 1)
    if len(values) != len(names) or not values[-1].isdecimal() or not DATE.fullmatch(values[2].encode()):
        return None
    fields = dict(zip(names, values))
    return {k: fields.get(k) for k in ("url", "ip", "date", "mime", "status")} | {"length": int(fields["length"])}


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    schema = _arrow_schema(ARC_SCHEMA)
    return _lines(spark, path).mapInArrow(lambda batches: _batches(parse_arc(batches), schema), ARC_SCHEMA)


def warc_date(date: str) -> str:
    """14 digits as WARC writes a time; shorter dates are filled with the earliest time they allow."""
    full = date + "00000101000000"[len(date) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def digest_of(data: bytes) -> str:
    """Bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def converted(record: dict) -> dict:
    """The WARC fields that an ARC record implies."""
    if record["problem"]:
        return {"problem": f"{record['problem']}: {record['file']}, record {record['position']}"}
    content, url = record["content"], record["url"]
    head, payload, kind, page_id = b"", content, "resource", None
    if url.startswith("filedesc:"):
        kind = "warcinfo"
    elif content.startswith(b"HTTP/"):
        kind = "response"
        before, gap, after = content.partition(b"\r\n\r\n")
        head, payload = before + gap, after
        found = re.search(rb"(?mi)^" + ID_HEADER.encode() + rb":[ \t]*(-?\d+)[ \t]*\r?$", head)
        page_id = int(found[1]) if found else None
    name = f"{record['file']}#{record['position']} {url} {record['date']}"
    return {
        "record_id": f"urn:uuid:{uuid.uuid5(RECORD_NAMES, name)}", "record_type": kind, "url": url, "ip": record["ip"],
        "date": warc_date(record["date"]), "mime": record["mime"], "head": head, "payload": payload,
        "payload_digest": digest_of(payload), "payload_bytes": len(payload), "page_id": page_id, "problem": None,
    }


def converted_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of the ARC files in ``path`` with their WARC fields, with or without head and payload."""
    ddl = CONVERTED_SCHEMA if payloads else CONVERTED_SCHEMA.replace("head binary, payload binary, ", "")
    schema = _arrow_schema(ddl)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = map(converted, parse_arc(batches))
        if not payloads:
            records = ({k: v for k, v in r.items() if k not in ("head", "payload")} for r in records)
        return _batches(records, schema)

    return _lines(spark, path).mapInArrow(convert, ddl)


def convert_arc(spark: SparkSession, source: str, target: str, min_bytes: int = 0) -> None:
    """Convert the ARC files in ``source`` into WARC files in ``target``.

    Of responses with equal payloads of ``min_bytes`` or more, the one with the smallest page id (nulls last, then the
    smallest record id) stays a response and the others become revisits of it. Which is which is found on rows without
    payloads; these are then joined to the full records by record id, which no two records share.
    """
    light = converted_records(spark, source, payloads=False).where("problem IS NULL AND record_type = 'response'")
    alike = stored(light.where(F.col("payload_bytes") >= min_bytes).drop("problem", "ip", "mime", "record_type"))
    key = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id", "url", "date")
    firsts = alike.groupBy("payload_digest", "payload_bytes").agg(F.min(key).alias("first"), F.count("*").alias("n"))
    revisits = (
        alike.join(firsts.where("n > 1"), ["payload_digest", "payload_bytes"])
        .where(F.col("record_id") != F.col("first.record_id"))
        .select("record_id", F.col("first.record_id").alias("of_id"), F.col("first.url").alias("of_url"),
                F.col("first.date").alias("of_date"))
    )
    full = converted_records(spark, source).where("problem IS NULL").join(revisits, "record_id", "left")
    full.select(warc_record().cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option(
        "compression", "gzip"
    ).text(target)


def warc_record() -> Column:
    """A WARC/1.1 record without the two line ends that close it."""
    again = F.col("of_id").isNotNull()
    block = F.when(again, F.col("head")).otherwise(F.concat("head", "payload"))
    media = F.when(F.length("head") > 0, "application/http;msgtype=response").when(
        F.col("record_type") == "warcinfo", "application/warc-fields"
    ).otherwise(F.col("mime"))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise(F.col("record_type"))),
        line("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        line(LENGTH_HEADER, F.col("payload_bytes").cast("string")),
        F.when(again, F.concat(
            line("WARC-Refers-To", F.concat(F.lit("<"), "of_id", F.lit(">"))),
            line("WARC-Refers-To-Target-URI", F.col("of_url")),
            line("WARC-Refers-To-Date", F.col("of_date")),
            line("WARC-Profile", F.lit(REVISIT_PROFILE)),
        )).otherwise(""),
        line("Content-Type", media),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return F.concat(F.encode(header, "UTF-8"), block)


# ---- reading WARC -----------------------------------------------------------------------------------------------

def parse_warc(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[dict]:
    lines = Lines(batches)
    while (file := lines.next_file()) is not None:
        while (line := lines.line()) is not None:
            if line in (b"", b"\r"):
                continue
            if not line.startswith(b"WARC/"):
                yield {"problem": f"not a record: {file}"}
                continue
            head = {}
            while (line := lines.line()) not in (None, b"", b"\r"):
                name, _, value = line.partition(b":")
                head[name.strip().lower()] = value.strip().decode("utf-8", "replace")
            length = head.get(b"content-length", "")
            block, whole = lines.block(int(length)) if length.isdecimal() else (b"", False)
            if not whole:
                yield {"problem": f"cut off: {file}"}
                continue
            payload = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
            found = re.search(rb"(?mi)^" + ID_HEADER.encode() + rb":[ \t]*(-?\d+)[ \t]*\r?$", block.partition(b"\r\n\r\n")[0])
            kind = head.get(b"warc-type")
            digest = head.get(b"warc-payload-digest", "").removeprefix("sha1:")
            full = kind != "revisit"
            yield {
                "record_id": head.get(b"warc-record-id", "").strip("<>"), "record_type": kind,
                "url": head.get(b"warc-target-uri"), "date": head.get(b"warc-date"),
                "page_id": int(found[1]) if found and block.startswith(b"HTTP/") else None,
                "payload_digest": digest_of(payload) if full else digest,
                "declared_bytes": len(payload) if full else int(head.get(LENGTH_HEADER.lower().encode(), "-1")),
                "refers_to_id": head.get(b"warc-refers-to", "").strip("<>") or None,
                "payload": payload if payloads else None,
                "problem": "digest differs" if full and digest and digest != digest_of(payload) else None,
            }


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the WARC files in ``path``; digests of responses are computed anew and compared."""
    schema = _arrow_schema(WARC_SCHEMA)
    return _lines(spark, path).mapInArrow(lambda batches: _batches(parse_warc(batches, payloads), schema), WARC_SCHEMA)


def resolved(records: DataFrame) -> DataFrame:
    """Page records with ``refers_to``: the page id of the response that a revisit names."""
    pages = records.where("problem IS NULL AND record_type IN ('response', 'revisit')")
    responses = pages.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")
    )
    return pages.join(responses, "refers_to_id", "left").select(
        "page_id", F.col("declared_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )
