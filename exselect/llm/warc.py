"""WARC archives as a chunked record table (operator 1).

A payload is a run of rows (record, number, last, data); no operator here holds more than one chunk of a record. The
running SHA-1 travels from chunk to chunk inside a task. On disk a chunk is one WARC record: the first of a payload is
its `response`, the others are the `continuation` segments that the format has for this; the last one names
the digest and length of the whole. Files are written and read by Spark's text source, with a record as a line, so any
file system works, a lost task is written anew, and plain files can be read in splits.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exselect.llm.tables import parts, shared_folder
from exselect.session import small_side

CHUNK_BYTES = 256 << 10
RECORDS_AT_ONCE = 64
# Fixed values of the format.
MARK = b"WARC/1.1\r\n"
GAP = "\r\n\r\n"

_CHUNKS = "record string, number int, last boolean, data binary"


def chunked(rows: DataFrame, payload: str | Column, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Each row once per chunk of its payload, with `record`, `number` (from 0), `last` and `data` (binary).

    Null payloads count as empty and have one empty chunk. Rows that are equal in every column are still separate
    records. Columns named like the new ones are replaced.
    """
    rows = rows.withColumn("_payload", F.coalesce(F.encode(payload, "UTF-8"), F.lit(b"")))
    rows = rows.drop("record", "number", "last", "data", *([payload] if isinstance(payload, str) else []))
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("_payload") / chunk_bytes)).cast("int")
    return (
        rows.withColumn("record", F.md5(F.concat_ws(":", F.monotonically_increasing_id(), F.spark_partition_id())))
        .withColumn("_count", count)
        .select("*", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)).alias("number"))
        .select(*[c for c in rows.columns if c != "_payload"], "record", "number",
                (F.col("number") == F.col("_count") - 1).alias("last"),
                F.substring("_payload", F.col("number") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("data"))
    )


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


class Running:
    """Digest and length of the record that is passing by."""

    def __init__(self):
        self.record = None

    def take(self, record: str, number: int, data: bytes) -> tuple[str, int]:
        if record != self.record or number == 0:
            self.record, self.sha, self.length = record, hashlib.sha1(), 0
        self.sha.update(data)
        self.length += len(data)
        return b32(self.sha.digest()), self.length


def base32_of_hex(digest: Column) -> Column:
    """A 40-digit hexadecimal digest in upper-case base 32, five digits at a time."""
    four = [F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*four), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(rows: DataFrame, row_id: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """Adds record_type and refers_to: of equal payloads of at least `min_bytes`, the row with the largest id is the response.

    Null ids are smaller than any other. Rows that share the largest id are all responses. Equal payloads are found by
    SHA-1, counted before the shuffle; only groups of several rows go back to the rows, and only as (digest, id).
    """
    data = F.coalesce(F.encode(payload, "UTF-8"), F.lit(b""))
    keyed = rows.select(F.sha1(data).alias("_digest"), F.col(row_id).alias("_id")).where(F.octet_length(data) >= min_bytes)
    groups = keyed.groupBy("_digest").agg(F.max("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    groups = groups.select("_digest", "_first").persist()
    out = rows.withColumn("_digest", F.when(F.octet_length(data) >= min_bytes, F.sha1(data)))
    out = out.join(small_side(groups, groups.count(), 64), "_digest", "left")
    revisit = F.col("_first").isNotNull() & ~F.col(row_id).eqNullSafe(F.col("_first"))
    return out.select(*[c for c in rows.columns if c not in ("record_type", "refers_to")],
                      F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                      F.when(revisit, F.col("_first")).alias("refers_to"))


def _header(fields: dict) -> bytes:
    return MARK + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None).encode() + b"\r\n"


def _cut(data: bytes) -> list[bytes]:
    """Pieces of which none holds the mark that opens a record."""
    out, at = [], 0
    while (found := data.find(MARK, at)) >= 0:
        out.append(data[at:found + 4])
        at = found + 4
    return [*out, data[at:]]


def _clean(value) -> str | None:
    return None if value is None else str(value).replace("\r", "%0D").replace("\n", "%0A")


def segments(chunks: Iterator[dict], date: str) -> Iterator[bytes]:
    """WARC records of chunk rows (page_id, url, record_type, refers_to and the chunk itself), one at a time."""
    running, segment, before = Running(), 0, b""
    for row in chunks:
        data = row["data"]
        if row["number"] == 0:
            segment, before = 0, b""
        digest, length = running.take(row["record"], row["number"], data)
        if row["record_type"] == "revisit":
            if row["last"]:
                yield _header({
                    "WARC-Type": "revisit", "WARC-Record-ID": f"<urn:uuid:{uuid.UUID(row['record'])}>", "WARC-Date": date,
                    "WARC-Target-URI": _clean(row["url"]), "WARC-Page-ID": row["page_id"], "WARC-Payload-Digest": f"sha1:{digest}",
                    "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                    "WARC-Refers-To-Page-ID": row["refers_to"], "WARC-Payload-Length": length, "Content-Length": 0})
            continue
        # A mark may also span two chunks: its first bytes wait for the next one.
        data = before + data
        keep = 0 if row["last"] else next((n for n in range(len(MARK) - 1, 0, -1) if data.endswith(MARK[:n])), 0)
        data, before = (data[:len(data) - keep], data[len(data) - keep:])
        pieces = _cut(data)
        for k, piece in enumerate(pieces):
            last, segment = row["last"] and k == len(pieces) - 1, segment + 1
            name = f"<urn:uuid:{uuid.UUID(row['record'])}>"
            whole = last and segment == 1
            yield _header({
                "WARC-Type": "response" if segment == 1 else "continuation",
                "WARC-Record-ID": name if segment == 1 else f"<urn:uuid:{uuid.uuid5(uuid.UUID(row['record']), str(segment))}>",
                "WARC-Date": date, "WARC-Target-URI": _clean(row["url"]), "WARC-Page-ID": row["page_id"],
                "WARC-Block-Digest": f"sha1:{b32(hashlib.sha1(piece).digest())}",
                "WARC-Segment-Number": None if whole else segment,
                "WARC-Segment-Origin-ID": name if segment > 1 else None,
                "WARC-Segment-Total-Length": length if last and not whole else None,
                "WARC-Payload-Digest": f"sha1:{digest}" if last else None,
                "Content-Length": len(piece)}) + piece


def together(records: Iterator, size: Callable) -> Iterator[list]:
    """Records in lists of at most RECORDS_AT_ONCE, that end when they have a chunk's bytes."""
    found, held = [], 0
    for record in records:
        found.append(record)
        held += size(record)
        if len(found) >= RECORDS_AT_ONCE or held >= CHUNK_BYTES:
            yield found
            found, held = [], 0
    if found:
        yield found


def write_archives(pages: DataFrame, path: str, compression: str = "gzip", chunk_bytes: int = CHUNK_BYTES,
                   date: str = "1970-01-01T00:00:00Z") -> None:
    """Write (page_id, url, html, record_type, refers_to) as WARC files below `path`, one per task.

    Null html is an empty payload, a null url or id has no header line. An empty table gives files without records.
    """
    chunks = chunked(pages.select("page_id", "url", "record_type", "refers_to", "html"), "html", chunk_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for k in range(0, batch.num_rows, 64) for row in batch.slice(k, 64).to_pylist())
        for found in together(segments(rows, date), len):
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["value"])

    records = chunks.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    records.write.option("lineSep", GAP).option("compression", compression).text(path)


def read_archives(spark: SparkSession, path: str, segments_only: bool = False) -> DataFrame:
    """One row per WARC record: its header as a map with lower-case names, and `data` (binary), checked against its length.

    Archives whose payloads hold the opening mark of a record, which `write_archives` never makes, are refused.
    `segments_only` leaves out records without the name of the segment number, before they are parsed.
    """
    lines = spark.read.option("lineSep", MARK.decode()).text(path)
    if segments_only:
        lines = lines.where(F.col("value").rlike("(?i)warc-segment-number"))
    lines = lines.select(F.col("value").cast("binary").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("header", pa.map_(pa.string(), pa.string())), ("data", pa.binary())])
        for found in together(parsed(line.as_py() for batch in batches for line in batch.column(0)), lambda record: len(record[1])):
            headers, data = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(headers, kinds.field(0).type), pa.array(data, pa.binary())], schema=kinds)

    def parsed(lines: Iterator[bytes]) -> Iterator[tuple[list, bytes]]:
        for value in lines:
            if value and not value.isspace():
                head, found, rest = value.partition(b"\r\n\r\n")
                header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n"))}
                length = int(header.get("content-length", -1))
                if not found or length < 0 or len(rest) < length or rest[length:].strip(b"\r\n"):
                    raise ValueError(f"broken record {header.get('warc-record-id')}")
                yield list(header.items()), rest[:length]

    return lines.mapInArrow(run, "header map<string,string>, data binary")


_READ = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
         "segments int")


def payloads(records: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """One row per archived payload, from records of `read_archives`: digests are carried on over segments and checked.

    Whole payloads need no shuffle; segments of one payload meet in order in one task, which holds one at a time.
    `candidates` are those of the records that may be segments, read with `segments_only`; all by default.
    """
    h = lambda name: F.col("header").getItem(name)
    origin = F.coalesce(h("warc-segment-origin-id"), h("warc-record-id"))
    number = F.coalesce(h("warc-segment-number").cast("int"), F.lit(1))
    split = h("warc-segment-number").isNotNull()
    columns = (
        origin.alias("record"), number.alias("number"), split.alias("split"), h("warc-type").alias("type"),
        h("warc-page-id").cast("long").alias("page_id"), h("warc-target-uri").alias("url"),
        F.substring_index(h("warc-payload-digest"), ":", -1).alias("digest"),
        F.substring_index(h("warc-block-digest"), ":", -1).alias("block_digest"),
        F.coalesce(h("warc-segment-total-length"), h("warc-payload-length")).cast("long").alias("total"),
        h("warc-refers-to-page-id").cast("long").alias("refers_to"), "data")

    def fields(records: DataFrame) -> DataFrame:
        return records.where(h("warc-type").isin("response", "revisit", "continuation")).select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running, first, expected = Running(), None, 0
        names = [c.split(" ")[0] for c in _READ.split(", ")]
        for batch in batches:
            out = []
            for k in range(0, batch.num_rows, 64):
                for row in batch.slice(k, 64).to_pylist():
                    if row["type"] == "revisit":
                        out.append((row["page_id"], row["url"], row["total"], row["digest"], "revisit", row["refers_to"], 1))
                        continue
                    if row["number"] == 1:
                        first, expected = row, 0
                    expected += 1
                    if first is None or row["number"] != expected or row["record"] != first["record"]:
                        raise ValueError(f"a segment of {row['record']} is missing")
                    if row["block_digest"] and row["block_digest"] != b32(hashlib.sha1(row["data"]).digest()):
                        raise ValueError(f"block digest of {row['record']} differs")
                    digest, length = running.take(row["record"], row["number"] - 1, row["data"])
                    if row["split"] and row["total"] is None:
                        continue
                    if row["digest"] not in (None, digest) or row["total"] not in (None, length):
                        raise ValueError(f"payload digest of {row['record']} differs")
                    out.append((first["page_id"], first["url"], length, digest, "response", None, expected))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32()))],
                    names=names)

    whole = fields(records).where(~F.col("split")).mapInArrow(run, _READ)
    pieces = fields(records if candidates is None else candidates).where("split").repartition(parts(records.sparkSession), "record").sortWithinPartitions("record", "number")
    return whole.unionByName(pieces.mapInArrow(run, _READ))


def archive_pages(pages: DataFrame, path: str, min_bytes: int = 0, **options) -> DataFrame:
    """Write pages (page_id, url, html) as archives with revisits and read them back: one row per page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    write_archives(with_revisits(pages, "page_id", "html", min_bytes), path, **options)
    return payloads(read_archives(pages.sparkSession, path), read_archives(pages.sparkSession, path, segments_only=True))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), shared_folder(spark, "warc"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
