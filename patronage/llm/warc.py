"""WARC archives: writing with record segmentation, and reading back with segment reassembly.

Each distinct (page_id, payload) becomes one record: a `response` whose block is an HTTP message in chunked transfer
framing, or a `revisit` of the response with an equal payload and the smallest page_id. Blocks above SEGMENT_BYTES are
split: the first segment has the response's type, the others are `continuation` records that name the first as origin,
and the last one tells the total length. The reader groups continuations by origin, orders them by segment number,
verifies numbering and total length, decodes the chunked framing and verifies the payload digest.

Files are written by Spark's text writer, one record to a row. Before a record marker that occurs within a payload a
chunk ends inside the marker, so the marker stands only where records begin. Uncompressed archives are read in splits of
them; a gzip file is one stream and read by one task; the writer makes one in each of its own.

Defined results. Null html is an empty payload. Payloads below MIN_REVISIT_BYTES are always responses. Repeated rows
with the same page_id and payload are archived once, with their number, and returned as often. One page_id with
several payloads gives several records. A null page_id is archived like others; as the smallest of its payload it
counts only if all page_ids are null. An empty table gives an empty archive and an empty result. Line breaks in
a url are written as blanks. A broken record, a missing segment, a wrong length or digest raises an error.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.llm.common import column_ref, ship, table, written
from patronage.sources.durable import scratch_path

MIN_REVISIT_BYTES = 100
#: Longest block of one record; longer ones continue in further records.
SEGMENT_BYTES = 1 << 20
CHUNK_BYTES = 16 << 10
MARKER = b"WARC/1.1\r\n"
RECORD_END = "\r\n\r\n"
#: The archive does not depend on the time it is written at.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = (
    "record_id string, page_id bigint, copies bigint, record_type string, origin string, segment int,"
    " total_length bigint, digest string, refers_to string, block binary"
)
_RECORD_NAMES = [part.split()[0] for part in RECORDS.split(", ")]
_RECORD_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary()]


def chunked(payload: bytes, size: int) -> bytes:
    """The payload in chunked transfer framing; no record marker is left whole."""
    cuts = set(range(size, len(payload), size)) | {m.start() + 1 for m in re.finditer(re.escape(MARKER), payload)}
    parts, begin = [], 0
    for end in [*sorted(cuts), len(payload)]:
        if end > begin:
            parts.append(b"%x\r\n%b\r\n" % (end - begin, payload[begin:end]))
        begin = end
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size, at = int(body[at:line].split(b";")[0], 16), line + 2
        if not size:
            if body[at:] != b"\r\n":
                raise ValueError("bytes after the last chunk")
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk has not the length it tells")
        parts.append(body[at : at + size])
        at += size + 2


def _name(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest[:32]}>"


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return MARKER + f"{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def records_of(row: dict, segment_bytes: int) -> Iterator[bytes]:
    name, url = _name(row["page_id"], row["digest"]), re.sub(r"[\r\n]+", " ", row["url"] or "")
    shared = [("WARC-Target-URI", url), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{row['digest']}"),
              ("X-Page-ID", row["page_id"]), ("X-Copies", row["copies"])]
    http = ("Content-Type", "application/http; msgtype=response")
    top = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if row["revisits"]:
        yield _record(
            [("WARC-Type", "revisit"), ("WARC-Record-ID", name), *shared, ("WARC-Profile", PROFILE),
             ("WARC-Refers-To", _name(row["first_page"], row["digest"])), http], top)
        return
    block = top + chunked((row["html"] or "").encode(), CHUNK_BYTES)
    cuts, begin = [], 0
    while begin < len(block):
        end = min(begin + segment_bytes, len(block))
        cuts.append((begin, end))
        begin = end
    for k, (begin, end) in enumerate(cuts, 1):
        fields = [("WARC-Type", "response" if k == 1 else "continuation")]
        fields.append(("WARC-Record-ID", name if k == 1 else f"{name[:-1]}:{k}>"))
        fields += shared if k == 1 else [("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name)]
        fields.append(("WARC-Segment-Number", k if len(cuts) > 1 else None))
        fields.append(("WARC-Segment-Total-Length", len(block) if len(cuts) > 1 and k == len(cuts) else None))
        yield _record([*fields, *([http] if k == 1 else [])], block[begin:end])


def parse_record(raw: bytes) -> dict:
    """One record, from after its marker to before the next."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode().split("\r\n"):
        key, _, value = line.partition(":")
        fields[key.lower()] = value.strip()
    size = int(fields["content-length"])
    if rest[size:] != RECORD_END.encode():
        raise ValueError(f"record {fields.get('warc-record-id')} has not the length it tells")
    number = lambda key: int(fields[key]) if key in fields else None
    return {
        "record_id": fields["warc-record-id"], "page_id": number("x-page-id"), "copies": number("x-copies"),
        "record_type": fields["warc-type"], "origin": fields.get("warc-segment-origin-id"),
        "segment": number("warc-segment-number"), "total_length": number("warc-segment-total-length"),
        "digest": fields.get("warc-payload-digest", "").removeprefix("sha256:") or None,
        "refers_to": fields.get("warc-refers-to"), "block": rest[:size],
    }


def plan_records(pages: DataFrame, page: str, url: str, html: str) -> DataFrame:
    """A row for each record to write. Only digests are grouped; pages are shuffled once, to their decision."""
    rows = pages.select(
        column_ref(page).cast("long").alias("page_id"),
        F.coalesce(column_ref(url).cast("string"), F.lit("")).alias("url"),
        F.coalesce(column_ref(html), F.lit("")).alias("html"),
    )
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    # a key without nulls, so that the join and the grouping after it share one partitioning
    rows = rows.withColumn("row_key", F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "digest"))
    small = rows.select("row_key", "page_id", "digest", F.octet_length("html").cast("long").alias("bytes"))
    distinct = small.groupBy("row_key", "page_id", "digest", "bytes").agg(F.count("*").alias("copies"))
    first = small.where(F.col("bytes") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first_page"))
    decided = distinct.join(first, "digest", "left").select(
        "row_key",
        "copies",
        "first_page",
        (F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))).alias("revisits"),
    )
    return rows.join(decided, "row_key").groupBy("row_key").agg(
        F.first("page_id").alias("page_id"),
        F.first("digest").alias("digest"),
        F.min("url").alias("url"),
        F.min(F.when(~F.col("revisits"), F.col("html"))).alias("html"),
        F.first("copies").alias("copies"),
        F.first("first_page").alias("first_page"),
        F.first("revisits").alias("revisits"),
    )


def write_archive(
    pages: DataFrame, path: str, *, page: str = "page_id", url: str = "url", html: str = "html",
    segment_bytes: int = SEGMENT_BYTES, compression: str = "gzip",
) -> None:
    ship(pages.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pydict({"record": pa.array(records_of(row, segment_bytes), pa.binary())})

    records = plan_records(pages, page, url, html).mapInArrow(encode, "record binary")
    lines = records.select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", RECORD_END).option("compression", compression).text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record as it stands in the files."""
    ship(spark)
    pieces = spark.read.option("lineSep", MARKER.decode()).text(path).select(F.col("value").cast("binary").alias("raw"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse_record(raw) for raw in batch.column(0).to_pylist() if raw]
            columns = [pa.array([r[k] for r in rows], t) for k, t in zip(_RECORD_NAMES, _RECORD_TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=_RECORD_NAMES)

    return pieces.mapInArrow(parse, RECORDS)


def reassemble(records: DataFrame) -> DataFrame:
    """Blocks of segmented records put together again, under the record that began them."""
    parts = records.where(F.col("segment").isNotNull()).withColumn("origin", F.coalesce("origin", "record_id"))
    grouped = parts.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        F.max("total_length").alias("total_length"),
        F.max(F.when(F.col("segment") == 1, F.col("record_type"))).alias("record_type"),
        *[F.max(c).alias(c) for c in ("page_id", "copies", "digest", "refers_to")],
    )
    block = F.aggregate("parts", F.lit(b""), lambda done, part: F.concat(done, part["block"]))
    complete = F.transform("parts", lambda part: part["segment"]) == F.sequence(F.lit(1), F.size("parts"))
    fits = F.octet_length(block) == F.col("total_length")
    wrong = F.raise_error(F.concat(F.lit("segments of "), "origin", F.lit(" are missing or of another total length")))
    return grouped.select(
        F.col("origin").alias("record_id"), "page_id", "copies", "record_type", "digest", "refers_to",
        F.when(F.coalesce(complete & fits, F.lit(False)), block).otherwise(wrong.cast("binary")).alias("block"),
    )


def decode_payloads(records: DataFrame) -> DataFrame:
    """Whole records with the payload after HTTP head and chunked framing, its digest verified; null for revisits."""

    def payload_of(name: str, kind: str, digest: str, block: bytes) -> bytes | None:
        if kind == "revisit":
            return None
        head, _, body = block.partition(b"\r\n\r\n")
        payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"the payload of {name} has another digest")
        return payload

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {k: batch.column(k) for k in batch.schema.names}
            rows = zip(*(columns[k].to_pylist() for k in ("record_id", "record_type", "digest", "block")), strict=True)
            del columns["block"]
            yield pa.RecordBatch.from_pydict(columns | {"payload": pa.array([payload_of(*r) for r in rows], pa.binary())})

    names = "record_id string, page_id bigint, copies bigint, record_type string, digest string, refers_to string"
    columns = [part.split()[0] for part in names.split(", ")]
    return records.select(*columns, "block").mapInArrow(decode, f"{names}, payload binary")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every archived record, put together and decoded. Records that are not segmented take no part in a shuffle."""
    records = read_records(spark, path)
    single, joined = records.where(F.col("segment").isNull()), reassemble(records)
    return decode_payloads(single.select(joined.columns).unionByName(joined))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark)
    write_archive(table(spark, folder, "pages"), path)
    found = written(read_archive(spark, path).withColumn("payload_bytes", F.octet_length("payload").cast("long")).drop("payload"))
    responses = found.where(F.col("record_type") == "response")
    targets = responses.select(F.col("record_id").alias("t"), F.col("page_id").alias("response"), F.col("payload_bytes").alias("bytes"))
    lost = F.raise_error(F.concat(F.lit("no response "), "refers_to")).cast("long")
    revisits = found.where(F.col("record_type") == "revisit").join(targets, F.col("refers_to") == F.col("t"), "left")
    revisits = revisits.withColumn("payload_bytes", F.coalesce("bytes", lost)).withColumn("refers_to", F.col("response"))
    rows = responses.withColumn("refers_to", F.lit(None).cast("long")).unionByName(revisits.select(found.columns))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return rows.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


OP6_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN first_page END AS refers_to
FROM f
"""
