"""WARC archives: writing captures as transactions, reading records, assembling transactions.

A capture is written as three records: the response (or a revisit of an equal payload), the request
and a metadata record, the latter two naming the first one by ``WARC-Concurrent-To``.  Archives are
plain WARC/1.1, one gzip stream a file, written by Spark's text writer with the record end as line
end.  Reading parses by ``Content-Length`` and streams, so payloads may hold anything; assembly
joins the records of a transaction by their identifiers into one nested row per capture.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyspark.session import cut_lineage, shared_folder

CRLF, RECORD_END = "\r\n", "\r\n\r\n"
#: Records that carry a capture; all other types accompany one.
ANCHORS = ("response", "revisit", "resource")


def revisit_targets(pages: DataFrame, id_col: str, min_bytes: int) -> DataFrame:
    """(digest, top, top_rows) of payloads that several rows share: the largest id and how many rows have it.

    ``pages`` has columns ``digest`` and ``bytes``.  Counts are made per (digest, id) first, so equal
    payloads meet as partial sums only.
    """
    counts = pages.where(F.col("bytes").isNotNull()).groupBy("digest", F.col(id_col).alias("id")).agg(F.count("*").alias("n"), F.min("bytes").alias("bytes"))
    groups = counts.groupBy("digest").agg(F.max("id").alias("top"), F.max_by("n", "id").alias("top_rows"), F.sum("n").alias("rows"), F.min("bytes").alias("bytes"))
    return groups.where("rows > 1").select("digest", F.when(F.col("bytes") >= min_bytes, F.col("top")).alias("top"), "top_rows")


def _headers(*fields: tuple[str, Column]) -> Column:
    """``Name: value`` lines; a null value leaves its line out, and line breaks in values are percent-encoded."""
    safe = lambda v: F.regexp_replace(F.regexp_replace(v, "\r", "%0D"), "\n", "%0A")
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{name}: "), safe(value), F.lit(CRLF)), F.lit("")) for name, value in fields])


def _record(kind: Column, record_id: Column, block: Column, content_type: Column, *more: tuple[str, Column], date: str) -> Column:
    head = _headers(("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", F.lit(date)), *more, ("Content-Type", content_type),
                    ("Content-Length", F.octet_length(block).cast("string")))
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), head, F.lit(CRLF), block)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 1000,
            date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """(value): the text of every WARC record of ``pages``, three per row.

    Of rows with equal payloads of ``min_bytes`` or more, that with the largest id is written as a
    response and the others as revisits of it; rows that share payload and largest id are all
    responses.  Null payloads are empty; a null id never is the largest; without any id all rows are
    responses.  A payload that a third of the rows share is one row on the other side of the join,
    so Spark can split it.
    """
    text = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), text.alias("payload"))
    slim = slim.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    joined = slim.join(revisit_targets(slim, "id", min_bytes), "digest", "left")
    is_top = F.col("id").eqNullSafe(F.col("top"))
    revisit = F.col("top").isNotNull() & ~is_top
    own = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("none")), F.lit(":"), F.col("digest"), F.lit(">"))
    alone = F.col("top_rows").isNull() | (F.col("top").isNotNull() & is_top & (F.col("top_rows") == 1))
    named = joined.select("*", revisit.alias("revisit"),
                          F.when(alone, own).otherwise(F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">"))).alias("record"),
                          F.concat(F.lit("<urn:page:"), F.col("top").cast("string"), F.lit(":"), F.col("digest"), F.lit(">")).alias("target"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(RECORD_END))
    uri, digest = ("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    capture = _record(F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")), F.col("record"),
                      F.concat(http, F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload"))), F.lit("application/http; msgtype=response"), uri, digest,
                      ("WARC-Profile", F.when(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
                      ("WARC-Refers-To", F.when(F.col("revisit"), F.col("target"))), date=date)
    beside = ("WARC-Concurrent-To", F.col("record"))
    name = lambda: F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">"))
    request = _record(F.lit("request"), name(), F.concat(F.lit("GET "), F.regexp_replace(F.coalesce("url", F.lit("/")), r"\s", "%20"), F.lit(f" HTTP/1.1{RECORD_END}")),
                      F.lit("application/http; msgtype=request"), uri, beside, date=date)
    metadata = _record(F.lit("metadata"), name(), _headers(("page-id", F.col("id").cast("string"))), F.lit("application/warc-fields"), uri, beside, date=date)
    return named.select(F.explode(F.array(capture, request, metadata)).alias("value"))


def write_archives(pages: DataFrame, folder: str, **how) -> None:
    """Archives of ``pages`` below ``folder``, one per task; see ``records``."""
    records(pages, **how).write.option("lineSep", RECORD_END).option("compression", "gzip").text(folder)


class _Stream:
    """Bytes of a gzip (any number of members) or plain file, a chunk at a time."""

    def __init__(self, content: bytes, chunk: int = 1 << 18):
        self.content, self.chunk, self.at, self.buffer = content, chunk, 0, bytearray()
        self.inflate = zlib.decompressobj(31) if content[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        if self.at >= len(self.content) and not (self.inflate and self.inflate.unconsumed_tail):
            return False
        if self.inflate is None:
            self.buffer += self.content[self.at:self.at + self.chunk]
            self.at += self.chunk
            return True
        data = self.inflate.unconsumed_tail
        if not data:
            data = self.content[self.at:self.at + self.chunk]
            self.at += len(data)
        self.buffer += self.inflate.decompress(data, 4 * self.chunk)
        if self.inflate.eof:  # the next member starts where this one ends
            self.at -= len(self.inflate.unused_data)
            self.inflate = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (i := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self.more():
                return None
        out = bytes(self.buffer[:i])
        del self.buffer[:i + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self.more():
            pass
        if len(self.buffer) < n:
            raise ValueError("the archive ends inside a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def _fields(block: bytes) -> list[tuple[str, str]]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return [(name.strip().lower(), value.strip()) for name, colon, value in (line.partition(":") for line in lines) if colon]


def parse(content: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(header fields, block) of each record of an archive file."""
    stream = _Stream(content)
    while True:
        while True:  # blank lines between records
            if not stream.buffer and not stream.more():
                return
            if stream.buffer[:1] not in (b"\r", b"\n"):
                break
            del stream.buffer[:1]
        head = stream.until(b"\r\n\r\n")
        if head is None:
            if stream.buffer.strip():
                raise ValueError("the archive ends inside a header")
            return
        version, _, rest = head.partition(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record here: {version[:40]!r}")
        fields = _fields(rest)
        yield fields, stream.take(int(dict(fields)["content-length"]))


RECORD = ("record_type string, record_id string, concurrent_to array<string>, refers_to string, target_uri string, warc_date string, payload_digest string, "
          "payload_bytes long, payload_sha1 string, payload binary, fields map<string,string>")


def read_archives(spark: SparkSession, folder: str, kinds: tuple[str, ...] | None = None, payload: bool = True) -> DataFrame:
    """One row per record of the archives below ``folder`` (of ``kinds``, if given).

    ``payload_bytes`` is the length of the full payload: what was read, or for a revisit what its
    HTTP header says.  ``payload_sha1`` is taken from the bytes read (null for a revisit),
    ``payload_digest`` from the record's header.  ``fields`` holds the block of a metadata record.
    An archive is one file in memory while it streams; archives are as large as a write task.
    """
    import pyspark.sql.types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T.StructType.fromDDL(RECORD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for content in batch.column(0):
                for fields, block in parse(content.as_py()):
                    kind = dict(fields)["warc-type"]
                    if kinds and kind not in kinds:
                        continue
                    rows.append(_row(kind, fields, block, payload))
                    size += len(block)
                    if size > 16_000_000 or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, RECORD)


def _row(kind: str, fields: list[tuple[str, str]], block: bytes, payload: bool) -> dict:
    known = dict(fields)
    body, length, sha1 = block, len(block), None
    if known.get("content-type", "").startswith("application/http"):
        head, _, body = block.partition(b"\r\n\r\n")
        length = int(dict(_fields(head)).get("content-length", len(body)))
    if kind != "revisit":
        length = len(body)
        sha1 = hashlib.sha1(body).hexdigest() if payload else None
    return {
        "record_type": kind, "record_id": known["warc-record-id"], "concurrent_to": [v for n, v in fields if n == "warc-concurrent-to"],
        "refers_to": known.get("warc-refers-to"), "target_uri": known.get("warc-target-uri"), "warc_date": known.get("warc-date"),
        "payload_digest": known.get("warc-payload-digest"), "payload_bytes": length, "payload_sha1": sha1,
        "payload": body if payload and kind in ANCHORS else None, "fields": _fields(block) if kind == "metadata" else [],
    }


def assemble(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """One nested row per capture: (capture_id, response, requests, metadata).

    ``response`` is the record that carries the capture (response, revisit or resource);
    ``requests`` and ``metadata`` hold, sorted by id, the records tied to it by a concurrent-to
    identifier on either side, directly or through one other record of the transaction (so their
    arrays are as long as one transaction has records).  Records whose capture is missing keep a row
    of their own, with a null response.  Two archives that hold the same record give two captures.

    Archives are read twice, once for the small records and links, once for the payloads, which are
    shuffled a single time.
    """
    links = cut_lineage(read_archives(spark, folder, payload=False).select("record_type", "record_id", "concurrent_to", "target_uri", "warc_date", "fields"))
    is_anchor = F.col("record_type").isin(*ANCHORS)
    anchors = links.where(is_anchor)
    anchor_ids = anchors.select(F.col("record_id").alias("to")).distinct()
    stated = links.where(~is_anchor).select(F.col("record_id").alias("member"), F.explode("concurrent_to").alias("to"))
    reverse = anchors.select(F.explode("concurrent_to").alias("member"), F.col("record_id").alias("to"))
    pairs = stated.unionByName(reverse)
    direct = pairs.join(anchor_ids, "to", "left_semi")
    onward = pairs.join(anchor_ids, "to", "left_anti").withColumnRenamed("to", "mid")
    through = onward.join(direct.select(F.col("member").alias("mid"), "to"), "mid").select("member", "to")
    owner = direct.unionByName(through).distinct()
    members = links.where(~is_anchor).select(F.col("record_id").alias("member"), F.struct("record_type", "record_id", "target_uri", "warc_date", "fields").alias("record"))
    owned = members.join(owner, "member", "left").select(F.coalesce("to", "member").alias("capture_id"), "record")
    of = lambda test: F.array_sort(F.collect_list(F.when(test, F.struct(
        F.col("record.record_id").alias("record_id"), F.col("record.record_type").alias("record_type"), F.col("record.target_uri").alias("target_uri"),
        F.col("record.warc_date").alias("warc_date"), F.map_entries("record.fields").alias("fields")))))
    beside = owned.groupBy("capture_id").agg(of(F.col("record.record_type") == "request").alias("requests"),
                                             of(F.col("record.record_type") != "request").alias("metadata"))
    carried = read_archives(spark, folder, ANCHORS, payload)
    response = carried.select(F.col("record_id").alias("capture_id"), F.struct("record_type", "record_id", "refers_to", "target_uri", "warc_date", "payload_digest",
                                                                              "payload_bytes", "payload_sha1", "payload").alias("response"))
    return response.join(beside, "capture_id", "full")


def round_trip(pages: DataFrame, id_col: str = "page_id", **how) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of every page, read back from archives of ``pages``.

    The id comes from the capture's metadata record, digests from the bytes read or, for a revisit,
    from its header; ``refers_to`` is the id in the identifier that the revisit refers to.
    """
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, id_col=id_col, **how)
    kind = pages.schema[id_col].dataType.simpleString()
    captures = assemble(spark, folder)
    fields = F.map_from_entries(F.flatten(F.transform("metadata", lambda m: m["fields"])))
    return captures.where("response IS NOT NULL").select(
        fields["page-id"].cast(kind).alias(id_col), F.col("response.payload_bytes").alias("payload_bytes"),
        F.coalesce("response.payload_sha1", F.regexp_replace("response.payload_digest", "^sha1:", "")).alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.nullif(F.regexp_extract("response.refers_to", "^<urn:page:(.*):[0-9a-f]{40}>$", 1), F.lit("")).cast(kind).alias("refers_to"))
