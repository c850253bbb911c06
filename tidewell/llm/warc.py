"""WARC archives in which repeated payloads are revisit records.

Headers (id, URL, payload digest and size) are shuffled by digest; the original of
each digest is found and joined with the others, which become revisit records
without their pages being touched again. Responses are written from where their
pages lie: a page that a Bloom filter of the revisits' ids and digests doesn't hold
is a response for certain. The filter grows with the revisits, 16 slots each, so it
holds about one response in 400; their headers make a second filter. Only pages that
both hold are shuffled with their payloads, to be told apart. From 67 million
revisits on, where the filter has its greatest size, it holds more responses: one in
six at 268 million.

Each record is compressed as a gzip member of its own, so that it can be read
alone. Spark's text sink writes the members: the last byte of a member, that of
its size, is zero and is the line separator. Reading splits the archives at record
starts and puts back together, by Content-Length, payloads that contain such a
start themselves; a file is read by one task from its first byte on, so pieces
come in order.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.scratch import Scratch

END = "\r\n\r\n"
MARK = "WARC/1."  # versions 1.0 and 1.1
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
#: Records of one archive file.
FILE_RECORDS = 20_000
#: Slots of a filter at most; it goes with the tasks, so with 128 MB at most.
SLOTS = 1 << 30
#: Slots for each key of a filter, those that a key takes, and those of one row of it.
KEY_SLOTS, PROBES, BLOCK = 16, 4, 1 << 15
#: Bytes of a gzip member, so that the highest byte of its size is zero.
MEMBER = (1 << 24) - 1


def page_headers(pages: DataFrame) -> DataFrame:
    """``(id, url, payload_bytes, payload_digest)`` from ``pages(id, url, html)``."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("id", "url", F.octet_length(payload).cast("bigint").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))


def resolve_revisits(headers: DataFrame, least: int = 1000) -> DataFrame:
    """Those of ``headers`` that are revisits, with ``refers_to``: the id of their original."""
    large = headers.where((F.col("payload_bytes") >= least) & F.col("id").isNotNull())
    heads = large.groupBy("payload_digest").agg(F.max("id").alias("refers_to"), F.min("id").alias("lowest"))
    several = heads.where("refers_to <> lowest").select(F.col("payload_digest").alias("d"), "refers_to")
    return large.join(several, F.col("payload_digest") == F.col("d")).where("id <> refers_to").drop("d")


def _place(salt: int, among: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "payload_digest", F.lit(salt)), F.lit(among))


def _met(rows: DataFrame, keys: DataFrame, salt: int) -> tuple[DataFrame, Column]:
    """``rows(id, payload_digest, ...)`` with ``slots``, and whether a filter of ``keys`` holds a row: always if it is one of them.

    A key takes PROBES slots of one block, a row of the filter.
    """
    blocks = max(1, min(-(-keys.count() * KEY_SLOTS // BLOCK), SLOTS // BLOCK))
    block, places = _place(salt, blocks), [_place(salt + k, min(BLOCK, SLOTS)) for k in range(1, PROBES + 1)]
    table = keys.select(block.alias("block"), F.explode(F.array(*places)).alias("place")).groupBy("block").agg(F.bitmap_construct_agg("place").alias("slots"))
    hit = F.col("slots").isNotNull()
    for place in places:
        eight = F.conv(F.hex(F.substring("slots", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit &= F.getbit(eight, (place % 8).cast("int")) == 1
    return rows.join(F.broadcast(table), block == F.col("block"), "left").drop("block"), hit


def response_pages(pages: DataFrame, headers: DataFrame, revisits: DataFrame, scratch: Scratch) -> DataFrame:
    """``pages(id, url, html)`` that aren't revisits, with digest and size."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    full = pages.withColumns({"payload_bytes": F.octet_length(payload).cast("bigint"), "payload_digest": F.sha1(payload)})
    keys = revisits.select(F.col("id").alias("i"), F.col("payload_digest").alias("d")).distinct()
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("payload_digest") == F.col("d"))
    met, hit = _met(headers.select("id", "payload_digest"), revisits, 0)
    unsure = scratch.save(met.where(hit).drop("slots").join(keys, same, "left_anti"), "unsure")
    met, hit = _met(full, revisits, 0)
    sure = met.where(~hit).drop("slots")
    met, named = _met(met.where(hit).drop("slots"), unsure, PROBES + 1)
    return sure.union(met.where(named).drop("slots").join(keys, same, "left_anti"))


def _record(kind: str, date: str) -> Column:
    revisit = kind == "revisit"
    head = F.concat(F.lit(HTTP), F.col("payload_bytes").cast("string"), F.lit(END))
    size = F.octet_length(head) + (F.lit(0) if revisit else F.col("payload_bytes"))
    uri = F.regexp_replace(F.col("url"), "[\\x00-\\x20]", "%20")
    more = [F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:tidewell:page:"), F.col("refers_to").cast("string"), F.lit(">")] if revisit else []
    return F.concat(
        F.lit(f"{MARK}0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:tidewell:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), uri), F.lit("")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"), *more,
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), size.cast("string"), F.lit(END),
        head, *([] if revisit else [F.coalesce(F.col("html"), F.lit(""))]), F.lit(END),
    ).cast("binary")


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record gzipped, less the zero byte that ends it. Only a record of over 16 MB takes several members."""
    for batch in batches:
        out = []
        for record in batch.column(0).to_pylist():
            out.append(b"".join(_member(record[i : i + MEMBER]) for i in range(0, len(record), MEMBER))[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2000-01-01T00:00:00Z", least: int = 1000) -> None:
    """Write one record per page under ``path`` (files ``*.warc.gz``), originals as response and copies as revisit.

    Pages whose equal payload has ``least`` bytes or more revisit the one with the
    largest id; a null id is written as an empty one and is always a response. A
    null html is an empty payload, a null url leaves out the target header. Rows
    repeated under the largest id are all responses. An empty table writes no record.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc-headers")
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    headers = scratch.save(page_headers(own), "headers")
    revisits = scratch.save(resolve_revisits(headers, least), "revisits")
    records = response_pages(own, headers, revisits, scratch).select(_record("response", date).alias("value")).union(revisits.select(_record("revisit", date)))
    members = records.mapInArrow(_members, "value binary").select(F.col("value").cast("string"))
    members.write.option("lineSep", "\0").option("maxRecordsPerFile", FILE_RECORDS).text(path)
    _name_archives(spark, path)
    scratch.drop("headers", "revisits", "unsure")


def _name_archives(spark: SparkSession, path: str) -> None:
    """Give the files of Spark's text sink the ending that readers go by."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in store.listStatus(folder):
        name = f.getPath().getName()
        if name.startswith("part-") and name.endswith(".txt"):
            store.rename(f.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, name.removesuffix(".txt") + ".warc.gz"))


RECORD = re.compile(rb"([^:\r\n]+): ?([^\r\n]*)")


def _length(head: bytes) -> int:
    found = re.search(rb"(?im)^Content-Length: *(\d+)", head)
    return int(found[1]) if found else 0


def _parsed(pieces: Iterator[tuple[str, bytes]]) -> Iterator[dict]:
    """Records from (file, piece): the bytes between two record starts, without END and MARK but for a file's first."""
    mark, end = (END + MARK).encode(), END.encode()
    file, piece = next(pieces, (None, b""))
    first = True
    while file is not None:
        if first and piece.startswith(MARK.encode()):
            piece = piece[len(MARK) :]
        head, ended, block = piece.partition(end)
        size = _length(head)
        here, (file, piece) = file, next(pieces, (None, b""))
        while len(block) < size and file == here:
            block += mark + piece if ended else mark[len(end) :] + piece  # the block begins like a record
            ended = end
            file, piece = next(pieces, (None, b""))
        first = file != here
        fields = {k.decode("utf-8", "replace").lower(): v.decode("utf-8", "replace") for k, v in RECORD.findall(head)}
        if fields:
            http, _, payload = block[:size].partition(end) if "http" in fields.get("content-type", "") else (b"", b"", block[:size])
            yield {"fields": fields, "http": http, "payload": payload, "cut": len(block) < size}


def _page(urn: str | None) -> int | None:
    """The page's id if the record was written here."""
    found = re.fullmatch(r"<urn:tidewell:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


RECORD_SCHEMA = "id bigint, record_id string, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint, refers_to_id string, cut boolean"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
    names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]

    def batch(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    rows, held = [], 0
    for got in _parsed(x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
        fields, payload = got["fields"], got["payload"]
        revisit = fields.get("warc-type") == "revisit"
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else hashlib.sha1(payload).hexdigest()
        of, to = fields.get("warc-record-id"), fields.get("warc-refers-to")
        rows.append([_page(of), of, fields.get("warc-target-uri"), fields.get("warc-type"), None if revisit else payload, _length(got["http"]) if revisit else len(payload), digest, _page(to), to, got["cut"]])
        held += len(payload)
        if held > 8_000_000 or len(rows) >= 1000:
            yield batch(rows)
            rows, held = [], 0
    if rows:
        yield batch(rows)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under ``path``, WARC 1.0 and 1.1, gzipped or not, by any writer.

    Columns: ``id, refers_to`` are page ids, null in records that weren't written
    here; ``record_id, refers_to_id`` are the headers; a response's ``payload_bytes``
    and ``payload_digest`` (bare hex SHA-1) are taken from the payload read, a
    revisit's from its headers, and the payload of a revisit is null. Of records with
    an HTTP content type the payload is what follows the HTTP headers, of others the
    whole block. Where a file breaks off, its last record holds what is there and
    ``cut`` is true.
    """
    text = spark.read.option("lineSep", END + MARK).option("recursiveFileLookup", "true").text(path)
    pieces = text.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary"), F.col("_metadata.file_block_start").alias("start"))
    if all(f.endswith(".gz") for f in text.inputFiles()):  # which one task reads from its first byte on
        return pieces.select("file", "value").mapInArrow(_records, RECORD_SCHEMA)
    # Other files come in several splits, and a record may lie in two: a file's pieces are put in order in one task.
    whole = F.col("file").endswith(".gz")
    split = pieces.where(~whole).withColumn("place", F.monotonically_increasing_id()).repartition("file").sortWithinPartitions("file", "start", "place")
    parts = [df.select("file", "value").mapInArrow(_records, RECORD_SCHEMA) for df in (pieces.where(whole), split)]
    return parts[0].union(parts[1])


def warc_round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write the archives to the shared folder and read them back."""
    spark = pages.sparkSession
    path = Scratch(spark, "warc").path("archives")
    write_warc(pages, path, **columns)
    return read_warc(spark, path)
