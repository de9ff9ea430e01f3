"""Web archives (WARC) with a two-level capture index.

Pages are ranged by their reversed-host URL key. Each part becomes one archive of gzip records, one file of capture
lines in compressed blocks, and a sparse directory with the first key of every block. A lookup finds its part among the
parts' first keys, its block by binary search in that part's directory, reads the block by byte range, finds the
capture there by binary search, and reads the record by byte range.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessarine.llm._work import join_counted, materialize, work_path

BLOCK_LINES = 512
LEAST_BYTES = 100
LEVEL = 3
PART_BYTES = 256 << 20
DATE = "2000-01-01T00:00:00Z"

_PARTS = "first_key string, first_id long, path string, captures long"
_FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def url_key(url: Column) -> Column:
    """Host labels reversed, then the rest: ``http://www.a.com/x?y`` -> ``com,a,www)/x?y``; a null URL is empty."""
    bare = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""))
    host = F.regexp_extract(bare, r"^([^/?#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(bare, r"^[^/?#]*", ""))


def record_id(page_id: int | None, digest: str, key: str, nth: int = 0) -> str:
    """A name for the nth of the captures that share page, payload and URL key; the same on every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {nth} {key}')}>"


def _warc(headers: list[tuple[str, object]], body: bytes) -> bytes:
    head = "".join(f"{k}: {str(v).translate({10: '%0A', 13: '%0D'})}\r\n" for k, v in [*headers, ("Content-Length", len(body))])
    return b"WARC/1.1\r\n" + head.encode("utf-8", "replace") + b"\r\n" + body + b"\r\n\r\n"


def _info(name: str) -> bytes:
    headers = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, "", name)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return _warc(headers, b"software: tessarine\r\nformat: WARC File Format 1.1\r\n")


def _record(page: dict, nth: int) -> bytes:
    page_id, digest = page["page_id"], page["payload_digest"]
    headers = [("WARC-Type", page["record_type"]), ("WARC-Record-ID", record_id(page_id, digest, page["key"], nth)), ("WARC-Target-URI", page["url"] or f"urn:page:{page_id}"),
               ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Payload-Length", page["payload_bytes"]), ("Page-ID", page_id)]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if page["record_type"] == "revisit":
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(page["refers_to"], digest, page["refers_key"])), ("Refers-To-Page-ID", page["refers_to"])]
    else:
        body += (page["html"] or "").encode("utf-8", "replace")
    return _warc([*headers, ("Content-Type", "application/http; msgtype=response")], body)


def parse_record(raw: bytes) -> dict:
    """Headers and payload of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    return {"fields": fields, "payload": body.partition(b"\r\n\r\n")[2]}


def _compress(raw: bytes) -> bytes:
    return gzip.compress(raw, LEVEL, mtime=0)


def _archive(uri: str):
    """For mapInArrow over one sorted part: writes its three files and returns its line of the parts table."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, lines, directory, captures, place = None, [], [], 0, 0
        last, nth = None, 0
        store, base = fs.FileSystem.from_uri(uri)
        path = f"{base}/{uuid.uuid4().hex}"
        out = index = None

        def close_block() -> None:
            if lines:
                raw = _compress(json.dumps(lines).encode())
                directory.append([lines[0][0], lines[0][1], index.tell(), len(raw)])
                index.write(raw)
                lines.clear()

        for batch in batches:
            for at in range(0, len(batch), 256):
                for page in batch.slice(at, 256).to_pylist():
                    if out is None:
                        store.create_dir(base, recursive=True)
                        out, index = store.open_output_stream(f"{path}.warc.gz", compression=None), store.open_output_stream(f"{path}.cdx.gz", compression=None)
                        first = (page["key"], page["order_id"])
                        place = out.write(_compress(_info(f"{path.rpartition('/')[2]}.warc.gz")))
                    this = page["key"], page["order_id"]
                    last, nth = this, nth + 1 if this == last else 0
                    raw = _compress(_record(page, nth))
                    out.write(raw)
                    lines.append([page["key"], page["order_id"], place, len(raw)])
                    place += len(raw)
                    captures += 1
                    if len(lines) == BLOCK_LINES:
                        close_block()
        if out is None:
            return
        close_block()
        out.close(), index.close()
        with store.open_output_stream(f"{path}.dir.gz", compression=None) as d:
            d.write(_compress(json.dumps(directory).encode()))
        yield pa.record_batch([pa.array([first[0]]), pa.array([first[1]], pa.int64()), pa.array([path]), pa.array([captures], pa.int64())], ["first_key", "first_id", "path", "captures"])

    return write


class Archive:
    """One part, opened for lookups."""

    def __init__(self, store: fs.FileSystem, path: str) -> None:
        with store.open_input_stream(f"{path}.dir.gz", compression=None) as d:
            self.directory = json.loads(gzip.decompress(d.read()))
        self.firsts = [(key, id_) for key, id_, _, _ in self.directory]
        self.index, self.records = store.open_input_file(f"{path}.cdx.gz"), store.open_input_file(f"{path}.warc.gz")
        self.block, self.lines = -1, []

    def find(self, key: str, order_id: int) -> list[tuple[int, int]]:
        """(offset, length) of the captures with this key and id, oldest first."""
        out = []
        at = max(0, bisect.bisect_left(self.firsts, (key, order_id)) - 1)
        while at < len(self.firsts) and self.firsts[at] <= (key, order_id):
            if at != self.block:
                _, _, offset, length = self.directory[at]
                self.lines = [((k, i), o, n) for k, i, o, n in json.loads(gzip.decompress(self.index.read_at(length, offset)))]
                self.block = at
            k = bisect.bisect_left(self.lines, (key, order_id), key=lambda x: x[0])
            while k < len(self.lines) and self.lines[k][0] == (key, order_id):
                out.append(self.lines[k][1:])
                k += 1
            at += 1
        return out

    def read(self, offset: int, length: int) -> dict:
        return parse_record(zlib.decompress(self.records.read_at(length, offset), 31))


def _lookup(uri: str, keep_payload: bool):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(uri)
        opened: tuple[str, Archive] | None = None
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = []
                for ask in batch.slice(at, 256).to_pylist():
                    if opened is None or opened[0] != ask["path"]:
                        opened = ask["path"], Archive(store, ask["path"])
                    for offset, length in opened[1].find(ask["key"], ask["order_id"]):
                        record = opened[1].read(offset, length)
                        rows.append(_described(record, keep_payload))
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]))

    return look


def _described(record: dict, keep_payload: bool) -> dict:
    f, payload = record["fields"], record["payload"]
    digest, size = f["WARC-Payload-Digest"].partition(":")[2], int(f["Payload-Length"])
    if f["WARC-Type"] == "response":
        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
    return {"page_id": None if f["Page-ID"] == "None" else int(f["Page-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": f["WARC-Type"],
            "refers_to": int(f["Refers-To-Page-ID"]) if "Refers-To-Page-ID" in f else None, "payload": payload if keep_payload else None}


def _ordered(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", url_key(F.col("url")).alias("key"), F.coalesce(F.col("page_id").cast("long"), F.lit(-(2**63))).alias("order_id"))


def write_archives(pages: DataFrame, uri: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``uri`` and return the table of parts, ordered by first key.

    Payload is the html in UTF-8, empty for null. Of equal payloads of at least 100 bytes the smallest page_id is a
    response and the others revisit it; rows that share that page_id are all responses, as are rows without any
    page_id to refer to, and smaller payloads. A task that is run again writes new files; only those named in the
    table count.
    """
    raw = F.coalesce(F.col("html"), F.lit(""))
    seen = materialize(_ordered(pages).select("page_id", "key", "order_id", F.sha2(raw, 256).alias("payload_digest"), F.octet_length(raw).cast("long").alias("payload_bytes")), "digests")
    large = seen.filter(F.col("payload_bytes") >= LEAST_BYTES)
    firsts = materialize(large.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.max(F.col("page_id").isNull()).alias("unnamed"), F.max("page_id").alias("last"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "key")))["key"].alias("refers_key"), F.count(F.lit(1)).alias("n_rows")).filter("refers_to < last or (refers_to is not null and unnamed)").select("payload_digest", "refers_to", "refers_key", "n_rows"), "firsts")
    named = join_counted(large.select("page_id", "payload_digest"), firsts, "payload_digest", seen.count()).filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    again = materialize(named.select(F.coalesce("page_id", F.lit(-(2**63))).alias("order_id"), F.col("payload_digest").alias("digest"), "refers_to", "refers_key").distinct(), "revisits")
    source = _ordered(pages).withColumn("payload_digest", F.sha2(raw, 256)).withColumn("payload_bytes", F.octet_length(raw).cast("long"))
    joined = source.join(again, (source.order_id == again.order_id) & (source.payload_digest == again.digest), "left").drop(again.order_id).drop("digest")
    typed = joined.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
    typed = typed.withColumn("html", F.when(F.col("record_type") == "response", F.col("html")))
    size = seen.agg(F.coalesce(F.sum("payload_bytes"), F.lit(0))).first()[0]
    parts = max(pages.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    ranged = typed.repartitionByRange(parts, "key", "order_id").sortWithinPartitions("key", "order_id")
    return materialize(ranged.mapInArrow(_archive(uri), _PARTS), "parts")


def read_archives(asked: DataFrame, parts: DataFrame, uri: str, keep_payload: bool = False) -> DataFrame:
    """The captures of ``asked`` (url, page_id), found through the index. Lookups without a capture give no row.

    The driver holds one line per part file, at most one for each PART_BYTES of payload or for each core. Each part's
    lookups are a task of their own, so that a task reads at most one part.
    """
    table = sorted((r.first_key, r.first_id, r.path) for r in parts.collect())
    if not table:
        return asked.sparkSession.createDataFrame([], _FOUND)
    keyed = asked.select(url_key(F.col("url")).alias("key"), F.coalesce(F.col("page_id").cast("long"), F.lit(-(2**63))).alias("order_id")).distinct()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [(a.encode(), b) for a, b, _ in table]
        for batch in batches:
            rows = zip(batch.column("key").to_pylist(), batch.column("order_id").to_pylist(), strict=True)
            at = [max(0, bisect.bisect_right(firsts, (k.encode(), i)) - 1) for k, i in rows]
            yield pa.record_batch([batch.column("key"), batch.column("order_id"), pa.array(at, pa.int32()), pa.array([table[i][2] for i in at])], ["key", "order_id", "part", "path"])

    placed = keyed.mapInArrow(assign, "key string, order_id long, part int, path string")
    dealt = placed.repartitionById(len(table), F.col("part")).sortWithinPartitions("path", "key", "order_id")
    return dealt.mapInArrow(_lookup(uri, keep_payload), _FOUND)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from new archives."""
    spark: SparkSession = pages.sparkSession
    uri = work_path(spark, "warc")
    parts = write_archives(pages, uri)
    return read_archives(pages, parts, uri).drop("payload")
