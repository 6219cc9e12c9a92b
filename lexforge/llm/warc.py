"""WARC archives of pages, and their transactions.

A capture is three records: a request, a response or a revisit, and metadata, which name the
response or revisit that they are concurrent to. Responses and revisits begin with the head of an
HTTP message, after which the payload comes. Archives are text files whose line separator is
the two line ends that close a WARC record, so Spark's own sink writes and compresses them, wherever
the path leads; how many there are follows from their bytes. Records are read back one after another
by the lengths in their headers, joined by their identifiers and nested in one row per capture.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
#: Pages in an archive, at most, and payload bytes, about; a compressed archive and one record are in memory when it is read.
PAGES_PER_FILE = 2000
ARCHIVE_BYTES = 64_000_000
#: Bytes of records in a batch, at most, but for the last of them.
BATCH_BYTES = 16_000_000
_END = "\r\n"
_CLOSE = "\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"
_SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _header(kind: Column, record: Column, length: Column, date: str, content: str, *more: Column) -> Column:
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record), F.lit(f"WARC-Date: {date}"), F.lit(f"Content-Type: {content}"), *more]
    return F.concat(F.concat_ws(_END, *lines, F.concat(F.lit("Content-Length: "), length.cast("string"))), F.lit(_CLOSE))


def with_verdicts(pages: DataFrame, least_bytes: int = LEAST_BYTES, partitions: int | None = None) -> DataFrame:
    """(page_id, url, html, digest, n, nth, first): ``first`` is the page whose payload is the same.

    Of pages with equal payloads of at least ``least_bytes`` the smallest id is first and has null
    there, like all other pages. The payloads themselves are shuffled by page; only digests are
    compared. ``nth`` counts rows that repeat a page and its payload. The result has so many
    ``partitions``, if any are given.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha2(F.col("html"), 256), "n": F.octet_length("html").cast("long")})
    small = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    small = small.where(F.octet_length("html") >= least_bytes).select("page_id", F.sha2(F.col("html"), 256).alias("digest"))
    firsts = small.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    known = small.where("page_id is not null").distinct().join(firsts, "digest").where("page_id <> first")
    # the join and the window below need no other shuffle than this
    rows = rows.repartition(partitions, "page_id", "digest") if partitions else rows
    joined = rows.join(known, ["page_id", "digest"], "left")
    nth = F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("url")) - 1
    return joined.withColumn("nth", nth)


def write_warc(
    pages: DataFrame,
    path: str,
    least_bytes: int = LEAST_BYTES,
    pages_per_file: int = PAGES_PER_FILE,
    archive_bytes: int = ARCHIVE_BYTES,
    date: str = _DATE,
    compression: str = "gzip",
) -> None:
    """Write a request, a response or revisit and a metadata record per row of (page_id, url, html).

    A null html is an empty payload, a null url an empty one. A revisit has no payload; it names
    the page that has. Rows without a page_id are captures too, whose metadata have no page.
    ``compression`` is that of the text sink: ``gzip`` makes one member of an archive, with ``none``
    records can be sought.
    """
    total = pages.agg(F.sum(F.octet_length(F.col("html").cast("string")).cast("long"))).first()[0] or 0
    files = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // archive_bytes))
    rows = with_verdicts(pages, least_bytes, files)
    name = F.concat(F.lit("urn:capture:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(":"), F.substring("digest", 1, 16), F.lit(":"), F.col("nth").cast("string"))
    record = lambda kind: F.concat(F.lit("<"), F.col("_name"), F.lit(f":{kind}>"))
    field = lambda key, value: F.concat(F.lit(f"{key}: "), value)
    target = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")
    uri = field("WARC-Target-URI", target)
    held = field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    to_main = field("WARC-Concurrent-To", record("main"))
    rows = rows.withColumn("_name", name)
    get = F.concat(F.lit("GET "), F.regexp_replace(target, r"[\x00-\x20]", "%20"), F.lit(f" HTTP/1.0{_CLOSE}"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.col("n").cast("string"), F.lit(_CLOSE))
    about = F.concat_ws(_END, field("page_id", F.col("page_id").cast("string")), F.concat(F.lit("payload-bytes: "), F.col("n").cast("string")), F.lit(""))
    again = F.col("first").isNotNull()
    refers = F.when(again, field("WARC-Refers-To", F.concat(F.lit("<urn:capture:"), F.col("first").cast("string"), F.lit(":"), F.substring("digest", 1, 16), F.lit(":0:main>"))))
    profile = F.when(again, F.lit(f"WARC-Profile: {_SAME}"))
    kind = F.when(again, F.lit("revisit")).otherwise(F.lit("response"))
    body = F.when(again, head).otherwise(F.concat(head, F.col("html")))
    length = F.octet_length(head) + F.when(again, 0).otherwise(F.col("n"))
    records = [
        F.concat(_header(F.lit("request"), record("request"), F.octet_length(get), date, "application/http; msgtype=request", uri, to_main), get),
        F.concat(_header(kind, record("main"), length, date, "application/http; msgtype=response", uri, held, refers, profile), body),
        F.concat(_header(F.lit("metadata"), record("metadata"), F.octet_length(about), date, "application/warc-fields", uri, to_main), about),
    ]
    sink = rows.select(F.array_join(F.array(*records), _CLOSE).alias("value")).write.option("lineSep", _CLOSE)
    sink.option("maxRecordsPerFile", pages_per_file).option("compression", compression).mode("error").text(path)


def _records(archive: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, with names in lower case, and blocks of the records of an archive, one at a time.

    The block of a record that tells no length goes to the next line that begins a record.
    """
    version = archive.readline()
    while version:
        if not version.strip():
            version = archive.readline()
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {version[:40]!r}")
        headers = {}
        while line := archive.readline().decode(errors="replace").rstrip("\r\n"):
            key, _, value = line.partition(":")
            headers[key.strip().lower()] = value.strip()
        if headers.get("content-length", "").isdecimal():
            block, version = archive.read(int(headers["content-length"])), archive.readline()
        else:
            lines = []
            while (version := archive.readline()) and not version.startswith(b"WARC/"):
                lines.append(version)
            block = b"".join(lines).removesuffix(_CLOSE.encode())
        yield headers, block


def _opened(data: bytes) -> io.BufferedIOBase:
    """The bytes of an archive; each record or all of them together may be a gzip member."""
    raw = io.BytesIO(data)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if data[:2] == b"\x1f\x8b" else raw


def _payload(headers: dict[str, str], block: bytes) -> memoryview:
    """What comes after the HTTP head of a response or revisit, if there is one, else the block."""
    http = headers.get("warc-type") in ("response", "revisit") and headers.get("content-type", "").startswith("application/http")
    head = block.find(_CLOSE.encode()) if http else -1
    return memoryview(block)[head + len(_CLOSE) if head >= 0 else 0 :]


def read_records(spark: SparkSession, path: str, payloads: bool = True, files: str = "part-*") -> DataFrame:
    """One row per record of the archives under a path whose names match ``files``.

    record_id, type, target_uri, concurrent_to, refers_to, digest (of a revisit from its header, else
    of the content), n_bytes of the content, fields (of metadata) and, with ``payloads``, content:
    what comes after the HTTP head in responses and revisits, all of the block in other records.
    What a record does not tell, its id and type too, is null.
    """
    schema = "record_id string, type string, target_uri string, concurrent_to string, refers_to string, digest string, n_bytes long, fields map<string, string>" + ", content binary" * payloads

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                rows, size = [], 0
                for h, block in _records(_opened(batch.column(0)[i].as_py())):
                    content = _payload(h, block)
                    about = [tuple(p.strip() for p in x.partition(":")[::2]) for x in block.decode(errors="replace").split("\r\n") if x] if h.get("warc-type") == "metadata" else None
                    digest = h.get("warc-payload-digest", "").removeprefix("sha256:") if h.get("warc-type") == "revisit" else hashlib.sha256(content).hexdigest()
                    rows.append((h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), digest, len(content), about, bytes(content) if payloads else None))
                    size += len(content) if payloads else 0
                    if len(rows) == 1000 or size > BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
                yield _batch(rows)

    kinds = [pa.string()] * 6 + [pa.int64(), pa.map_(pa.string(), pa.string())] + [pa.binary()] * payloads
    names = [f.split()[0] for f in schema.replace("map<string, string>", "map").split(", ")]

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    archives = spark.read.format("binaryFile").option("pathGlobFilter", files).option("recursiveFileLookup", "true").load(path).select("content")
    return archives.mapInArrow(parse, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id and a struct for request, response, revisit and metadata each.

    A record belongs to the capture of the record that it is concurrent to, or to its own. A part
    that no record tells is null; of several records of one type the smallest id is taken.
    """
    names = [c for c in records.columns if c != "concurrent_to"]
    key = F.coalesce("concurrent_to", "record_id").alias("capture_id")
    part = lambda t: F.min_by(F.when(F.col("type") == t, F.struct(*names)), F.when(F.col("type") == t, F.col("record_id"))).alias(t)
    return records.groupBy(key).agg(*[part(t) for t in ("request", "response", "revisit", "metadata")])


def resolve(captures: DataFrame) -> DataFrame:
    """Per capture: page_id, payload_bytes, payload_digest, record_type and refers_to.

    A revisit gets its payload's size from the response that it refers to, not from itself.
    """
    main = F.coalesce("response", "revisit")
    flat = captures.select("capture_id", F.col("metadata.fields")["page_id"].cast("long").alias("page_id"), main["type"].alias("record_type"), main["n_bytes"].alias("own"), main["digest"].alias("payload_digest"), main["refers_to"].alias("target"))
    there = flat.where("record_type = 'response'").select(F.col("capture_id").alias("target"), F.col("page_id").alias("refers_to"), F.col("own").alias("full"))
    plain = flat.where("target is null").select("page_id", F.col("own").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = flat.where("target is not null").join(there, "target", "left").select("page_id", F.col("full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return plain.union(again)
