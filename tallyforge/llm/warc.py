"""WARC archives: write, index first, then coalesced range reads.

Records are text (their payload is UTF-8), so Spark's own text sink writes the
archives, with the blank lines between records as its line separator. A pass
over the archives then writes an index of offset, length, URL and digest per
record. A read takes selected index rows, sorts them by file and offset, joins
neighbouring ranges into one read each, and cuts the records out.

Of records with equal payloads (SHA-1 and length) of at least ``least_bytes``
the one with the largest id is a response and the others revisit it, without a
payload of their own.

Defined results: a null payload is an empty one; a null URL has no target line;
line breaks in a URL are written as %0D and %0A; repeated rows give repeated
records (rows that share the largest id are all responses); a row with a null id
is never referred to; very long payloads are one record, held whole by the task that
writes or reads it; an empty table gives an archive without records and an empty index;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch

TERMINATOR = "\r\n\r\n"
#: Ranges no further apart than GAP are read at once, up to MOST_READ bytes.
GAP = 64 << 10
MOST_READ = 8 << 20
MOST_BROADCAST = 1_000_000
#: One number (record id) and one digest a row.
_INDEX = "file string, offset long, length long, block long, page_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long"


def archive_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One column, ``value``: each row's WARC record without its closing blank lines."""
    scratch = Scratch(pages.sparkSession)
    payload = F.coalesce(pages[payload_col].cast("string"), F.lit(""))
    rows = pages.select(pages[id_col].cast("string").alias("id"), pages[id_col].alias("key"), pages[url_col].cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    # Narrow rows, counted before the shuffle: only digests that occur again matter.
    groups = rows.filter(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.max("key").alias("first"), F.max_by("url", "key").alias("first_url"), F.count(F.lit(1)).alias("n"))
    again = scratch.keep(groups.filter("n > 1 and first is not null").drop("n"), "again")
    held = F.broadcast(again) if again.count() <= MOST_BROADCAST else again
    marked = rows.join(held, ["digest", "bytes"], "left").withColumn("revisit", F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")))

    def line(name: str, value) -> F.Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")

    def uri(value):
        return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))

    revisit = F.col("revisit")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(TERMINATOR))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce("id", F.lit("")), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">")))),
        line("WARC-Refers-To-Target-URI", F.when(revisit, uri(F.col("first_url")))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        length.cast("string"),
        F.lit(TERMINATOR),
    )
    return marked.select(F.concat(head, http, F.when(revisit, "").otherwise(F.col("payload"))).alias("value"))


def write_archives(pages: DataFrame, path: str, *, records_per_file: int = 10_000, **options) -> None:
    """Write ``pages`` as WARC files under ``path`` (options: see archive_records)."""
    archive_records(pages, **options).write.option("lineSep", TERMINATOR).option("maxRecordsPerFile", records_per_file).text(path)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    uri = re.sub(r"^file:/+", "file:///", uri).replace("s3a://", "s3://")
    return pafs.FileSystem.from_uri(uri)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (x.partition(b": ") for x in head.split(b"\r\n")[1:])
    return {a.decode().lower(): b.decode("utf-8", "replace") for a, _, b in pairs}


def _page(value: str | None) -> str | None:
    return (value[len("<urn:page:") : -1] or None) if value else None


def index_archives(spark: SparkSession, path: str) -> DataFrame:
    """The index of all archives under ``path``: one row per record, one task per file."""
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("path")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, local = _open(uri)
                rows: list[tuple] = []
                with fs.open_input_file(local) as f:
                    size, offset = f.size(), 0
                    while offset < size:
                        head = bytearray(f.read(2048))
                        while (end := head.find(b"\r\n\r\n")) < 0:
                            more = f.read(2048)
                            if not more:
                                raise ValueError(f"{uri}: no record at {offset}")
                            head += more
                        h = _fields(bytes(head[:end]))
                        block = offset + end + 4
                        body = int(h["content-length"])
                        f.seek(block)
                        http = _fields(f.read(min(body, 512)).partition(b"\r\n\r\n")[0])
                        rows.append((uri, offset, block + body - offset, block - offset, _page(h["warc-record-id"]), h.get("warc-target-uri"), h["warc-type"], _page(h.get("warc-refers-to")), h["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])))
                        offset = block + body + len(TERMINATOR)
                        f.seek(offset)
                        if len(rows) >= 5000:
                            yield _index_batch(rows)
                            rows = []
                if rows:
                    yield _index_batch(rows)

    n = max(1, files.count())
    return files.repartition(n).mapInArrow(scan, _INDEX)


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64()]
    names = [x.split()[0] for x in _INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def coalesce_ranges(ranges: list[tuple[int, int]], gap: int = GAP, most: int = MOST_READ) -> list[tuple[int, int, int]]:
    """(first, last + 1, end) runs of sorted (offset, end) ranges to be read at once."""
    runs: list[tuple[int, int, int]] = []
    for i, (begin, end) in enumerate(ranges):
        if runs:
            first, _, upto = runs[-1]
            if begin - upto <= gap and max(end, upto) - ranges[first][0] <= most:
                runs[-1] = (first, i + 1, max(end, upto))
                continue
        runs.append((i, i + 1, end))
    return runs


def read_records(selected: DataFrame, *, with_payload: bool = True) -> DataFrame:
    """The records of index rows, by sorted and coalesced range reads; each payload is checked against its digest.

    Returns page_id (as text), url, record_type, refers_to, payload_bytes, payload_digest and, if wanted, payload (null for revisits).
    """
    schema = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string" + (", payload string" if with_payload else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            begin = 0
            while begin < len(rows):
                stop = begin
                while stop < len(rows) and rows[stop]["file"] == rows[begin]["file"]:
                    stop += 1
                own = rows[begin:stop]
                begin = stop
                fs, local = _open(own[0]["file"])
                with fs.open_input_file(local) as f:
                    for first, last, end in coalesce_ranges([(r["offset"], r["offset"] + r["length"]) for r in own]):
                        start = own[first]["offset"]
                        data = f.read_at(end - start, start)
                        yield _records(own[first:last], data, start, with_payload)

    n = max(1, selected.select("file").distinct().count())
    dealt = selected.select("file", "offset", "length", "block", "page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes").repartition(n, "file").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read, schema)


def _records(rows: list[dict], data: bytes, start: int, with_payload: bool) -> pa.RecordBatch:
    out = []
    for r in rows:
        at = r["offset"] - start
        block = data[at + r["block"] : at + r["length"]]
        payload, size = None, r["payload_bytes"]
        if r["record_type"] == "response":
            payload = block[block.index(b"\r\n\r\n") + 4 :]
            size = len(payload)
            if hashlib.sha1(payload).hexdigest() != r["payload_digest"]:
                raise ValueError(f"{r['file']}: the payload at {r['offset']} does not have its digest")
        text = [payload.decode() if payload is not None else None] if with_payload else []
        out.append((r["page_id"], r["url"], r["record_type"], r["refers_to"], size, r["payload_digest"], *text))
    types = [pa.string()] * 4 + [pa.int64(), pa.string()] + [pa.string()] * with_payload
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * with_payload
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
