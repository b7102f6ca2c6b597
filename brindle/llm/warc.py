"""WARC archives: writing, reading and a globally ordered capture index by external merge.

write_archives() turns captures into WARC/1.1 records (response, or revisit for a payload that another record holds) and
writes them through Spark's own committed file output, so the folder may be in any store and a lost task leaves nothing
behind. A record ends in CRLF CRLF, which is the writer's line separator. read_archives() parses the files by
Content-Length, hashes the payloads again, and gives one locally sorted run of index entries per archive file.
merge_runs() range-partitions the runs' entries by (URL key, time, id) and merges the k runs that meet in a partition with a
loser tree; partitions in order, and rows within them, are the global capture histories.

Defined cases: a null html is an empty payload; a null url has no target and an empty URL key; of equal payloads the one
with the largest id is the response and the others revisit it (rows that repeat that id are responses too; if all ids are
null, all are responses; a null id beside a known one revisits it); payloads shorter than min_bytes are always responses;
an empty table gives no records. Archive files hold at most MAX_RECORDS records and FILE_BYTES bytes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Callable, Iterator, Sequence
from typing import Any
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, partitions

CRLF = "\r\n"
MAX_RECORDS = 20_000
#: Bytes of an archive before compression at most, but for a single record that has more.
FILE_BYTES = 256 << 20
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
ENTRY = "urlkey string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, record_no int"


def sha1_base32(column) -> "F.Column":
    """Bare upper-case base32 SHA-1 of a string's or binary's bytes: 20 bytes are four groups of 40 bits, eight digits each."""
    digest = F.sha1(column)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), _DIGITS, _BASE32)


def with_records(captures: DataFrame, id_col: str, body: str, min_bytes: int = 0) -> DataFrame:
    """Adds payload (string), n_bytes, digest and holder (the id whose record holds an equal payload; null: this one does)."""
    rows = captures.withColumn("payload", F.coalesce(F.col(body), F.lit("")))
    rows = rows.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("digest", sha1_base32(F.col("payload")))
    # only digests that occur twice travel to the join, and each once
    again = rows.where(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.max(id_col).alias("_holder"), F.count(F.lit(1)).alias("_n"))
    again = again.where("_n > 1 and _holder is not null").select("digest", "_holder")
    rows = rows.join(again, "digest", "left")
    return rows.withColumn("holder", F.when(~F.col(id_col).eqNullSafe(F.col("_holder")), F.col("_holder"))).drop("_holder")


def _header_value(column) -> "F.Column":
    return F.regexp_replace(column, r"[\x00-\x1F\x7F]", "%00")


def record_text(id_col: str, url: str) -> "F.Column":
    """The record of a row of with_records(), without its final CRLF CRLF."""
    revisit = F.col("holder").isNotNull()
    ident = lambda c: F.concat(F.lit("<urn:capture:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    lines = [
        F.lit("WARC/1.1"),
        F.when(revisit, F.lit("WARC-Type: revisit")).otherwise(F.lit("WARC-Type: response")),
        F.concat(F.lit("WARC-Record-ID: "), ident(F.col(id_col))),
        F.concat(F.lit("WARC-Date: "), F.date_format(F.to_utc_timestamp("captured", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), _header_value(F.col(url))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), ident(F.col("holder")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block)


def write_archives(captures: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", body: str = "html", captured: str | None = None, min_bytes: int = 0) -> None:
    """Write a record per row into gzip-compressed archive files in folder. captured: a timestamp column; by default the id in seconds."""
    when = F.col(captured) if captured else F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.coalesce(F.col(id_col), F.lit(0)), F.lit(1_000_000_000)))
    rows = with_records(captures.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.col(body).alias("html"), when.alias("captured")), "id", "html", min_bytes)
    out = rows.select(record_text("id", "url").alias("value"))
    largest = captures.agg(F.max(F.octet_length(body))).first()[0] or 0
    most = max(1, min(MAX_RECORDS, FILE_BYTES // (largest + 4096)))
    out.write.option("compression", "gzip").option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", most).text(folder)


# -- reading ----------------------------------------------------------------------------------


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of an archive."""
    while line := stream.readline():
        if line.rstrip(b"\r\n") not in (b"WARC/1.0", b"WARC/1.1"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        headers = _headers(stream)
        block = stream.read(size := int(headers["content-length"]))
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield headers, block


def _headers(stream) -> dict[str, str]:
    out = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def url_key(url: str) -> str:
    """Sort-friendly form of a URL: host labels reversed, scheme, port, www and case dropped."""
    try:
        parts = urlsplit(url.strip().lower())
        host = parts.hostname or ""
    except ValueError:
        return url.strip().lower()
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _ident(value: str | None) -> int | None:
    found = (value or "").removeprefix("<urn:capture:").removesuffix(">")
    return None if found in ("", "null") else int(found)


def index_entry(headers: dict[str, str], block: bytes) -> tuple:
    """(urlkey, captured, page_id, payload_bytes, payload_digest, record_type, refers_to), checked against the block."""
    stream = io.BytesIO(block)
    stream.readline()
    http = _headers(stream)
    payload, kind = block[stream.tell() :], headers["warc-type"]
    said = headers["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if len(payload) != int(http["content-length"]) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != said:
            raise ValueError(f"payload of {headers['warc-record-id']} differs from its digest")
    refers = _ident(headers.get("warc-refers-to"))
    return (url_key(headers.get("warc-target-uri", "")), headers["warc-date"], _ident(headers["warc-record-id"]), int(http["content-length"]), said, kind, refers)


def _order(entry: Sequence) -> tuple:
    """Sort key of entries: URL key, time, id with null first."""
    return (entry[0], entry[1], entry[2] is not None, entry[2] or 0)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The index entries of all archives in folder; each file's are one run, sorted by (urlkey, captured, page_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                name = path.as_py().rsplit("/", 1)[-1]
                with gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer())) as packed:
                    entries = [(*index_entry(h, b), name, i) for i, (h, b) in enumerate(records(io.BufferedReader(packed, 1 << 20)))]
                entries.sort(key=_order)
                if entries:
                    yield _batch(entries)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
    return files.select("path", "content").mapInArrow(run, ENTRY)


_TYPES = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32())
_NAMES = [x.split()[0] for x in ENTRY.split(", ")]


def _batch(entries: Sequence[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(zip(*entries), _TYPES)], names=_NAMES)


# -- merging ----------------------------------------------------------------------------------


class LoserTree:
    """Merge of k sorted iterators: every inner node keeps the loser of its match, so a step replays one path to the root."""

    def __init__(self, runs: Sequence[Iterator], key: Callable[[Any], Any]) -> None:
        self.runs, self.key, self.k = list(runs), key, len(runs)
        self.heads: list[Any] = [None] * self.k
        self.keys: list[Any] = [None] * self.k
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._advance(i)
        for i in range(self.k):
            self._replay(i)

    def _advance(self, i: int) -> None:
        head = next(self.runs[i], None)
        self.heads[i] = head
        self.keys[i] = None if head is None else (self.key(head), i)

    def _beats(self, i: int, j: int) -> bool:
        """Does run i's head come before run j's? An exhausted run comes last."""
        if self.keys[i] is None or self.keys[j] is None:
            return self.keys[j] is None and self.keys[i] is not None
        return self.keys[i] < self.keys[j]

    def _replay(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # while building: the first to come waits for its opponent
                self.losers[node] = i
                return
            if self._beats(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator:
        while self.k and self.heads[winner := self.losers[0]] is not None:
            yield self.heads[winner]
            self._advance(winner)
            self._replay(winner)


def merge_runs(entries: DataFrame) -> DataFrame:
    """Globally ordered capture histories: partition p's entries all come before partition p+1's, each in order.

    The composite key also ends in the id, so one URL with very many captures spreads over partitions.
    """
    n = partitions(entries.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                runs.setdefault(row[7], []).append(row)
        for rows in runs.values():
            # a run is one task's output, so what a partition gets of it comes in order; only a reader that is torn up needs more
            keys = [_order(r) for r in rows]
            if any(b < a for a, b in zip(keys, keys[1:])):
                rows.sort(key=_order)
        out = []
        for row in LoserTree([iter(r) for r in runs.values()], _order):
            out.append(row)
            if len(out) >= 10_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return entries.repartitionByRange(n, "urlkey", "captured", "page_id").mapInArrow(run, ENTRY)


def archive_round_trip(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Write pages as archives, read them back, and give the merged index."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    write_archives(pages, folder, **columns)
    return merge_runs(read_archives(spark, folder))
