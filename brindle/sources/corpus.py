"""Corpus readers: whole text files, and text extracted from crawls (WET archives)."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): a row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def conversion_records(raw: bytes) -> Iterator[tuple[str | None, str]]:
    """(target URI, text) of the conversion records of a WET file, gzipped or not."""
    stream = io.BytesIO(raw)
    if raw[:2] == b"\x1f\x8b":
        stream = gzip.GzipFile(fileobj=stream)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers = {}
        while (h := stream.readline().rstrip(b"\r\n")):
            name, _, value = h.partition(b":")
            headers[name.strip().lower()] = value.strip()
        body = stream.read(int(headers.get(b"content-length", b"0")))
        if headers.get(b"warc-type") == b"conversion":
            uri = headers.get(b"warc-target-uri")
            yield uri.decode("utf-8", "replace") if uri is not None else None, body.decode("utf-8", "replace")


def _records(rows: list[tuple]) -> pa.RecordBatch:
    file, record, uri, text = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(record, pa.int64()), pa.array(uri, pa.string()), pa.array(text, pa.string())], names=["file", "record", "uri", "text"])


def read_wet(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, uri, text) of WET archives; an archive is one task's unit and streams out record by record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows, size = [], 0
                for i, (uri, text) in enumerate(conversion_records(raw)):
                    rows.append((name, i, uri, text))
                    size += len(text)
                    if len(rows) == 1000 or size > 1 << 22:
                        yield _records(rows)
                        rows, size = [], 0
                if rows:
                    yield _records(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, record long, uri string, text string")
