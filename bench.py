"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is warmed up once and timed as the best of BENCH_RUNS (default 1) runs into a no-op sink, so that JVM start-up and
code generation lie outside. mb_s: UTF-8 megabytes of documents.text per second and per core of the encoding queries.
Before timing, every text must come back from its ids, or the run ends.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.plans import queries as Q

DIR, CPUS, RUNS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "1"))
HEADLINE = ["pretok_o200k", "count_tokens", "encode_docs", "token_counts", "offsets_byte", "csr_offsets", "decode_roundtrip"]
PER_BYTE = ["pretok_o200k", "count_tokens", "encode_docs", "decode_roundtrip"]


def exact(spark: SparkSession) -> None:
    """Decoding gives the texts again."""
    enc = Q.encoding()
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    lost = docs.where(~T.decode(T.encode("text", enc), enc, errors="strict").eqNullSafe(F.col("text"))).count()
    if lost:
        sys.exit(f"{lost} documents don't come back")


def main() -> None:
    cores = int(CPUS) if CPUS.isdigit() else os.cpu_count() or 1
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", str(2 * cores)).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    exact(spark)
    mb = spark.read.parquet(f"{DIR}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0] / 1e6
    queries, seconds = Q.queries(), {}
    for name in HEADLINE:
        best = float("inf")
        for run in range(RUNS + 1):
            began = time.perf_counter()
            queries[name](spark, DIR).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began) if run else best
        seconds[name] = round(best, 3)
    rates = {n: {"total": round(mb / seconds[n], 2), "per_core": round(mb / seconds[n] / cores, 2)} for n in PER_BYTE}
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(DIR.rstrip("/")), "mb": round(mb, 2), "mb_s": rates, "cores": cores}))


if __name__ == "__main__":
    main()
