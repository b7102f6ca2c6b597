"""Flat token files as a Spark data source: format "flattokens".

A shard is `part-<number>-<attempt>.tokens`: u32 token ids, little endian, one document after another; `.offsets` beside it
holds u64 n+1 offsets, `.keys` i64 keys and `.known` a byte for each key, 0 where it is null. Tasks write under a name of
their own and the driver publishes, on each commit, one more manifest (MANIFEST-<commit>.json) that lists the shards of
successful tasks, so that lost or repeated tasks leave nothing that a reader would see and appends add to what is there. An
overwriting commit deletes the manifests before it once its own stands.
Paths go through pyarrow's file systems (local, s3://, gs://, hdfs://); on a cluster the folder must be shared.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "key bigint, ids array<int>"
MANIFEST = "MANIFEST-"
KINDS = ("tokens", "offsets", "keys", "known")
#: Tokens that are written or read at once, and documents whose offsets and keys are.
TOKENS, DOCUMENTS = 1 << 20, 1 << 16


def _at(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:/"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


@dataclass
class Shard(WriterCommitMessage):
    name: str
    documents: int
    tokens: int


@dataclass
class ShardPartition(InputPartition):
    name: str


def _manifests(system: fs.FileSystem, root: str) -> list[str]:
    files = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.path for f in files if f.base_name.startswith(MANIFEST))


class FlatTokens(DataSource):
    @classmethod
    def name(cls) -> str:
        return "flattokens"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> "FlatWriter":
        return FlatWriter(self.options["path"], overwrite)

    def reader(self, schema) -> "FlatReader":
        return FlatReader(self.options["path"])


class FlatWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool = False) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Shard:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, root = _at(self.path)
        system.create_dir(root, recursive=True)
        name = f"part-{context.partitionId() if context else 0:05d}-{uuid.uuid4().hex}"
        documents = tokens = 0
        with system.open_output_stream(f"{root}/{name}.tokens") as t, system.open_output_stream(f"{root}/{name}.offsets") as o, system.open_output_stream(f"{root}/{name}.keys") as k, system.open_output_stream(f"{root}/{name}.known") as known:
            o.write(np.zeros(1, "<u8").tobytes())
            for b in batches:
                ids = b.column("ids")
                size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype("<u8")
                values = ids.flatten().to_numpy(zero_copy_only=False)
                for a in range(0, len(values), TOKENS):
                    t.write(values[a : a + TOKENS].astype("<u4").tobytes())
                o.write((tokens + np.cumsum(size, dtype="<u8")).astype("<u8").tobytes())
                k.write(b.column("key").fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                known.write(b.column("key").is_valid().to_numpy(zero_copy_only=False).astype("u1").tobytes())
                documents, tokens = documents + len(size), tokens + int(size.sum())
        return Shard(name, documents, tokens)

    def commit(self, messages: list[Shard | None]) -> None:
        system, root = _at(self.path)
        system.create_dir(root, recursive=True)
        shards = [{"name": m.name, "documents": m.documents, "tokens": m.tokens} for m in messages if m is not None]
        before = _manifests(system, root) if self.overwrite else []
        with system.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps({"shards": shards}).encode())
        for old in before:
            system.delete_file(old)

    def abort(self, messages: list[Shard | None]) -> None:
        system, root = _at(self.path)
        for m in messages:
            if m is not None:
                for kind in KINDS:
                    system.delete_file(f"{root}/{m.name}.{kind}")


class FlatReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[ShardPartition]:
        system, root = _at(self.path)
        found = _manifests(system, root)
        if not found:
            raise FileNotFoundError(f"{self.path} holds no committed flat token files")
        shards = []
        for manifest in found:
            with system.open_input_stream(manifest) as f:
                shards += json.loads(f.read())["shards"]
        return [ShardPartition(s["name"]) for s in shards if s["documents"]] or [ShardPartition("")]

    def read(self, partition: ShardPartition) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        system, root = _at(self.path)

        def opened(kind: str) -> pa.NativeFile:
            return system.open_input_file(f"{root}/{partition.name}.{kind}")

        with opened("tokens") as tokens, opened("offsets") as offsets, opened("keys") as keys, opened("known") as known:
            documents = known.size()
            for a in range(0, documents, DOCUMENTS):
                n = min(DOCUMENTS, documents - a)
                at = np.frombuffer(offsets.read_at(8 * (n + 1), 8 * a), "<u8").astype(np.int64)
                key = pa.array(np.frombuffer(keys.read_at(8 * n, 8 * a), "<i8").astype(np.int64), mask=np.frombuffer(known.read_at(n, a), "u1") == 0)
                i = 0
                while i < n:  # a document at least
                    z = min(i + 1000, max(i + 1, int(np.searchsorted(at, at[i] + TOKENS, side="right")) - 1), n)
                    values = np.frombuffer(tokens.read_at(int(4 * (at[z] - at[i])), int(4 * at[i])), "<u4").astype(np.int32)
                    yield pa.RecordBatch.from_arrays([key[i:z], pa.ListArray.from_arrays(pa.array((at[i : z + 1] - at[i]).astype(np.int32)), pa.array(values))], names=["key", "ids"])
                    i = z


def write_flat(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> None:
    """Encoded documents to flat shards; a null key stays null, null ids are none. Appends to what is there."""
    encoded.sparkSession.dataSource.register(FlatTokens)
    encoded.selectExpr(f"CAST(`{key}` AS BIGINT) AS key", f"CAST(`{ids}` AS ARRAY<INT>) AS ids").write.format("flattokens").mode("append").save(path)


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    """(key, ids) of flat shards."""
    spark.dataSource.register(FlatTokens)
    return spark.read.format("flattokens").load(path)
