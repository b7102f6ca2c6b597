"""Vocabulary files: rank lists, binary vocabularies, special tables and encoding descriptions, read and written.

Formats (all little endian):
    rank list      text lines, base64 of the token's bytes, a space, the rank
    .vocab         u32 n, then n times u16 length, bytes, u32 rank
    .special       u32 n, then n times u32 id, u16 length, bytes
    .enc           lines key=value: scanner, nfc, id_offset; # begins a comment line
A path with a scheme (s3a://, hdfs://, viewfs://) is read through Spark, so vocabularies may lie in any store.
"""

from __future__ import annotations

import base64
import os
import re
import struct
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..encoding import MAX_SPECIALS, MAX_TOKENS, NAMED, BadVocabulary, Encoding, check_ranks, check_specials
from ..functions.grammars import GRAMMARS


def read_bytes(path: str) -> bytes:
    """A whole (small) file."""
    if re.match(r"[A-Za-z][\w+.-]+:/", path):
        spark = SparkSession.getActiveSession()
        if spark is None:
            raise RuntimeError(f"{path}: a SparkSession is needed to read it")
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as f:
        return f.read()


def _exists(path: str) -> bool:
    try:
        if re.match(r"[A-Za-z][\w+.-]+:/", path):
            read_bytes(path)
            return True
    except Exception:  # the store's own exception for a missing path
        return False
    return os.path.exists(path)


def read_rank_list(path: str) -> dict[bytes, int]:
    ranks: dict[bytes, int] = {}
    for line in read_bytes(path).split(b"\n"):
        if line.strip():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    check_ranks(ranks)
    return ranks


def rank_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, bytes) of a rank list, read as a table (native; any size, no checks)."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.split("value", " ").alias("p"))
    return lines.select(F.col("p")[1].cast("int").alias("id"), F.unbase64(F.col("p")[0]).alias("bytes"))


class _Reader:
    def __init__(self, data: bytes, path: str) -> None:
        self.data, self.at, self.path = data, 0, path

    def number(self, kind: str) -> int:
        (value,) = struct.unpack("<" + kind, self.take(struct.calcsize("<" + kind)))
        return value

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise BadVocabulary(f"{self.path} is cut short")
        self.at += n
        return self.data[self.at - n : self.at]

    def end(self) -> None:
        if self.at < len(self.data):
            raise BadVocabulary(f"{self.path} goes on after its last record")


def read_vocab(path: str) -> dict[bytes, int]:
    r = _Reader(read_bytes(path), path)
    n = r.number("I")
    if not 1 <= n <= MAX_TOKENS:
        raise BadVocabulary(f"{path} has {n} tokens")
    ranks = {}
    for _ in range(n):
        token = r.take(r.number("H"))
        ranks[token] = r.number("I")
    r.end()
    check_ranks(ranks)
    return ranks


def read_specials(path: str) -> dict[str, int]:
    """The special tokens of a file; none if there is no such file."""
    if not _exists(path):
        return {}
    r = _Reader(read_bytes(path), path)
    n = r.number("I")
    if n > MAX_SPECIALS:
        raise BadVocabulary(f"{path} has {n} special tokens")
    specials = {}
    for _ in range(n):
        token_id = r.number("I")
        specials[r.take(r.number("H")).decode()] = token_id
    check_specials(specials)
    return specials


def read_description(path: str) -> dict[str, str]:
    out = {}
    for line in read_bytes(path).decode().splitlines():
        if (line := line.rstrip()) and not line.startswith("#"):
            key, sign, value = line.partition("=")
            if not sign or key not in ("scanner", "nfc", "id_offset"):
                raise BadVocabulary(f"{path}: bad line {line!r}")
            out[key] = value
    if out.get("scanner") not in GRAMMARS:
        raise BadVocabulary(f"{path}: bad scanner {out.get('scanner')!r}")
    return out


def load_encoding(name: str, data_dir: str) -> Encoding:
    """A named encoding, or one that a .enc file describes."""
    at = lambda f: f"{data_dir.rstrip('/')}/{f}"
    if name in NAMED:
        grammar, vocab, special, nfc = NAMED[name]
        offset = 0
        if not _exists(at(vocab + ".vocab")):
            raise FileNotFoundError(f"{name} needs {vocab}.vocab in {data_dir}: bring your own vocabulary, or import its tokenizer")
    elif _exists(at(name + ".enc")):
        d = read_description(at(name + ".enc"))
        grammar, vocab, special, nfc, offset = d["scanner"], name, name, d.get("nfc") == "1", int(d.get("id_offset", 0))
    else:
        raise KeyError(f"unknown encoding {name!r}: known are {', '.join(NAMED)} and what has been imported into {data_dir}")
    return Encoding(name, grammar, read_vocab(at(vocab + ".vocab")), read_specials(at(special + ".special")), nfc, offset)


def write_encoding(enc: Encoding, data_dir: str, name: str | None = None) -> None:
    """.vocab, .special and, last of all, .enc: an encoding shows up only when it is whole."""
    name = name or enc.name
    if not re.match(r"[A-Za-z][\w+.-]+:/", data_dir):
        os.makedirs(data_dir, exist_ok=True)
    _put(f"{data_dir}/{name}.vocab", vocab_bytes(enc.ranks))
    _put(f"{data_dir}/{name}.special", special_bytes(enc.specials))
    lines = [f"scanner={enc.grammar}"] + ["nfc=1"] * enc.nfc + [f"id_offset={enc.id_offset}"] * bool(enc.id_offset)
    _put(f"{data_dir}/{name}.enc", ("\n".join(lines) + "\n").encode())


def vocab_bytes(ranks: Mapping[bytes, int]) -> bytes:
    body = b"".join(struct.pack("<H", len(b)) + b + struct.pack("<I", r) for b, r in sorted(ranks.items(), key=lambda x: x[1]))
    return struct.pack("<I", len(ranks)) + body


def special_bytes(specials: Mapping[str, int]) -> bytes:
    body = b"".join(struct.pack("<IH", i, len(s.encode())) + s.encode() for s, i in sorted(specials.items(), key=lambda x: x[1]))
    return struct.pack("<I", len(specials)) + body


def _put(path: str, data: bytes) -> None:
    """A (small) file, whole or not at all; a path with a scheme goes through Spark's file systems."""
    if re.match(r"[A-Za-z][\w+.-]+:/", path):
        spark = SparkSession.getActiveSession()
        if spark is None:
            raise RuntimeError(f"{path}: a SparkSession is needed to write it")
        hadoop = spark._jvm.org.apache.hadoop.fs
        part, whole = hadoop.Path(path + ".tmp"), hadoop.Path(path)
        system = whole.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        out = system.create(part, True)
        out.write(bytearray(data))
        out.close()
        system.delete(whole, False)
        system.rename(part, whole)
        return
    with open(path + ".tmp", "wb") as f:
        f.write(data)
    os.replace(path + ".tmp", path)
